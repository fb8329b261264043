"""Word-level byte-pair encoding and decoding with contiguous rank arrays.

``WordBPE`` reads a ``tokenizers`` JSON file whose model is a BPE with an end-of-word suffix and encodes text as that
library does with ``add_special_tokens=False`` (no truncation, no padding), decoding as ``decode(ids,
skip_special_tokens=False)``.  A word is merged in place: a contiguous row holds the rank of each boundary between two
parts; the row is scanned for its minimum, that boundary is deleted, and the ranks of the two boundaries beside it are
looked up again, until no boundary has a rank.  The new words of a batch are rows of one matrix, so that numpy scans them
together.  Words of more than ``SHORT`` bytes take a heap over linked parts instead, because the scan is quadratic; both
give the same merges (lowest rank first, leftmost on ties).

A bounded cache of encoded words changes only the speed.

Defined cases: a null text is an empty text; an empty text or one of white space has no ids and decodes to ''; repeated
rows are encoded each; any length is taken whole; special-token strings in a text are those tokens, as in the library;
other columns of the input, whatever their names, are not read; a null id stays null.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.llm.words import mixed

#: Symbols up to which a word is merged by scanning its rank array.
SHORT = 128
NO_RANK = 1 << 30
#: Masks of the first bytes of a little-endian number.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Rows of a batch of results.
ROWS = 500
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NEWER = (
    r"\u0558-\u0558\u058b-\u058c\u088f-\u088f\u0c5c-\u0c5c\u0cdc-\u0cdc\u1c89-\u1c89"
    r"\u208f-\u208f\u209d-\u209f\ua7cb-\ua7cc\ua7ce-\ua7cf\ua7d2-\ua7d2\ua7d4-\ua7d4"
    r"\ua7da-\ua7da\ua7dc-\ua7dd\ua7e2-\ua7e2\ua7f1-\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    r"\U00010940-\U00010959\U00010d50-\U00010d65\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a-\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011df1-\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168-\U0001b168"
    r"\U0001d6a6-\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f"
    r"\U0002b81e-\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class PairTable:
    """Rank of an id pair, for arrays of pairs: hash tables of one slot each, the next one for what collides."""

    def __init__(self, pairs: dict[int, int], bits: int = 18):
        self.shift, self.levels = np.uint64(64 - bits), []
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        for level in range(32):
            if not len(keys):
                break
            factor = np.uint64((0x9E3779B97F4A7C15 + 0x5851F42D4C957F2E * level) % (1 << 64) | 1)
            slot, table, value = self._slot(keys, factor), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            table[slot], value[slot] = keys, ranks
            left = table[slot] != keys
            keys, ranks = keys[left], ranks[left]
            self.levels.append((factor, table, value))

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * factor) >> self.shift).view(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        out = np.full(keys.shape, NO_RANK, np.int32)
        for factor, table, value in self.levels:
            slot = self._slot(keys, factor)
            out = np.where(table[slot] == keys, value[slot], out)
        return out


class Places(dict):
    """A cache: the place of each key in the list ``ids``.  A new key takes the next place, and its ids from the cache before this one or, later, from ``learn``; till then it is in ``new``."""

    def __init__(self, before: Places | None = None):
        super().__init__()
        self.ids, self.new, self.before = [], [], before
        if before is not None:
            before.before = None

    def __missing__(self, key):
        self[key] = place = len(self.ids)
        if self.before is None or (have := self.before.get(key)) is None:
            self.ids.append(None)
            self.new.append(key)
        else:
            self.ids.append(self.before.ids[have])
        return place

    def fill(self, values: list) -> None:
        """Ids of the new keys."""
        get, ids = self.get, self.ids
        for key, value in zip(self.new, values):
            ids[get(key)] = value
        self.new = []


class WordBPE:
    """Encoder and decoder for one tokenizer file."""

    #: Entries at which a new generation of a cache (of chunks, of pieces) begins; a block of texts may add more.  Two generations are kept.
    CACHE_ENTRIES = 200_000
    #: Bytes of text that are looked up together.
    BLOCK = 2_000_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + suffix] for c in alphabet]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces_any = regex.compile(pattern.replace(r"\s", _SPACES)).findall
        # letters and numbers that are newer than the library's character tables are other characters to it
        self.pieces_new = regex.compile("(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^{_SPACES}\p{{L}}\p{{N}}]||[{_NEWER}]]").replace(r"[\p{L}]", rf"[[\p{{L}}]--[{_NEWER}]]").replace(r"[\p{N}]", rf"[[\p{{N}}]--[{_NEWER}]]")).findall
        self.is_new = regex.compile(f"[{_NEWER}]").search
        # the same classes spelt out for the Latin scripts, for the standard library's faster engine
        latin = [(c, chr(c)) for c in range(0x250)]
        spelt = {k: "".join(re.escape(x) for c, x in latin if regex.fullmatch(rf"[{v}]", x)) for k, v in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", _SPACES))}
        self.pieces_latin = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spelt['S']}{spelt['L']}{spelt['N']}]").replace(r"\p{L}", spelt["L"]).replace(r"\p{N}", spelt["N"])).findall
        self.is_latin = re.compile("[\0-\u024f]*").fullmatch
        self.table = self.pair_table()
        self.chunks, self.words = Places(), Places()

    def pair_table(self) -> PairTable | None:
        """The table that ``merge_words`` looks ranks up in; a subclass that merges another way needs none."""
        return PairTable(self.ranks)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty), as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for high in (4, 8, 12, 16, 24, 32, 64, SHORT):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for at in range(0, len(rows), 1 + (1 << 20) // high):
                self._merge_rows(words, sizes, rows[at : at + 1 + (1 << 20) // high], high, out)
        for i in np.flatnonzero(sizes > SHORT):
            parts = [self.inner[b] for b in words[i]]
            parts[-1] = self.last[words[i][-1]]
            out[i] = np.array(self._merge_long(parts), "<u4").tobytes()
        return out

    def _merge_rows(self, words: list[bytes], sizes: np.ndarray, rows: np.ndarray, width: int, out: list[bytes]) -> None:
        n, size = len(rows), sizes[rows]
        data = np.frombuffer(b"".join([words[i] for i in rows]) + bytes(width), np.uint8)
        place = np.arange(width)
        ids = np.asarray(self.inner, np.int32)[data[(np.cumsum(size) - size)[:, None] + place]]
        every = np.arange(n)
        ids[every, size - 1] = np.asarray(self.last, np.int32)[data[np.cumsum(size) - 1]]
        alive = place < size[:, None]
        # a column more on either side, so that the neighbours of the outermost parts exist and never have a rank
        ranks = np.full((n, width + 1), NO_RANK, np.int32)
        ranks[:, : width - 1] = np.where(alive[:, 1:], self.table(ids[:, :-1], ids[:, 1:]), NO_RANK)
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        merged = np.asarray(self.merged, np.int32)
        live = every
        while len(live):
            at = ranks[live].argmin(1)
            rank = ranks[live, at]
            some = rank < NO_RANK
            live, at, rank = live[some], at[some], rank[some]
            if not len(live):
                break
            new = merged[rank]
            gone = after[live, at]
            then, prior = after[live, gone], before[live, at]
            ids[live, at], alive[live, gone], ranks[live, gone] = new, False, NO_RANK
            after[live, at] = then
            before[live, np.minimum(then, width)] = at
            has = then < size[live]
            ranks[live, at] = np.where(has, self.table(new, ids[live, np.minimum(then, width - 1)]), NO_RANK)
            has = prior >= 0
            ranks[live[has], prior[has]] = self.table(ids[live[has], prior[has]], new[has])
        flat, ends = ids[alive].astype("<u4").tobytes(), (np.cumsum(alive.sum(1)) * 4).tolist()
        start = 0
        for i, end in zip(rows.tolist(), ends):
            out[i] = flat[start:end]
            start = end

    def _merge_long(self, parts: list[int]) -> list[int]:
        get, n = self.ranks.get, len(parts)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self.merged[rank], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, x in zip(parts, alive) if x]

    def normalise(self, text: str) -> str:
        """Composed and lower-cased character by character."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def pieces(self, chunk: str) -> list[str]:
        """The words and runs of other characters of normalised text, in order.  No piece has white space in it, so those of a text are those of its chunks."""
        if chunk.isascii() or self.is_latin(chunk):
            return self.pieces_latin(chunk)
        return (self.pieces_new if self.is_new(chunk) else self.pieces_any)(chunk)

    def learn(self) -> None:
        """Find the ids of the new chunks."""
        chunks, words = self.chunks, self.words
        if len(words) > self.CACHE_ENTRIES:
            words = self.words = Places(words)
        get, pieces, latin, of = words.__getitem__, self.pieces, self.is_latin, []
        for chunk in [x.decode() for x in chunks.new]:
            if chunk.isalpha() and (chunk.isascii() or latin(chunk)):
                of.append(get(chunk))
            else:
                of.append([get(x) for x in pieces(chunk)])
        words.fill(self.merge_words([x.encode() for x in words.new]))
        ids = words.ids
        chunks.fill([ids[x] if type(x) is int else b"".join([ids[i] for i in x]) for x in of])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of each text."""
        collects = gc.isenabled()
        # nothing here has cycles, and the collector would walk the caches again and again
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            parts, owner, start, size = [], [], at, 0
            while at < len(texts) and (size < self.BLOCK or at == start):
                text = texts[at]
                # special tokens cut the text before anything else
                cut = self.split_special.split(text) if self.split_special and any(x in text for x in self.special) else [text]
                parts += cut
                owner += [at - start] * len(cut)
                size += len(text)
                at += 1
            found: list[list[bytes]] = [[] for _ in range(at - start)]
            for i, part, ids in zip(owner, parts, self._plain(["" if x in self.special else x for x in parts])):
                found[i].append(self.special[part].to_bytes(4, "little") if part in self.special else ids)
            out += [x[0] if len(x) == 1 else b"".join(x) for x in found]
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens: what stands between spaces and line feeds is looked up once for each distinct chunk."""
        if len(self.chunks) > self.CACHE_ENTRIES:
            self.chunks = Places(self.chunks)
        parts = [self.normalise(x).encode() for x in texts]
        raw = b"\n".join(parts) + b"\n" * 17
        data = np.frombuffer(raw, np.uint8)
        edges = np.diff(((data != 32) & (data != 10)).view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        places = self._distinct(data, starts, ends)
        distinct, which = places if places else (np.arange(len(starts)),) * 2
        keys = [raw[a:b] for a, b in zip(starts[distinct].tolist(), ends[distinct].tolist())]
        at = list(map(self.chunks.__getitem__, keys))
        if self.chunks.new:
            self.learn()
        values = list(map(self.chunks.ids.__getitem__, at))
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat, first = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[which]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(first[which] - before[:-1], lengths) + np.arange(before[-1])].tobytes()
        borders = np.cumsum([0, *(len(x) + 1 for x in parts)])
        cuts = (4 * before[np.searchsorted(starts, borders)]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """One index for each distinct chunk of up to 16 bytes and for every longer one, and the place in that list of each chunk; None if hashes collide."""
        size = ends - starts
        short = np.flatnonzero(size <= 16)
        eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
        key = [eight[starts[short] + d] & _LOW[np.clip(size[short] - d, 0, 8)] for d in (0, 8)]
        mixed_key = mixed(key[0]) * np.uint64(0x9E3779B97F4A7C15) + mixed(key[1] + np.uint64(1))
        order = np.argsort(mixed_key)
        mixed_key, (low, high) = mixed_key[order], (k[order] for k in key)
        new = np.append(len(short) > 0, mixed_key[1:] != mixed_key[:-1])[: len(short)]
        if ((low[1:] != low[:-1]) | (high[1:] != high[:-1]))[~new[1:]].any():
            return None
        long = np.flatnonzero(size > 16)
        which = np.empty(len(starts), np.int64)
        which[short[order]] = np.cumsum(new) - 1
        which[long] = np.arange(len(long)) + int(new.sum())
        return np.concatenate([short[order[new]], long]), which

    def decode(self, ids: bytes) -> str:
        """The library's decode without a decoder: token texts joined by one space; unknown ids are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, array("I", ids)))
        except KeyError:
            return " ".join([self.tokens[i] for i in array("I", ids) if i in self.tokens])


_loaded: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """The encoder of a file, kept for the life of a worker."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens``, SHA-256 of the ids (as little-endian uint32) and of the decoded text, and the ``outputs`` themselves.

    Nothing is shuffled; memory is bounded by ``ROWS`` rows and their results.
    """
    out = [(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out += [(n, {"ids": pa.binary(), "decoded": pa.string()}[n]) for n in outputs]
    schema = pa.schema(out)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                cols: list[list] = [[] for _ in range(len(out) - 1)]
                for ids in bpe.encode_batch([x or "" for x in part.column(1).to_pylist()]):
                    decoded = bpe.decode(ids)
                    row = [len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded.encode()).hexdigest(), *({"ids": ids, "decoded": decoded}[n] for n in outputs)]
                    for col, x in zip(cols, row):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ", ".join(f"`{n}` {kinds[t]}" for n, t in out))
