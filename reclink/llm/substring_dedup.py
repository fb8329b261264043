"""Removal of passages that already occur in a document with a smaller id: repeated-phrase automata.

A window is ``window`` consecutive words.  A word goes if some window over it has a word sequence that also starts in a
document with a smaller id; windows are judged on the input.  The result is exact: hashes only find candidates, the words
themselves decide.

1. Every window has an anchor, the phrase of ``GRAM`` words with the smallest hash in it, so equal windows have equal
   anchors.  Each group of documents (by a hash of the id) sends its distinct anchors, packed, to buckets by hash.  A hot
   phrase is sent once by a group, however many documents repeat it.
2. A bucket answers each group with those of its anchors that several documents have.
3. A group cuts the passages around anchors that recur (the windows that share an occurrence of the anchor) and sends the
   distinct ones, with the smallest id that has them, to a shard by the anchor's hash.
4. A shard confirms: where all passages around an anchor are the same words, that is the answer.  Else those of its windows
   whose words recur, as sequences of word numbers, are compiled into a pyahocorasick automaton, and the passages around
   these anchors are streamed through it, once to find the smallest id of each phrase and once to locate every occurrence.
5. The answers go back to the groups, which drop the covered words.

The texts are shuffled once, by id, and that exchange is read three times.  No step holds more than a group, a bucket or a
shard; their numbers grow with the input, and no key is hot because ids and anchors are hashed and duplicates are folded
where they arise.

Defined cases: null text: no words, left null; a document of fewer than ``window`` words keeps all; rows with the same id
are one document to each other (none removes from the other); a null id counts as larger than all others, and rows with
null ids don't remove from each other; white space between kept words becomes one space where something was removed, and
texts from which nothing goes stay as they are; empty tables give empty results; extra columns are kept.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from reclink.llm.words import blocks_of, gram_hashes, word_hashes

GRAM, WINDOW = 5, 13
#: Documents of a group, and documents for each bucket and shard (at least ``LEAST_SHARDS`` of these).
GROUP_DOCS, SHARD_DOCS, LEAST_SHARDS = 256, 4_096, 48
BLOCK_BYTES = 1 << 19
#: Windows of a passage; a longer run of windows with one anchor, as repetitive texts have, is cut.
LONGEST_RUN = 63
NO_ID = np.iinfo(np.int64).max


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` consecutive values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _windows(texts: list[bytes], window: int):
    """For blocks of texts: the anchor of each window, its text, its first word there."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for a, b in blocks_of(sizes, BLOCK_BYTES):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        words, first = word_hashes(data, np.concatenate([[0], np.cumsum(sizes[a:b])]))
        counts = np.maximum(0, np.diff(first) - window + 1)
        if not counts.any():
            continue
        anchors = _sliding_min(gram_hashes(words, GRAM), window - GRAM + 1)
        text = np.repeat(np.arange(b - a), counts)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield anchors[first[:-1][text] + inside], text + a, inside


def _read_group(table: pa.Table) -> tuple[list[int], list[bytes], list[int]]:
    """Ids, texts and row numbers of a group's documents, in an order that is the same on every read."""
    ids = [NO_ID if x is None else x for x in table["id"].to_pylist()]
    texts = [(x or "").encode() for x in table["text"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], order


def _passages(table: pa.Table, window: int):
    """Ids and texts, and the runs of windows of a text that share an anchor, in order: anchor, text, first word, number of windows."""
    ids, texts, _ = _read_group(table)
    parts = []
    for anchors, text, inside in _windows(texts, window):
        new = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])]))
        runs = np.diff(np.append(new, len(anchors)))
        if len(long := np.flatnonzero(runs > LONGEST_RUN)):
            new = np.union1d(new, np.concatenate([np.arange(new[i], new[i] + runs[i], LONGEST_RUN) for i in long]))
            runs = np.diff(np.append(new, len(anchors)))
        parts.append((anchors[new], text[new], inside[new], runs))
    if not parts:
        return ids, texts, *(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return ids, texts, *(np.concatenate(x) for x in zip(*parts))


def _cut(texts: list[bytes], which: np.ndarray, text: np.ndarray, inside: np.ndarray, runs: np.ndarray, window: int):
    """Words of the runs ``which``: (run, text, words joined by a space)."""
    now, words = -1, []
    for k, t, start, size in zip(which.tolist(), text[which].tolist(), inside[which].tolist(), runs[which].tolist()):
        if t != now:
            now, words = t, texts[t].split()
        yield k, t, b" ".join(words[start : start + size + window - 1])


def _folded(texts, anchors, which, text, inside, runs, shards: int, window: int):
    """Distinct passages of a group by shard, in an order that is the same on every read: (anchor, windows, words) -> index, and (shard, index, run) of each run."""
    out: dict[int, dict[tuple[int, int, bytes], int]] = {}
    at = []
    shard = (anchors % np.uint64(shards)).astype(np.int64)
    for (k, _, words), anchor, s, size in zip(_cut(texts, which, text, inside, runs, window), anchors[which].tolist(), shard[which].tolist(), runs[which].tolist()):
        own = out.setdefault(s, {})
        at.append((s, own.setdefault((anchor, size, words), len(own)), k))
    return out, at


def _locate(first: dict[int, dict[tuple[int, bytes], int]], window: int) -> dict[tuple[int, int, bytes], list[int]]:
    """Smallest id of each window of the passages around anchors that have different passages."""
    numbers: dict[bytes, int] = {}
    several = [(anchor, size, words, own, tuple([numbers.setdefault(w, len(numbers)) for w in words.split(b" ")])) for anchor, of in first.items() if len(of) > 1 for (size, words), own in of.items()]
    # confirm which windows recur, by their words
    seen: set[tuple] = set()
    recurs: dict[tuple, int] = {}
    for _, size, _, _, words in several:
        for i in range(size):
            key = words[i : i + window]
            if key in seen:
                recurs.setdefault(key, len(recurs))
            else:
                seen.add(key)
    del seen
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, number in recurs.items():
        automaton.add_word(key, number)
    ids = [NO_ID] * len(recurs)
    recurs.clear()
    if ids:
        automaton.make_automaton()
        for _, _, _, own, words in several:
            for _, which in automaton.iter(words):
                ids[which] = min(ids[which], own)
    out = {}
    for anchor, size, text, own, words in several:
        found = [own] * size
        if ids:
            for end, which in automaton.iter(words):
                found[end - window + 1] = ids[which]
        out[anchor, size, text] = found
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digests: bool = False) -> DataFrame:
    """``docs`` with ``text_col`` freed of repeated passages and in the same columns; or, with ``digests``, the id with n_words, n_removed and kept_sha256."""
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words at least")
    columns = [] if digests else [c for c in docs.columns if c not in (id_col, text_col)]
    rest = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("rest")] if columns else []
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"), *rest)
    n = docs.count()
    shards, n_groups = max(LEAST_SHARDS, -(-n // SHARD_DOCS)), max(1, -(-n // GROUP_DOCS))
    # rows with a null id are spread by their texts
    grouped = base.withColumn("g", F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(n_groups)))

    def send_anchors(table: pa.Table) -> pa.Table:
        ids, _, anchors, text, _, _ = _passages(table, window)
        own = np.asarray(ids, np.int64)[text]
        order = np.lexsort((own, anchors))
        anchors, own = anchors[order], own[order]
        start = np.flatnonzero(np.append(anchors[:1] == anchors[:1], anchors[1:] != anchors[:-1]))
        last = np.append(start[1:], len(anchors))[: len(start)] - 1
        several, anchors, own = own[start] != own[last], anchors[start], own[start]
        bucket = (anchors % np.uint64(shards)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
        g = table["g"][0].as_py()
        return _table("anchors", [(int(bucket[x[0]]), g, anchors[x].tobytes(), own[x].tobytes(), np.packbits(several[x]).tobytes()) for x in parts])

    def recurring(table: pa.Table) -> pa.Table:
        anchors = [np.frombuffer(x.as_py(), np.uint64) for x in table["anchors"]]
        ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["ids"]])
        several = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(a)) for x, a in zip(table["several"], anchors)])
        every = np.concatenate(anchors)
        order = np.argsort(every, kind="stable")
        new = np.append(True, np.diff(every[order]) != 0)
        start = np.flatnonzero(new)
        by_key = (np.minimum.reduceat(ids[order], start) != np.maximum.reduceat(ids[order], start)) | (np.maximum.reduceat(several[order], start) > 0)
        hit = np.zeros(len(every), bool)
        hit[order] = by_key[np.cumsum(new) - 1]
        cuts = np.cumsum([len(x) for x in anchors])[:-1]
        return _table("recurring", [(g, a[h].tobytes()) for g, a, h in zip(table["g"].to_pylist(), anchors, np.split(hit, cuts)) if h.any()])

    def runs_of(docs_table: pa.Table, replies: pa.Table):
        ids, texts, anchors, text, inside, runs = _passages(docs_table, window)
        wanted = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in replies["anchors"])])
        return ids, texts, text, inside, runs, *_folded(texts, anchors, np.flatnonzero(np.isin(anchors, wanted)), text, inside, runs, shards, window)

    def send_passages(docs_table: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs_table.num_rows or not replies.num_rows:
            return _table("passages", [])
        ids, _, text, _, _, passages, at = runs_of(docs_table, replies)
        low = {s: [NO_ID] * len(x) for s, x in passages.items()}
        for s, i, k in at:
            low[s][i] = min(low[s][i], ids[text[k]])
        g = docs_table["g"][0].as_py()
        return _table("passages", [(s, g, np.array([a for a, _, _ in own], np.uint64).tobytes(), np.array(low[s], np.int64).tobytes(), bytes([n for _, n, _ in own]), b"\n".join([w for _, _, w in own])) for s, own in passages.items()])

    def confirm(table: pa.Table) -> pa.Table:
        first: dict[int, dict[tuple[int, bytes], int]] = {}
        blobs = []
        for anchors, low, sizes, words in zip(*(table[c] for c in ("anchors", "ids", "sizes", "words"))):
            blob = list(zip(np.frombuffer(anchors.as_py(), np.uint64).tolist(), sizes.as_py(), words.as_py().split(b"\n")))
            blobs.append(blob)
            for (anchor, size, text), own in zip(blob, np.frombuffer(low.as_py(), np.int64).tolist()):
                of = first.setdefault(anchor, {})
                of[size, text] = min(of.get((size, text), NO_ID), own)
        found = _locate(first, window)
        out = []
        for g, shard, anchors, blob in zip(table["g"].to_pylist(), table["shard"].to_pylist(), table["anchors"], blobs):
            answer = [x for key in blob for x in found.get(key) or [first[key[0]][key[1:]]] * key[1]]
            out.append((g, shard, np.unique(np.frombuffer(anchors.as_py(), np.uint64)).tobytes(), zlib.compress(np.array(answer, np.int64).tobytes(), 1)))
        return _table("answers", out)

    def finish(docs_table: pa.Table, replies: pa.Table) -> pa.Table:
        names = [f.name for f in final]
        if not docs_table.num_rows:
            return pa.table([pa.array([], f.type) for f in final], schema=final)
        _, _, order = _read_group(docs_table)
        ids, texts, text, inside, runs, passages, at = runs_of(docs_table, replies)
        gone: dict[int, list[int]] = {}
        lows = {s: np.frombuffer(zlib.decompress(x.as_py()), np.int64) for s, x in zip(replies["shard"].to_pylist(), replies["answer"])}
        starts = {s: np.cumsum([0, *(n for _, n, _ in x)]) for s, x in passages.items()}
        for s, i, k in at:
            own = ids[text[k]]
            low = lows[s][starts[s][i] : starts[s][i + 1]]
            gone.setdefault(int(text[k]), []).extend((inside[k] + np.flatnonzero(low < own)).tolist())
        total, removed, digest, kept_texts = [], [], [], []
        original = docs_table["text"].to_pylist()
        for t, data in enumerate(texts):
            words = data.split()
            total.append(len(words))
            kept = words
            if places := gone.get(t):
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, places, 1)
                np.add.at(cover, np.array(places) + window, -1)
                kept = [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]
            removed.append(len(words) - len(kept))
            joined = b" ".join(kept)
            digest.append(sha256(joined).hexdigest() if digests else "")
            kept_texts.append(joined.decode() if len(kept) < len(words) else original[order[t]])
        out = {"id": docs_table["id"].take(pa.array(order)), "text": kept_texts, "n_words": total, "n_removed": removed, "kept_sha256": digest}
        if carries:
            out["rest"] = docs_table["rest"].take(pa.array(order))
        return pa.table([x.cast(f.type) if isinstance(x := out[f.name], pa.ChunkedArray) else pa.array(x, f.type) for f in final], names=names)

    carries = bool(rest)
    if digests:
        final = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
        ddl = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    else:
        final = to_arrow_schema(base.schema)
        ddl = base.schema
    by_g = grouped.groupBy("g")
    recurs = by_g.applyInArrow(send_anchors, _DDL["anchors"]).groupBy("bucket").applyInArrow(recurring, _DDL["recurring"])
    passages = by_g.cogroup(recurs.groupBy("g")).applyInArrow(send_passages, _DDL["passages"])
    answers = passages.groupBy("shard").applyInArrow(confirm, _DDL["answers"])
    out = by_g.cogroup(answers.groupBy("g")).applyInArrow(finish, ddl)
    if digests:
        return out.withColumnRenamed("id", id_col)
    place = {c: F.col("rest")[f"c{i}"] for i, c in enumerate(columns)} | {id_col: F.col("id"), text_col: F.col("text")}
    return out.select(*[place[c].alias(c) for c in docs.columns])


_DDL = {
    "anchors": "bucket bigint, g bigint, anchors binary, ids binary, several binary",
    "recurring": "g bigint, anchors binary",
    "passages": "shard bigint, g bigint, anchors binary, ids binary, sizes binary, words binary",
    "answers": "g bigint, shard bigint, anchors binary, answer binary",
}
_SCHEMA = {k: pa.schema([(n, pa.int64() if t == "bigint" else pa.binary()) for n, t in (x.split() for x in v.split(", "))]) for k, v in _DDL.items()}


def _table(kind: str, rows: list[tuple]) -> pa.Table:
    schema = _SCHEMA[kind]
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)
