"""Token ids as a binary store: one zstandard frame for each document, a shared dictionary, an offset index.

``write_store`` encodes every text, compresses the serialised ids of each document on their own with one dictionary that
was trained on a bounded sample of serialised id arrays (``SAMPLE_DOCS`` documents, ``SAMPLE_IDS`` ids of each), and writes
blocks in ascending id order.  A block is self-describing::

    magic "TIDS" | version u8 | bytes of an id u8 | has null ids u8 | 0 u8 | documents u64 | ids before it in its part u64
    SHA-256 of the dictionary (32 bytes)
    document ids i64[n] | null flags u8[n] (if any) | ids of each document u64[n] | offsets of the frames u64[n + 1] | frames

Blocks are rows of a table in the shared folder, so that Spark's commit protocol keeps or drops the output of a task as a
whole and any store that Spark can write will do.  The dictionary is a one-row table beside it.  A document is found from
its block's index and decompressed alone.

Parts are ranges of ids whose borders come from one aggregation over the id column; only frames are shuffled, never texts.
The driver sees one number for each part (at most ``MAX_PARTS``).

Defined cases: a null text is an empty text (its ids are the end id alone, or none without one); null ids come first;
repeated rows and ids are all stored, ordered by length and bytes; an empty table gives an empty store; extra columns are
not read.
"""

from __future__ import annotations

import struct
from array import array
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.llm.bpe import WordBPE, byte_alphabet
from reclink.session import new_path

SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1_000, 8_192, 65_536
MAX_PARTS, BLOCK_BYTES, LEVEL = 4_096, 4 << 20, 1
_HEAD = struct.Struct("<4sBBBBQQ32s")


class LibraryBPE(WordBPE):
    """Finds the ids of each new word with the tokenizers library's own model.  That costs more than a look-up, hence larger caches and blocks."""

    CACHE_ENTRIES, BLOCK = 300_000, 3_000_000

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.model, self.alphabet = Tokenizer.from_file(path).model, dict(enumerate(byte_alphabet()))

    def pair_table(self) -> None:
        return None

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        tokenize, alphabet = self.model.tokenize, self.alphabet
        return [array("I", [t.id for t in tokenize(word.decode("latin-1").translate(alphabet))]).tobytes() for word in words]


_loaded: dict[str, LibraryBPE] = {}


def _encoder(path: str) -> LibraryBPE:
    if path not in _loaded:
        _loaded[path] = LibraryBPE(path)
    return _loaded[path]


def _serialised(ids: bytes, end_id: int | None, dtype: str) -> bytes:
    out = np.frombuffer(ids, "<u4").astype(dtype)
    return (out if end_id is None else np.append(out, np.array([end_id], dtype))).tobytes()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary, or b'' where the samples are too few or too small to train one."""
    import zstandard

    if sum(map(len, samples)) < 16_384 or len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_dict_id=False), zstandard.ZstdDecompressor(dict_data=shared)


def pack_block(doc_ids: list[int | None], counts: list[int], frames: list[bytes], before: int, width: int, dictionary_hash: bytes) -> bytes:
    nulls = any(x is None for x in doc_ids)
    offsets = np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes()
    return b"".join([
        _HEAD.pack(b"TIDS", 1, width, nulls, 0, len(doc_ids), before, dictionary_hash),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids) if nulls else b"",
        np.array(counts, "<u8").tobytes(), offsets, *frames,
    ])


class Block:
    """Reader of one block."""

    def __init__(self, data: bytes, dictionary: bytes, decompressor=None):
        magic, version, self.width, nulls, _, n, self.before, dictionary_hash = _HEAD.unpack_from(data)
        if magic != b"TIDS" or version != 1:
            raise ValueError("not a block of token ids")
        if dictionary_hash != sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at = _HEAD.size
        ids = np.frombuffer(data, "<i8", n, at)
        at += 8 * n
        self.doc_ids: list[int | None] = ids.tolist()
        if nulls:
            self.doc_ids = [None if x else i for i, x in zip(self.doc_ids, data[at : at + n])]
            at += n
        self.counts = np.frombuffer(data, "<u8", n, at).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 8 * n).astype(np.int64) + at + 16 * n + 8
        self.data, self.decompressor = data, decompressor or _codec(dictionary)[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document; no other frame is read."""
        raw = self.decompressor.decompress(self.data[self.offsets[i] : self.offsets[i + 1]]) if self.counts[i] else b""
        return np.frombuffer(raw, f"<u{self.width}")


class Store:
    """A written store: ``path/blocks`` and ``path/dictionary``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.blocks = spark.read.parquet(f"{path}/blocks")
        self.dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["data"])

    def documents(self) -> DataFrame:
        """Per document, read from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
        totals = {r["part"]: r["n"] for r in self.blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
        base, so_far = {}, 0
        for part in sorted(totals):
            base[part], so_far = so_far, so_far + totals[part]
        dictionary = self.dictionary

        def read(batches):
            decompressor = _codec(dictionary)[1]
            for batch in batches:
                for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    block = Block(data.as_py(), dictionary, decompressor)
                    sums = [crc32(block.ids(i).astype("<u4").tobytes()) for i in range(len(block.doc_ids))]
                    starts = base[part] + block.before + np.cumsum(block.counts) - block.counts
                    yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(block.counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return self.blocks.select("part", "data").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

    def lookup(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the documents with this id; one block at most is read for each."""
        rows = self.blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("data").collect()
        blocks = [Block(bytes(r["data"]), self.dictionary) for r in rows]
        return [b.ids(i) for b in blocks for i, x in enumerate(b.doc_ids) if x == doc_id]


def write_store(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Store:
    """Encode every text of ``docs`` and write the store (see the module's description)."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    n_parts = max(1, min(MAX_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    borders = docs.agg(F.expr(f"percentile_approx(id, array({', '.join(str(i / n_parts) for i in range(1, n_parts + 1))}), 20000)").alias("b"), F.count(F.lit(1)).alias("n")).first()
    cuts = np.unique(np.array((borders["b"] or [])[:-1], np.int64))
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, borders["n"]))
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.xxhash64("id").alias("h"), F.substring("text", 1, 8 * SAMPLE_IDS).alias("text")).orderBy("h", "text").limit(SAMPLE_DOCS).collect()
    bpe = _encoder(tokenizer)
    dtype = "<u2" if max(max(bpe.tokens), end_id or 0) < 1 << 16 else "<u4"
    dictionary = train_dictionary([_serialised(x, end_id, dtype)[: SAMPLE_IDS * int(dtype[2])] for x in bpe.encode_batch([r["text"] or "" for r in sample])])
    digest, width = sha256(dictionary).digest(), int(dtype[2])

    def encode(batches):
        own, compressor = _encoder(tokenizer), _codec(dictionary)[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                counts, frames = [], []
                for ids in own.encode_batch([x or "" for x in part.column(1).to_pylist()]):
                    raw = _serialised(ids, end_id, dtype)
                    counts.append(len(raw) // width)
                    frames.append(compressor.compress(raw) if raw else b"")
                where = np.searchsorted(cuts, np.array(part.column(0).fill_null(np.iinfo(np.int64).min)), "left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(where), part.column(0), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["part", "id", "n_tokens", "frame"])

    def build(batches):
        names = ["part", "seq", "first_id", "last_id", "n_docs", "n_tokens", "data"]
        state = {"part": None, "seq": 0, "before": 0}
        ids, counts, frames, size = [], [], [], 0

        def block():
            real = [x for x in ids if x is not None]
            data = pack_block(ids, counts, frames, state["before"], width, digest)
            values = [state["part"], state["seq"], min(real, default=None), max(real, default=None), len(ids), sum(counts), data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            state["seq"] += 1
            state["before"] += values[5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for part, i, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (part != state["part"] or size >= BLOCK_BYTES):
                    yield block()
                    ids, counts, frames, size = [], [], [], 0
                if part != state["part"]:
                    state |= {"part": part, "seq": 0, "before": 0}
                ids.append(i)
                counts.append(n)
                frames.append(frame)
                size += len(frame) + 32
        if ids:
            yield block()

    frames = docs.mapInArrow(encode, "part int, id bigint, n_tokens bigint, frame binary")
    blocks = frames.repartition(n_parts, "part").sortWithinPartitions("part", F.col("id").asc_nulls_first(), "n_tokens", "frame").mapInArrow(build, "part int, seq int, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint, data binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(dictionary), digest.hex())], "data binary, sha256 string").write.parquet(f"{path}/dictionary")
    return Store(spark, path)
