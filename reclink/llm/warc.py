"""WARC archives with revisit resolution.

Writing: the SHA-1 of each payload is a header; headers alone (id, digest) are shuffled by digest, where the largest id of
each group of equal payloads becomes the original.  Records that repeat it are joined back by their own ids and written as
``revisit`` records that refer to the original; the others are ``response`` records with the whole payload.  All headers are
fresh.  A record is assembled by column expressions, and the files are written by Spark's text writer with the record
separator of the format (CR LF CR LF) as its line separator, so every file is a well-formed archive, compressed with gzip,
and tasks commit as a whole.  Files hold about ``FILE_BYTES`` of payload.

Reading: files are read whole, one at a time, and parsed by Content-Length.  ``resolve`` gives revisits their payloads by
joining them to the original responses.

Defined cases: a null payload is an empty one; payloads of fewer than ``LEAST_BYTES`` bytes are never revisits; rows that
repeat id and payload are both responses if that id is the largest; a null id is smaller than all others; line breaks in a
URL are percent-encoded, a null URL gives no target header; empty tables give an archive without records; extra columns are
not read.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.session import new_path, written

LEAST_BYTES, FILE_BYTES = 1_000, 16 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page, digest):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), digest, F.lit(">"))


def _records(pages: DataFrame, date: str) -> DataFrame:
    """One text column: each row's record without the separator that follows it."""
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("original"), F.col("digest")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))).cast("string")),
    ]
    return pages.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> str:
    """Write deduplicated archives and return their folder."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    pages = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("n_bytes"), F.sha1(payload.cast("binary")).alias("digest"))
    headers = written(pages.select("page_id", "digest", "n_bytes"), "headers")
    size = headers.agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    large = headers.where(F.col("n_bytes") >= least_bytes)
    repeated = written(large.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 and original is not null").select("digest", "original"), "originals")
    revisits = large.join(repeated, "digest").where("page_id is null or page_id < original").select(F.col("page_id").alias("of"), F.col("digest").alias("its"), "original").distinct()
    marked = pages.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("its")), "left")
    rows_a_file = max(1, FILE_BYTES * (size["n"] or 1) // max(1, (size["b"] or 0) + 600 * size["n"]))
    _records(marked, date).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows_a_file).text(path)
    return path


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; header names in lower case."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, block
        at = end + 4 + size


def _page(record_id: str) -> int | None:
    page = record_id.strip("<>").split(":")[2]
    return None if page == "none" else int(page)


_KINDS = {"page_id": "bigint", "url": "string", "record_type": "string", "payload_bytes": "bigint", "payload_digest": "string", "refers_to": "bigint", "payload": "binary"}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record.  Digest and length of a response are of the payload that was read (a wrong digest header raises); of a revisit, of its headers."""
    names = [n for n in _KINDS if payloads or n != "payload"]
    types = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[_KINDS[n]] for n in names]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                raw = content.as_py()
                for headers, block in parse_records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    page = _page(headers["warc-record-id"])
                    if kind == "revisit":
                        size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                        rows.append((page, headers.get("warc-target-uri"), kind, size, digest, _page(headers["warc-refers-to"]), None))
                    else:
                        own = sha1(payload).hexdigest()
                        if own != digest:
                            raise ValueError(f"payload of {headers['warc-record-id']} has another digest")
                        rows.append((page, headers.get("warc-target-uri"), kind, len(payload), own, None, payload))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{n} {_KINDS[n]}" for n in names))


def resolve(records: DataFrame) -> DataFrame:
    """Records with ``payload`` of every revisit taken from the response it refers to."""
    originals = records.where("record_type = 'response'").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("its"), F.col("payload").alias("original")).dropDuplicates(["of", "its"])
    rows = records.join(originals, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("its")), "left")
    return rows.select(*[F.coalesce("payload", "original").alias("payload") if c == "payload" else F.col(c) for c in records.columns])
