"""From raw documents to token ids: quality, near-duplicates, repeated passages, the mixture of sources, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``, and extra ones with the values they had, whatever their names.  Null
texts are empty ones and null ids are no one's copies; rows repeated as a whole are near duplicates; empty tables go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.llm import bpe, mixing, quality, simhash, substring_dedup
from reclink.llm.queries import vocabulary
from reclink.llm.words import exact
from reclink.session import ship, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, with the posteriors of their source and language, rejects go."""
    ship(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar by 0.8 or more, directly or through others, that of the smallest id stays."""
    ship(spark)
    return simhash.deduplicated(docs, shingle=5, similarity=0.8)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document with a smaller id has go; n_chars follows the text."""
    ship(spark)
    out = substring_dedup.dedup_substrings(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*exact(docs.columns)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by tempered weights; documents of small sources may come several times."""
    ship(spark)
    return mixing.mixture(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit), their number, and digests of ids and decoded text."""
    ship(spark)
    return bpe.encode_documents(docs, vocabulary(), outputs=("ids",))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("bpe encoding and decoding", bpe_stage),
]

#: SQL can't express the classifier, the signatures or the encoder; tests hold each stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
