"""Tables and text files that pipelines write and read again: vocabularies, parameters, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.operators.params import dump_lines
from reclink.session import dropped, written
from reclink.sources.mentions import positions

VOCABULARY = "kind string, term string, id bigint"


def write_vocabulary(terms: DataFrame, path: str) -> None:
    """Replace a table (kind, term, id); ids number the terms of a kind in order, by ranges of terms rather than in one task."""
    known = written(terms.select("kind", "term").distinct(), "terms")
    out = None
    # kinds are the few dictionaries of a pipeline
    for kind in sorted(r["kind"] for r in known.select("kind").distinct().collect()):
        own = positions(known.where(F.col("kind") == kind), "term").select("kind", "term", (F.col("position").cast("bigint") - 1).alias("id"))
        out = own if out is None else out.unionByName(own)
    out = known.withColumn("id", F.lit(0).cast("bigint")) if out is None else out
    out.write.mode("overwrite").partitionBy("kind").parquet(path)
    dropped(terms.sparkSession, known)


def read_vocabulary(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """All kinds, or one, which reads its own files alone."""
    rows = spark.read.schema(VOCABULARY).parquet(path)
    return rows.where(F.col("kind") == kind) if kind else rows


def terms_of(ids: DataFrame, vocabulary: DataFrame, column: str = "id") -> DataFrame:
    """``ids`` with the term of each id of one kind's vocabulary; null for unknown ones."""
    return ids.join(vocabulary.select(F.col("id").alias(column), "term"), column, "left")


def ids_of(terms: DataFrame, vocabulary: DataFrame, column: str = "term", unknown: int = -1) -> DataFrame:
    """``terms`` with the id of each term; ``unknown`` for those that the vocabulary lacks."""
    return terms.join(vocabulary.select(F.col("term").alias(column), "id"), column, "left").withColumn("id", F.coalesce("id", F.lit(unknown).cast("bigint")))


def write_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_params_text(params: DataFrame, path: str) -> None:
    """Lines of the entries that aren't zero, in order over the files."""
    dump_lines(params).write.mode("overwrite").text(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").parquet(path)


def write_quarantine(rows: DataFrame, path: str) -> None:
    """Rows that couldn't be parsed, added to those of earlier runs."""
    rows.write.mode("append").parquet(path)
