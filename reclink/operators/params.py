"""Parameters as a long table (model, kind, label, key, value); kinds: S start, T transition, E emission."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reclink.config import SMOOTHING


def vocabulary(tokens: DataFrame, threshold: int = 1, column: str = "word") -> DataFrame:
    """(term, cnt) of terms that occur at least ``threshold`` times; partial counts are made before the shuffle."""
    return tokens.groupBy(F.col(column).alias("term")).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= threshold)


def label_inventory(mentions: DataFrame) -> DataFrame:
    """Distinct labels, O first."""
    labels = mentions.select(F.explode("labels").alias("b")).select(F.regexp_replace("b", "^[BI]-", "").alias("label")).distinct()
    return labels.unionByName(labels.sparkSession.createDataFrame([("O",)], "label string")).distinct().withColumn("label_id", F.row_number().over(W.orderBy((F.col("label") != "O").cast("int"), "label")) - 1)


def sum_counts(counts: DataFrame) -> DataFrame:
    """Sum of parameter-shaped vectors."""
    return counts.groupBy("model", "kind", "label", "key").agg(F.sum("value").alias("value"))


def normalised(counts: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """Distributions: starts over labels, transitions and emissions over the keys of a label."""
    group = W.partitionBy("model", "kind", F.when(F.col("kind") == "S", F.lit("")).otherwise(F.col("label")))
    value = F.col("value") + smoothing
    return counts.withColumn("value", value / F.sum(value).over(group))


def emission_counts(tokens: DataFrame) -> DataFrame:
    """Counts of (label, word feature) in labelled tokens."""
    return tokens.groupBy("label", F.col("word").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("gen").alias("model"), F.lit("E").alias("kind"), "label", "key", "value")


def transition_counts(segments: DataFrame, order: str = "begin") -> DataFrame:
    """Counts of first labels and of label pairs of consecutive segments of a mention."""
    before = F.lag("label").over(W.partitionBy("mention_id").orderBy(order))
    rows = segments.withColumn("before", before)
    kind = F.when(F.col("before").isNull(), "S").otherwise("T")
    rows = rows.select(kind.alias("kind"), F.coalesce("before", "label").alias("label"), F.when(F.col("before").isNotNull(), F.col("label")).alias("key"))
    return rows.groupBy("kind", "label", "key").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("gen").alias("model"), "kind", "label", "key", "value")


def combined(a: DataFrame, b: DataFrame, scale_a: float = 1.0, scale_b: float = 1.0) -> DataFrame:
    """scale_a * a + scale_b * b; missing entries are 0."""
    return sum_counts(a.withColumn("value", F.col("value") * scale_a).unionByName(b.withColumn("value", F.col("value") * scale_b)))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the inner product."""
    keys = ["model", "kind", "label", "key"]
    x, y = a.alias("x"), b.alias("y")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    return x.join(y, on).agg(F.coalesce(F.sum(F.col("x.value") * F.col("y.value")), F.lit(0.0)).alias("dot"))


def squared_norm(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)).alias("squared_norm"))


def divided(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("value", F.col("value") / by)


def projected(a: DataFrame, fn: Callable[[DataFrame], Column]) -> DataFrame:
    """Each entry becomes what ``fn`` makes of the table's columns."""
    return a.withColumn("value", fn(a))


def regularised(a: DataFrame, scale: float) -> DataFrame:
    """``a`` + scale * ``a``: the pull of a quadratic penalty on a gradient of weights."""
    return a.withColumn("value", F.col("value") + scale * F.col("value"))


def dump_lines(params: DataFrame) -> DataFrame:
    """Text lines of the entries that aren't zero: kind, label, (key,) value; transitions and emissions from the largest on."""
    lines = params.where("value <> 0").select("kind", "value", F.concat_ws("\t", "kind", "label", "key", F.format_string("%.6f", "value")).alias("line"))
    return lines.orderBy(F.when(F.col("kind") == "S", 0).when(F.col("kind") == "T", 1).otherwise(2), F.when(F.col("kind") != "S", -F.col("value")), "line").select("line")
