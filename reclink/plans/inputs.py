"""Mentions made from the driver's tables: records, texts and truth for the operators to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.operators.fields import OTHER, Field
from reclink.sources.mentions import table

PART_FIELDS = [OTHER, Field("brand", True, hash="unigram", similarity="soft_dice"), Field("name", True, hash="unigram", similarity="soft_dice"), Field("type", True, hash="unigram", similarity="soft_cosine")]
PLACE_FIELDS = [OTHER, Field("nation", True, hash="unigram", similarity="soft_dice"), Field("region", True, hash="unigram", similarity="soft_dice")]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(mention_id, is_record, source, true_cluster, text): labelled documents are records, their quality is the cluster."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, folder, "documents").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("mention_id"), F.col("quality").isNotNull().alias("is_record"), "source", F.col("quality").cast("string").alias("true_cluster"), "text")


def _labels(words: Column, label: str) -> Column:
    return F.transform(words, lambda w, i: F.when(i == 0, f"B-{label}").otherwise(f"I-{label}"))


def _mention(prefix: str, key: Column, is_record: bool, *parts: tuple[Column, str]) -> list[Column]:
    labels = [F.transform(w, lambda x: F.lit("O")) if label == "O" else _labels(w, label) for w, label in parts]
    return [
        F.concat(F.lit(prefix), key.cast("string")).alias("mention_id"), F.lit(is_record).alias("is_record"), key.cast("string").alias("true_cluster"),
        F.concat(*[w for w, _ in parts]).alias("words"), F.concat(*labels).alias("labels"),
    ]


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """The same rows over all cores: a stored table of few bytes a row is read by one or two tasks, however much work a row makes."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Each part as a record (name, brand, type) and as a text that gives type and brand first, with a word between."""
    rows = dealt(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    name, brand, kind = F.split("p_name", " "), F.array("p_brand"), F.array("p_type")
    records = rows.select(*_mention("r", F.col("p_partkey"), True, (name, "name"), (brand, "brand"), (kind, "type")))
    texts = rows.select(*_mention("t", F.col("p_partkey"), False, (F.array(F.lower("p_type")), "type"), (brand, "brand"), (F.array(F.lit("with")), "O"), (name, "name")))
    return records.unionByName(texts)


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Each nation as a record (region, nation) and as a text."""
    rows = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region, nation = F.split("r_name", " "), F.array("n_name")
    records = rows.select(*_mention("r", F.col("n_nationkey"), True, (region, "region"), (nation, "nation")))
    texts = rows.select(*_mention("t", F.col("n_nationkey"), False, (nation, "nation"), (F.array(F.lit("in")), "O"), (region, "region")))
    return records.unionByName(texts)


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, turn, words)."""
    from reclink.functions.text import words

    return table(spark, folder, "conversations").select("conv_id", "turn", words(F.col("text")).alias("words"))


def page_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, position, word, label, bio) of the pages' flat markup, without scripts, styles and comments."""
    from reclink.functions.text import NOT_TEXT
    from reclink.sources.mentions import parse_markup

    pages = table(spark, folder, "pages").select("page_id", F.regexp_replace("html", NOT_TEXT, " ").alias("html"))
    return parse_markup(pages, "page_id", "html")


def page_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, words, labels)."""
    from reclink.sources.mentions import collect_tokens

    return collect_tokens(page_tokens(spark, folder), "page_id")


def word_examples(mentions: DataFrame) -> DataFrame:
    """The plainest examples: each word is its feature."""
    return mentions.withColumns({"word_features": F.col("words"), "feats": F.transform("words", lambda w: F.array(w)), "ends": F.array_repeat(F.lit(True), F.size("words") + 1)})
