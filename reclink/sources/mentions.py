"""Mentions: scans, random order, batches, splits, parsing, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reclink.config import MAX_INT
from reclink.functions import text as X
from reclink.schemas import MENTION

#: Ranges that ``positions`` numbers apart.
MOST_RANGES = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table; only the columns and rows that a query needs are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(mentions: DataFrame, most: int = MAX_INT) -> DataFrame:
    """Records in the order of their ids, as many as wanted."""
    return _some(mentions.where("is_record"), most)


def texts(mentions: DataFrame, most: int = MAX_INT) -> DataFrame:
    return _some(mentions.where("not is_record"), most)


def mentions_of(mentions: DataFrame, most_records: int = MAX_INT, most_texts: int = MAX_INT) -> DataFrame:
    """Records, then texts."""
    return records(mentions, most_records).unionByName(texts(mentions, most_texts))


def _some(rows: DataFrame, most: int) -> DataFrame:
    return rows if most >= MAX_INT else rows.orderBy("mention_id").limit(most)


def counts(mentions: DataFrame) -> DataFrame:
    """Numbers of mentions, records and texts, in one pass."""
    return mentions.agg(F.count(F.lit(1)).alias("n_mentions"), F.count_if("is_record").alias("n_records"), F.count_if(~F.col("is_record")).alias("n_texts"))


def shuffle_key(mention_id: Column, seed: int) -> Column:
    """The order of a random scan: MD5 of id and seed."""
    return F.md5(F.concat(mention_id.cast("string"), F.lit(f":{seed}")).cast("binary"))


def random_order(mentions: DataFrame, seed: int, most: int = MAX_INT) -> DataFrame:
    """Mentions in random order, as many as wanted."""
    ordered = mentions.withColumn("shuffle_key", shuffle_key(F.col("mention_id"), seed)).orderBy("shuffle_key", "mention_id")
    return ordered if most >= MAX_INT else ordered.limit(most)


def with_random_keys(mentions: DataFrame, seed: int, n: int, most: int = MAX_INT) -> DataFrame:
    """A column rndkey: a number under ``n`` from the id's hash, for the first ``most`` mentions by id, and the largest int beyond; keys may collide."""
    digits = F.conv(F.substring(shuffle_key(F.col("mention_id"), seed), 1, 8), 16, 10).cast("bigint")
    key = (digits % n).cast("int")
    if most >= MAX_INT:
        return mentions.withColumn("rndkey", key)
    placed = positions(mentions, "mention_id")
    return placed.withColumn("rndkey", F.when(F.col("position") <= most, key).otherwise(MAX_INT)).drop("position")


def positions(rows: DataFrame, order: str, within: str | None = None) -> DataFrame:
    """A column position (from 1) in the order of a column.

    Rows are ranged by the order first and counted by range, so that no task sees them all: a range's rows are numbered after
    those of the ranges before it, of which the driver's plan has one number each.
    """
    if within:
        return rows.withColumn("position", F.row_number().over(W.partitionBy(within).orderBy(order)))
    spark = rows.sparkSession
    n = min(MOST_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    number = F.col(order)
    if dict(rows.dtypes)[order] == "string":
        # the first 7 bytes as a number keep the order; ties are in one range
        number = F.conv(F.rpad(F.substring(F.hex(F.encode(order, "utf-8")), 1, 14), 14, "0"), 16, 10).cast("bigint")
    keyed = rows.withColumn("cut__", number)
    cuts = keyed.agg(F.percentile_approx("cut__", [i / n for i in range(1, n)] + [1.0], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))[:-1]
    ranged = keyed.withColumn("range__", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("cut__"))) if cuts else F.lit(0)).withColumn("range__", F.coalesce("range__", F.lit(0)))
    size = {r["range__"]: r["count"] for r in ranged.groupBy("range__").count().collect()}
    before, so_far = [], 0
    for k in range(len(cuts) + 1):
        before.append(so_far)
        so_far += size.get(k, 0)
    start = F.get(F.array(*[F.lit(v).cast("bigint") for v in before]), F.col("range__"))
    return ranged.withColumn("position", F.row_number().over(W.partitionBy("range__").orderBy(order)) + start).drop("range__", "cut__")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """A column batch_id: pages of ``size`` rows in order."""
    return positions(rows, order).withColumn("batch_id", F.floor((F.col("position") - 1) / size).cast("bigint"))


def nth(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The n-th row (from 0) in order."""
    return positions(rows, order).where(F.col("position") == n + 1).drop("position")


def train_test(rows: DataFrame, order: str, share: float) -> DataFrame:
    """A column is_test: the last rows, floor(n * share) of them, in order."""
    n = rows.count()
    return positions(rows, order).withColumn("is_test", F.col("position") > n - int(n * share))


def by_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Lookup by key: each id with its row, or nulls."""
    return ids.join(rows, column, "left")


def parse_markup(raw: DataFrame, id_col: str, text_col: str, lexer: str = X.HOTEL_LEXER) -> DataFrame:
    """(id, position, word, label, bio) of each token of flat markup; a token's label is the tag before it."""
    parts = raw.select(F.col(id_col), F.posexplode(X.markup_parts(F.col(text_col), lexer)).alias("at", "part"))
    order = W.partitionBy(id_col).orderBy("at")
    marked = parts.withColumn("is_tag", X.is_tag(F.col("part")))
    labelled = marked.withColumn("label", F.coalesce(F.last(F.when(F.col("is_tag"), X.tag_of(F.col("part"))), True).over(order), F.lit("O"))).where("not is_tag")
    before = F.lag("label").over(order)
    bio = F.when(F.col("label") == "O", "O").otherwise(F.concat(F.when(before == F.col("label"), "I-").otherwise("B-"), "label"))
    return labelled.select(id_col, (F.row_number().over(order) - 1).alias("position"), F.col("part").alias("word"), "label", bio.alias("bio"))


def collect_tokens(tokens: DataFrame, id_col: str) -> DataFrame:
    """One row per mention: words and labels (BIO) in order."""
    rows = tokens.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("position", "word", "bio"))).alias("t"))
    return rows.select(id_col, F.transform("t", lambda x: x["word"]).alias("words"), F.transform("t", lambda x: x["bio"]).alias("labels"))


def labelled_citations(spark: SparkSession, path: str) -> DataFrame:
    """Mentions of a file with one tagged citation a line; ids from the line's text and place."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.sha2(F.concat_ws("|", F.input_file_name(), F.monotonically_increasing_id().cast("string"), F.col("value")), 256).alias("mention_id"), X.normalise_citation(F.col("value")).alias("sgml"))
    words = collect_tokens(parse_markup(lines, "mention_id", "sgml", r"\S+"), "mention_id")
    return lines.join(words, "mention_id", "left").select("mention_id", F.lit(False).alias("is_record"), F.lit("labelled").alias("source"), F.lit(None).cast("string").alias("true_cluster"), "sgml", "words", "labels")


def prepare(raw: DataFrame, lexer: str = X.HOTEL_LEXER, citation: bool = False, record_source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mentions of raw rows, and the rows that can't be parsed (for quarantine).  A row is a record by its source."""
    sgml = X.normalise_citation(F.col("sgml")) if citation else F.col("sgml")
    rows = raw.withColumn("sgml", sgml)
    bad = F.col("sgml").isNull() | F.col("_id").isNull() | (F.size(X.lex(F.col("sgml"), lexer)) == 0)
    good = rows.where(~bad)
    tokens = collect_tokens(parse_markup(good.select("_id", "sgml"), "_id", "sgml", lexer), "_id")
    optional = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in ("clusterId", "bibtype")]
    out = good.select("_id", "sourceId", "sgml", *optional).join(tokens, "_id").select(
        F.col("_id").alias("mention_id"), (F.col("sourceId") == F.lit(record_source)).alias("is_record") if record_source else F.lit(True).alias("is_record"),
        F.col("sourceId").alias("source"), F.col("clusterId").alias("true_cluster"), "bibtype", "sgml", "words", "labels", F.lit(None).cast("int").alias("rndkey"),
    )
    return out, rows.where(bad)


def write_mentions(mentions: DataFrame, path: str) -> None:
    """Replace a table of mentions, laid out by record or text so that scans of either read only theirs."""
    mentions.write.mode("overwrite").partitionBy("is_record").parquet(path)


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_mentions`` wrote; a scan of records or texts reads their folder alone."""
    return spark.read.schema(MENTION).parquet(path)


def dictionary(spark: SparkSession, *paths: str) -> DataFrame:
    """Entries, one a line, of the first of the paths that can be read; none gives an empty table and a warning."""
    import logging

    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            return spark.read.text(path).select(F.col("value").alias("entry")).where("entry <> ''")
        except AnalysisException:
            continue
    logging.getLogger(__name__).warning("no dictionary at %s", ", ".join(paths))
    return spark.createDataFrame([], "entry string")
