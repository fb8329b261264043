"""Fields: their configuration, values of records, and the inverted index on hash keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.functions import hashing
from reclink.functions.similarity import SOFT_THRESHOLD, STAR_THRESHOLD, cosine, dice, jaccard, jaro_winkler, jaro_winkler_of, soft_cosine, soft_cosine_of, soft_dice, soft_dice_of
from reclink.functions.text import from_bio, phrase_slice
from reclink.session import by_shuffle

__all__ = ["CITATION_FIELDS", "HOTEL_FIELDS", "Field", "field_index", "field_values", "max_lengths", "neighbours", "values_of"]
#: Measures that are column expressions; the others are Arrow functions.
MEASURES = {"jaccard": jaccard, "cosine": cosine, "dice": dice}


@dataclass(frozen=True)
class Field:
    """How a label's values are found and compared."""

    name: str
    is_key: bool = False
    sim_threshold: float = 0.0
    hash: str = "none"
    similarity: str = "cosine"
    term_threshold: float = SOFT_THRESHOLD
    fixed_length: int | None = None
    least_length: int = 0
    sim_weight: float = 10.0

    def keys(self, phrase):
        return hashing.REGISTRY[self.hash](phrase)

    def similarity_column(self, value, phrase):
        """The field's measure of two phrases, as a column."""
        if self.similarity == "jaro_winkler":
            return jaro_winkler_of(value, phrase)
        soft = {"soft_dice": soft_dice_of, "soft_cosine": soft_cosine_of}.get(self.similarity)
        return soft(value, phrase, self.term_threshold) if soft else MEASURES[self.similarity](value, phrase)

    def similar(self, a: list[str], b: list[str]) -> float:
        """Similarity of two term lists, for decoding within a task."""
        if self.similarity == "soft_dice":
            return soft_dice(a, b, self.term_threshold)
        if self.similarity == "soft_cosine":
            return soft_cosine(a, b, self.term_threshold)
        if self.similarity == "jaro_winkler":
            return jaro_winkler(" ".join(a), " ".join(b))
        x, y = set(a), set(b)
        both = len(x & y)
        bottom = {"jaccard": len(x | y), "cosine": (len(x) * len(y)) ** 0.5, "dice": (len(x) + len(y)) / 2}[self.similarity]
        return both / bottom if bottom else 0.0


OTHER = Field("O", fixed_length=1)
HOTEL_FIELDS = [OTHER, Field("hotelname", True, hash="unigram", similarity="soft_dice"), Field("localarea", hash="unigram", similarity="soft_dice"), Field("starrating", hash="char_bigram", similarity="soft_cosine", term_threshold=STAR_THRESHOLD)]


def citation_field(label: str) -> Field:
    """The citation configuration of any label."""
    special = {
        "O": OTHER,
        "author": Field("author", True, 0.7, "author", "soft_cosine"),
        "editor": Field("editor", False, 0.7, "author", "soft_cosine"),
        "title": Field("title", True, 0.8, "title", "soft_cosine"),
    }
    return special.get(label) or Field(label, similarity="soft_cosine", least_length=6 if label in ("volume", "date", "pages") else 0)


CITATION_FIELDS = [citation_field(x) for x in ("O", "author", "editor", "title", "booktitle", "journal", "volume", "date", "pages", "tech", "institution", "publisher", "series", "location")]


def segments(mentions: DataFrame) -> DataFrame:
    """(mention_id, begin, end, label, phrase) of the labelled segments."""
    rows = mentions.select("mention_id", "words", F.explode(from_bio(F.col("labels"))).alias("s"))
    return rows.select("mention_id", F.col("s.begin").alias("begin"), F.col("s.end").alias("end"), F.col("s.label").alias("label"), phrase_slice(F.col("words"), F.col("s.begin"), F.col("s.end")).alias("phrase"))


def field_values(records: DataFrame, fields: list[Field]) -> DataFrame:
    """One row per labelled segment of a record (duplicates stay): field, value_id, record_id, phrase, hash_keys, is_observed."""
    rows = segments(records).where(F.col("label").isin([f.name for f in fields if f.name != "O"]))
    keys = F.array().cast("array<string>")
    for f in fields:
        if f.hash != "none":
            keys = F.when(F.col("label") == f.name, f.keys(F.col("phrase"))).otherwise(keys)
    return rows.select(
        F.col("label").alias("field"), F.sha2(F.concat_ws("|", "label", "mention_id", F.col("begin").cast("string"), F.col("end").cast("string")), 256).alias("value_id"),
        F.col("mention_id").alias("record_id"), "phrase", keys.alias("hash_keys"), F.lit(True).alias("is_observed"),
    )


def field_index(values: DataFrame) -> DataFrame:
    """(field, hash_key, value_id, record_id)."""
    return values.select("field", F.explode("hash_keys").alias("hash_key"), "value_id", "record_id")


def max_lengths(values: DataFrame, fields: list[Field]) -> dict[str, int]:
    """Longest segment of each field: fixed, or observed and at least a floor."""
    seen = {r["field"]: r["n"] for r in values.where("is_observed").groupBy("field").agg(F.max(F.size("phrase")).alias("n")).collect()}
    return {f.name: f.fixed_length or max(f.least_length, seen.get(f.name, 0), 1) for f in fields}


def neighbours(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (phrase_id, field, value_id, record_id) of values that share a key; ``phrases`` has phrase_id, field, hash_keys."""
    probes = phrases.select("phrase_id", "field", F.explode("hash_keys").alias("hash_key"))
    return probes.join(index, ["field", "hash_key"]).select("phrase_id", "field", "value_id", "record_id").distinct()


def values_of(records: DataFrame, values: DataFrame) -> DataFrame:
    """Values of each record (field, record_id), in the order of their ids."""
    return records.select("record_id").join(by_shuffle(values), "record_id").groupBy("record_id", "field").agg(F.sort_array(F.collect_list("value_id")).alias("value_ids"))


def similarity_of(pairs: DataFrame, values: DataFrame, measure: str = "cosine") -> DataFrame:
    """``pairs`` (field, value_id, phrase) with sim to the value's phrase; a missing value raises."""
    joined = pairs.join(values.select("field", "value_id", F.col("phrase").alias("value_phrase")), ["field", "value_id"], "left")
    checked = F.when(F.col("value_phrase").isNull(), F.raise_error(F.concat(F.lit("no value "), "value_id")).cast("array<string>")).otherwise(F.col("value_phrase"))
    return joined.withColumn("sim", MEASURES[measure](checked, F.col("phrase")))
