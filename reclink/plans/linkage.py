"""Passage linkage: which texts contain which records, by hashed title keys, without comparing pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.functions.hashing import title
from reclink.functions.text import words

#: Shared keys from which on a pair is a link.
LEAST_KEYS = 10


def keys_of(rows: DataFrame, id_col: str, text_col: str, keys=title) -> DataFrame:
    """(id, hash_key), distinct within a row because the key functions are."""
    return rows.select(F.col(id_col), F.explode(keys(words(F.col(text_col)))).alias("hash_key"))


def shared_keys(texts: DataFrame, records: DataFrame, text_id: str, record_id: str, text_col: str = "text", keys=title) -> DataFrame:
    """(text_id, record_id, n_shared) of pairs that share a key.

    Texts' keys that no record has are dropped by the join itself; partial counts are made before pairs are shuffled.
    """
    left, right = keys_of(texts, text_id, text_col, keys), keys_of(records, record_id, text_col, keys)
    return left.join(right, "hash_key").groupBy(text_id, record_id).agg(F.count(F.lit(1)).alias("n_shared"))


def passage_links(texts: DataFrame, records: DataFrame, text_id: str = "doc_id", record_id: str = "item_id", least: int = LEAST_KEYS) -> DataFrame:
    return shared_keys(texts, records, text_id, record_id).where(F.col("n_shared") >= least)


def verified(links: DataFrame, texts: DataFrame, records: DataFrame, text_id: str = "doc_id", record_id: str = "item_id") -> DataFrame:
    """Links with is_contained: whether the text contains the record word for word.  Only linked texts are read again."""
    joined = links.join(texts.select(text_id, F.col("text").alias("own")), text_id).join(records.select(record_id, F.col("text").alias("part")), record_id)
    return joined.select(text_id, record_id, "n_shared", _contains(F.col("own"), F.col("part")).alias("is_contained"))


def _contains(text: Column, part: Column) -> Column:
    return F.contains(text, part)


def passage_linkage(texts: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, is_contained) of the links."""
    return verified(passage_links(texts, records), texts, records)
