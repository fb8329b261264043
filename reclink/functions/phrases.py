"""Phrase lexicons: which tokens stand in a phrase of a list.

Matching goes from left to right, without overlap, and takes the shortest phrase that begins at a token.  A phrase that has
another one as its beginning so never matches, and is left out of the table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.functions.text import lex

#: Most phrases that ``matcher`` takes to the tasks; ``with_marks`` matches longer lists by joins, with the same result.
MOST_PHRASES = 200_000


def phrases(entries: DataFrame, lexer: str = r"\S+", lower: bool = False) -> DataFrame:
    """(phrase) of each entry that has a token, distinct."""
    text = F.lower("entry") if lower else F.col("entry")
    return entries.select(lex(text, lexer).alias("phrase")).where("size(phrase) > 0").distinct()


def contains(sequences: DataFrame, lexicon: DataFrame, column: str = "words", lower: bool = False) -> DataFrame:
    """``sequences`` with in_lexicon: whether the whole sequence is a phrase; an equi-join on the joined tokens."""
    key = F.array_join(column, "\u0001")
    keys = lexicon.select(F.array_join("phrase", "\u0001").alias("phrase__key")).distinct().withColumn("in_lexicon", F.lit(True))
    marked = sequences.withColumn("phrase__key", F.lower(key) if lower else key).join(keys, "phrase__key", "left")
    return marked.withColumn("in_lexicon", F.coalesce("in_lexicon", F.lit(False))).drop("phrase__key")


def matcher(lexicon: DataFrame, name: str, lower: bool = False):
    """A function of a words column: for each token, ``name`` if it stands in a matched phrase, else null."""
    n = lexicon.count()
    if n > MOST_PHRASES:
        raise ValueError(f"{n} phrases are more than {MOST_PHRASES}: use with_marks")
    known = {tuple(r["phrase"]) for r in lexicon.collect()}
    longest = max(map(len, known), default=0)

    @F.pandas_udf("array<string>")
    def mark(column: pd.Series) -> pd.Series:
        out = []
        for words in column:
            words = [] if words is None else [w.lower() if lower else w for w in words]
            marks, i = [None] * len(words), 0
            while i < len(words):
                size = next((k for k in range(1, min(longest, len(words) - i) + 1) if tuple(words[i : i + k]) in known), 0)
                marks[i : i + size] = [name] * size
                i += max(size, 1)
            out.append(marks)
        return pd.Series(out)

    return lambda words: mark(words)


def phrase_starts(sequences: DataFrame, lexicon: DataFrame, longest: int, id_col: str = "mention_id", column: str = "words", lower: bool = False) -> DataFrame:
    """(id, begin, end) of the shortest phrase at each token, before overlaps go: an equi-join of n-grams, for lists of any length."""
    words = F.transform(F.col(column), F.lower) if lower else F.col(column)
    grams = sequences.select(F.col(id_col), words.alias("w")).select(id_col, F.posexplode("w").alias("begin", "_"), "w").select(id_col, "begin", "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("k"))
    grams = grams.where(F.col("begin") + F.col("k") <= F.size("w")).select(id_col, "begin", "k", F.array_join(F.slice("w", F.col("begin") + 1, F.col("k")), "\u0001").alias("key"))
    keys = lexicon.select(F.array_join("phrase", "\u0001").alias("key")).distinct()
    return grams.join(keys, "key").groupBy(id_col, "begin").agg(F.min(F.col("begin") + F.col("k")).alias("end"))


def with_marks(sequences: DataFrame, lexicon: DataFrame, name: str, lower: bool = False, id_col: str = "mention_id", column: str = "words", most: int = MOST_PHRASES) -> DataFrame:
    """``sequences`` with phrase_marks, the marks of ``matcher``; lists of more than ``most`` phrases are joined, and matches that overlap an earlier one go. Ids must differ."""
    if lexicon.count() <= most:
        return sequences.withColumn("phrase_marks", matcher(lexicon, name, lower)(F.col(column)))
    longest = lexicon.agg(F.max(F.size("phrase"))).first()[0]
    places = phrase_starts(sequences, lexicon, longest, id_col, column, lower).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("places__"))
    kept = F.aggregate(
        "places__", F.array().cast("array<struct<begin:int,end:int>>"),
        lambda have, p: F.when((F.size(have) == 0) | (F.element_at(have, -1)["end"] <= p["begin"]), F.concat(have, F.array(p))).otherwise(have),
    )
    inside = F.flatten(F.transform(kept, lambda p: F.sequence(p["begin"], p["end"] - 1)))
    marked = sequences.join(places.select(id_col, F.map_from_arrays(inside, F.transform(inside, lambda i: F.lit(name))).alias("marks__")), id_col, "left")
    marks = F.transform(column, lambda w, i: F.try_element_at("marks__", i))
    return marked.withColumn("phrase_marks", F.coalesce(marks, F.array().cast("array<string>"))).drop("marks__")


def features_with_phrases(feats: Column, marks: Column) -> Column:
    """Feature arrays with the marks of their tokens."""
    return F.zip_with(feats, marks, lambda f, m: F.when(m.isNull(), f).otherwise(F.concat(f, F.array(m))))
