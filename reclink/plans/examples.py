"""Mentions with the features that learning and decoding read: the hotel and the citation kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.functions import features as T
from reclink.functions.phrases import features_with_phrases, phrases, with_marks
from reclink.functions.text import from_bio
from reclink.session import by_shuffle


@dataclass(frozen=True)
class Lexicon:
    """A list of words (by token) or of phrases (by match in order)."""

    name: str
    entries: DataFrame
    lower: bool = True
    phrases: bool = False


def hotel_examples(mentions: DataFrame) -> DataFrame:
    """Adds word_features, feats, ends: every end is possible, neighbours don't count."""
    return mentions.withColumns({
        "word_features": F.transform("words", T.simplify_hotel), "feats": F.transform("words", T.hotel_features),
        "ends": F.array_repeat(F.lit(True), F.size("words") + 1),
    })


def citation_features(token: Column) -> Column:
    """Simplified text, shape and patterns of a token."""
    return F.concat(F.array(T.token_text(token, "SIMPLIFIED=", T.simplify_citation), F.concat(F.lit("SHAPE="), T.shape(token))), T.pattern_features(token))


def citation_examples(mentions: DataFrame, lexicons: list[Lexicon] | None = None, words_known: DataFrame | None = None, offsets: tuple[int, ...] = T.OFFSETS) -> DataFrame:
    """Adds word_features, feats (with those of neighbours for texts) and ends.

    A token of a word lexicon has its mark; lexicons are joined by key on the distinct tokens that may be in one.  Word features that
    ``words_known`` (term) lacks become one unknown term.
    """
    out = mentions.withColumns({"word_features": F.transform("words", T.simplify_citation), "feats": F.transform("words", citation_features), "ends": T.possible_ends(F.col("words"))})
    for lexicon in lexicons or []:
        if lexicon.phrases:
            marked = with_marks(out, phrases(lexicon.entries, lower=lexicon.lower), lexicon.name, lexicon.lower)
            out = marked.withColumn("feats", features_with_phrases(F.col("feats"), F.col("phrase_marks"))).drop("phrase_marks")
    words = [x for x in lexicons or [] if not x.phrases]
    if words:
        tokens = out.select("mention_id", F.posexplode("words").alias("position", "token"))
        marked = None
        for lexicon in words:
            own = T.lexicon_features(tokens, lexicon.entries, lexicon.name, lexicon.lower).where("in_lexicon is not null").select("mention_id", "position", "in_lexicon")
            marked = own if marked is None else marked.unionByName(own)
        per = marked.groupBy("mention_id", "position").agg(F.sort_array(F.collect_list("in_lexicon")).alias("m")).groupBy("mention_id").agg(F.map_from_entries(F.collect_list(F.struct("position", "m"))).alias("marks"))
        out = out.join(by_shuffle(per), "mention_id", "left").withColumn("feats", F.transform("feats", lambda f, i: F.concat(f, F.coalesce(F.try_element_at("marks", i), F.array().cast("array<string>"))))).drop("marks")
    if offsets:
        out = out.withColumn("feats", F.when(F.col("is_record"), F.col("feats")).otherwise(T.conjunctions(F.col("feats"), offsets)))
    if words_known is not None:
        out = with_unknown(out, words_known)
    return out


def with_unknown(examples: DataFrame, known: DataFrame) -> DataFrame:
    """Word features that ``known`` (term) lacks become the unknown term."""
    tokens = examples.select("mention_id", F.posexplode("word_features").alias("position", "term"))
    joined = tokens.join(known.select("term").distinct().withColumn("is_known", F.lit(True)), "term", "left")
    term = F.when(F.col("is_known"), F.col("term")).otherwise(F.lit(T.OOV))
    per = joined.groupBy("mention_id").agg(F.sort_array(F.collect_list(F.struct("position", term.alias("term")))).alias("w")).select("mention_id", F.col("w.term").alias("known_features"))
    return examples.join(by_shuffle(per), "mention_id", "left").withColumn("word_features", F.coalesce("known_features", F.array().cast("array<string>"))).drop("known_features")


def only_known(examples: DataFrame, known: DataFrame) -> DataFrame:
    """Features (feats) that ``known`` (term) has, in their order; the others go."""
    cells = examples.select("mention_id", F.posexplode("feats").alias("position", "f")).select("mention_id", "position", F.posexplode("f").alias("place", "term"))
    kept = cells.join(known.select("term").distinct(), "term", "left_semi")
    tokens = kept.groupBy("mention_id", "position").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("f"))
    per = tokens.groupBy("mention_id").agg(F.map_from_entries(F.collect_list(F.struct("position", F.col("f.term").alias("f")))).alias("known_feats"))
    joined = examples.join(by_shuffle(per), "mention_id", "left")
    return joined.withColumn("feats", F.transform("feats", lambda f, i: F.coalesce(F.try_element_at("known_feats", i), F.array().cast("array<string>")))).drop("known_feats")


def endpoint_audit(examples: DataFrame) -> DataFrame:
    """One row: ends of labelled segments (not O), and how many of them are possible ends."""
    ends = examples.select("ends", F.explode(F.filter(from_bio(F.col("labels")), lambda s: s["label"] != "O")).alias("s"))
    out = ends.agg(F.count(F.lit(1)).alias("n_ends"), F.count_if(F.get("ends", F.col("s.end"))).alias("n_possible"))
    return out.withColumn("share", F.try_divide(F.col("n_possible").cast("double"), F.col("n_ends")))
