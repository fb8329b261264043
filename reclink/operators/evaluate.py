"""Post-processing, evaluation, and text formats of segmentations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.functions.text import let, valid_word
from reclink.session import by_shuffle

SEGMENTS = "array<struct<begin:int,end:int,label:string>>"
_ONE_MARK = r"\A[,.;:?!()\"\-'`]+\z"


def all_punctuation(word: Column) -> Column:
    return ~valid_word(word)


def adjusted(words: Column, segments: Column) -> Column:
    """Segments without punctuation tokens at their ends, which become O; a segment of punctuation alone is one O segment; O segments stay."""
    o = F.lit("O")

    def one(b: Column, e: Column, label: Column) -> Column:
        return F.struct(b.cast("int").alias("begin"), e.cast("int").alias("end"), label.alias("label"))

    def edge(b: Column, e: Column) -> Column:
        at = F.when(b < e, F.sequence(b, e - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: one(i, i + 1, o))

    def parts(s: Column) -> Column:
        kept = F.concat(edge(s["b"], s["first"]), F.array(one(s["first"], s["last"] + 1, s["x"])), edge(s["last"] + 1, s["e"]))
        return F.when(s["x"] == "O", F.array(one(s["b"], s["e"], s["x"]))).when(s["first"].isNull(), F.array(one(s["b"], s["e"], o))).otherwise(kept)

    def all_of(w: Column, found: Column) -> Column:
        def bounds(s: Column) -> Column:
            real = F.filter(F.sequence(s["begin"], s["end"] - 1), lambda i: valid_word(F.get(w, i)))
            return F.struct(s["begin"].alias("b"), s["end"].alias("e"), s["label"].alias("x"), F.array_min(real).alias("first"), F.array_max(real).alias("last"))

        return F.flatten(F.transform(F.transform(found, bounds), parts))

    return let(all_of, words, segments)


def formatted(segments: Column) -> Column:
    """label[begin, end) of each segment."""
    return F.array_join(F.transform(segments, lambda s: F.concat(s["label"], F.lit("["), s["begin"].cast("string"), F.lit(", "), s["end"].cast("string"), F.lit(")"))), " ")


def ww_text(words: Column, segments: Column) -> Column:
    """Words by number, then the segments that aren't O with an inclusive end."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    lines = F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit("\t"), quoted(w)))
    spans = F.transform(F.filter(segments, lambda s: s["label"] != "O"), lambda s: F.concat(s["begin"].cast("string"), F.lit("\t"), (s["end"] - 1).cast("string"), F.lit("\t"), quoted(s["label"])))
    return F.concat(F.lit(">>\n>word\n"), F.array_join(lines, "\n"), F.lit("\n\n>mention\n"), F.array_join(spans, "\n"), F.lit("\n"))


def write_ww(rows: DataFrame, path: str) -> None:
    """A text file of the ``ww`` column, a blank line after each mention."""
    rows.select("ww").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def label_at(segments: Column, n: Column) -> Column:
    """Label of each of ``n`` tokens."""
    labels = F.flatten(F.transform(segments, lambda s: F.array_repeat(s["label"], s["end"] - s["begin"])))
    return F.slice(labels, F.lit(1), n)


def appended(segments: Column, label: Column, length: Column) -> Column:
    """``segments`` with one of ``length`` words after the last."""
    def add(own: Column, size: Column, name: Column) -> Column:
        begin = F.coalesce(F.get(own, F.size(own) - 1)["end"], F.lit(0))
        return F.concat(own, F.array(F.struct(begin.alias("begin"), (begin + size).alias("end"), name.alias("label"))))

    return let(add, segments.cast(SEGMENTS), length.cast("int"), label)


def prepended(segments: Column, label: Column, length: Column) -> Column:
    """``segments`` with one of ``length`` words before the first; the others move on."""
    first = F.array(F.struct(F.lit(0).alias("begin"), length.cast("int").alias("end"), label.alias("label")))
    moved = F.transform(segments, lambda s: F.struct((s["begin"] + length).cast("int").alias("begin"), (s["end"] + length).cast("int").alias("end"), s["label"].alias("label")))
    return F.concat(first, moved)


def segment_at(segments: Column, position: Column) -> Column:
    """The segment that holds a token; null beyond all."""
    return F.get(F.filter(segments, lambda s: (s["begin"] <= position) & (position < s["end"])), F.lit(0))


def has_segment(segments: Column, begin: Column, end: Column, label: Column) -> Column:
    """Whether there is just this segment."""
    return F.exists(segments, lambda s: (s["begin"] == begin) & (s["end"] == end) & (s["label"] == label))


def valid_segments(segments: Column) -> Column:
    """Whether segments are in order, not empty, and don't overlap."""
    return let(lambda own: F.forall(F.transform(own, lambda s, i: (s["begin"] < s["end"]) & ((i == 0) | (F.get(own, i - 1)["end"] <= s["begin"]))), lambda x: x), segments)


def token_scores(rows: DataFrame) -> DataFrame:
    """Per label: tokens with it in truth, in prediction, in both, and precision, recall, F1; ``rows``: (truth, guess) arrays of segments."""
    n = F.element_at("truth", -1)["end"]
    pairs = rows.where("size(truth) > 0").select(F.explode(F.arrays_zip(label_at(F.col("truth"), n).alias("t"), label_at(F.col("guess"), n).alias("g"))).alias("p"))
    both = pairs.select(F.col("p.0").alias("t"), F.col("p.1").alias("g")) if "0" in pairs.schema["p"].dataType.fieldNames() else pairs.select(F.col("p.t").alias("t"), F.col("p.g").alias("g"))
    sides = both.select(F.explode(F.array_distinct(F.array("t", "g"))).alias("label"), "t", "g")
    out = sides.where("label is not null").groupBy("label").agg(F.count_if(F.col("t") == F.col("label")).alias("n_true"), F.count_if(F.col("g") == F.col("label")).alias("n_guess"), F.count_if((F.col("t") == F.col("label")) & (F.col("g") == F.col("label"))).alias("n_both"))
    return prf(out, "n_both", "n_guess", "n_true")


def span_scores(rows: DataFrame) -> DataFrame:
    """One row: exact spans (not O) in truth, in prediction, in both, with precision, recall and F1."""
    spans = lambda c: F.filter(F.col(c), lambda s: s["label"] != "O")
    out = rows.agg(F.sum(F.size(spans("truth"))).alias("n_true"), F.sum(F.size(spans("guess"))).alias("n_guess"), F.sum(F.size(F.array_intersect(spans("truth"), spans("guess")))).alias("n_both"))
    return prf(out, "n_both", "n_guess", "n_true")


def prf(rows: DataFrame, both: str, guess: str, true: str) -> DataFrame:
    p, r = F.try_divide(F.col(both).cast("double"), F.col(guess)), F.try_divide(F.col(both).cast("double"), F.col(true))
    return rows.withColumns({"precision": p, "recall": r}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def coref_scores(rows: DataFrame) -> DataFrame:
    """One row over (true_cluster, guess_cluster): literal counts take two missing clusters as correct, corrected ones don't."""
    same = F.col("true_cluster").eqNullSafe(F.col("guess_cluster"))
    out = rows.agg(
        F.count(F.lit(1)).alias("n_texts"), F.count("true_cluster").alias("possible"), F.count("guess_cluster").alias("predicted"),
        F.count_if(same).alias("correct_literal"), F.count_if(same & F.col("true_cluster").isNotNull()).alias("correct"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    out = out.withColumns({
        "accuracy": ratio("correct_literal", "n_texts"), "precision_literal": ratio("correct_literal", "predicted"), "recall_literal": ratio("correct_literal", "possible"),
        "precision": ratio("correct", "predicted"), "recall": ratio("correct", "possible"),
    })
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def with_clusters(predictions: DataFrame, records: DataFrame) -> DataFrame:
    """(mention_id, true_cluster, guess_cluster): cluster of each text's chosen record (record_id), null without one."""
    of = records.select(F.col("mention_id").alias("record_id"), F.col("true_cluster").alias("guess_cluster"))
    return predictions.join(by_shuffle(of), "record_id", "left").select("mention_id", "true_cluster", "guess_cluster")
