"""Temperature mixing of sources, in DataFrame operations alone.

A source's weight is its share of all tokens (words) to the power of an exponent between 0 (all alike) and 1 (as they are),
normalised.  The exponent is the largest whose weights reach a target entropy (a share of the highest possible one), or a
larger one if otherwise a source would be repeated more than ``max_repeats`` times.  Both measures are monotone, so the
exponent is bisected: one aggregation over the table of sources evaluates all the points of several halvings at once.

The weights times a token budget are the sources' budgets.  A source gives each of its documents as many whole times as
fits, and the rest of its budget goes to a permutation of its documents by MD5 of id and seed, as long as they fit.  The
permutation is dealt into ``BLOCKS`` blocks of its leading digits: tokens are summed by source and block first, and only
within a block are documents put in order, so a source that holds a third of all rows is cut into as many tasks.

Defined cases: null texts have no tokens; a null source is a source; a source without tokens has no weight and no copies;
repeated rows are documents like any other (equal ones may change places); an empty table gives an empty result; one source
keeps its share whatever the target; extra columns are kept, but ``mix`` replaces those named like its results (``mixture`` keeps them too).
A source's rest may be left short by less than the first document of the permutation that doesn't fit.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reclink.llm.words import exact, numbered, restored
from reclink.session import written

ENTROPY, MAX_REPEATS, SEED, BLOCKS_DIGITS, LEVELS, ROUNDS = 0.95, 4.0, 17, 3, 4, 10


def n_words(text: Column) -> Column:
    """Words of a text: runs of characters other than space and the control characters 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def exponent(sources: DataFrame, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget_factor: float = 1.0) -> float:
    """The mixing exponent, to 6 decimals, for a table of (tokens) by source."""
    total = sources.agg(F.sum("tokens").alias("total")).first()["total"] or 0
    q = written(sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(max(1, total)))).alias("q")), "mixing-shares")
    many = q.count()
    if many < 2:
        return 1.0
    goal = entropy * log(many)

    def measures(points: list[float]) -> list[tuple[float, float]]:
        cols = []
        for i, a in enumerate(points):
            p = F.pow("q", F.lit(a))
            cols += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log("q")).alias(f"l{i}"), F.max(p / F.col("q")).alias(f"m{i}")]
        row = q.agg(*cols).first()
        # H = ln Z - a * sum(p ln q) / Z; most repeated: budget * w / tokens
        return [(log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"], budget_factor * row[f"m{i}"] / row[f"z{i}"]) for i, a in enumerate(points)]

    entropy_at_one, most_at_one = measures([1.0])[0]
    low = {"entropy": 0.0, "repeats": 0.0}
    high = {"entropy": 1.0, "repeats": 1.0}
    steps = 1 << LEVELS
    for _ in range(ROUNDS):
        grid = {k: [low[k] + (high[k] - low[k]) * i / steps for i in range(1, steps)] for k in low}
        found = measures(grid["entropy"] + grid["repeats"])
        # entropy falls with the exponent: keep the last point that reaches the goal; repeats fall too: the first that is within the limit
        reach = [h >= goal for h, _ in found[: steps - 1]]
        within = [r <= max_repeats for _, r in found[steps - 1 :]]
        cut = sum(reach)
        points = [low["entropy"], *grid["entropy"], high["entropy"]]
        low["entropy"], high["entropy"] = points[cut], points[cut + 1]
        cut = len(within) - sum(within)
        points = [low["repeats"], *grid["repeats"], high["repeats"]]
        low["repeats"], high["repeats"] = points[cut], points[cut + 1]
    by_entropy = 1.0 if entropy_at_one >= goal else low["entropy"]
    by_repeats = 1.0 if most_at_one > max_repeats else high["repeats"] if high["repeats"] > 1e-9 else 0.0
    return round(max(by_entropy, by_repeats), 6)


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget_factor: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` with mix_tokens, mix_weight (of the source) and mix_copies (times that the document is in the mixture, also 0)."""
    extra = ("mix_tokens", "mix_weight", "mix_copies")
    docs = docs.select(*exact([c for c in docs.columns if c not in extra]))
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    keyed = docs.withColumns({"mix_tokens": n_words(F.col(f"`{text_col}`")), "mix__s": F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null")), "mix__h": key})
    keyed = keyed.withColumn("mix__b", F.substring("mix__h", 1, BLOCKS_DIGITS))
    blocks = written(keyed.groupBy("mix__s", "mix__b").agg(F.sum("mix_tokens").alias("tokens")), "mixing-blocks")
    sources = blocks.groupBy("mix__s").agg(F.sum("tokens").alias("tokens"))
    a = exponent(sources, entropy, max_repeats, budget_factor)
    totals = sources.where("tokens > 0").agg(F.sum("tokens").alias("total")).first()["total"] or 0
    power = F.pow(F.col("tokens") / F.lit(float(max(1, totals))), F.lit(a))
    z = sources.where("tokens > 0").agg(F.sum(power).alias("z")).first()["z"] or 1.0
    weights = sources.select(
        "mix__s", F.when(F.col("tokens") > 0, F.round(power / z, 9)).otherwise(0.0).alias("mix_weight"), F.col("tokens").alias("source_tokens")
    ).withColumn("budget", F.floor(F.col("mix_weight") * totals * budget_factor))
    whole = F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens"))).otherwise(0)
    before = F.sum("tokens").over(W.partitionBy("mix__s").orderBy("mix__b").rowsBetween(W.unboundedPreceding, -1))
    plan = written(blocks.withColumn("before", F.coalesce(before, F.lit(0))).join(weights, "mix__s").withColumn("whole", whole.cast("bigint")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_tokens")), "mixing-plan")
    own = [F.col(c).alias(f"mix__{c}") for c in ("before", "whole", "rest")]
    joined = keyed.join(plan.select("mix__s", "mix__b", "mix_weight", *own), ["mix__s", "mix__b"])
    so_far = F.sum("mix_tokens").over(W.partitionBy("mix__s", "mix__b").orderBy("mix__h", "mix_tokens").rowsBetween(W.unboundedPreceding, 0))
    more = (F.col("mix__before") + so_far <= F.col("mix__rest")) & (F.col("mix_weight") > 0)
    return joined.withColumn("mix_copies", (F.col("mix__whole") + more.cast("int")).cast("bigint")).select(*exact(docs.columns), *extra)


def mixture(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixture itself, in the columns of ``docs``, whatever their names: each document as many times as it was chosen."""
    own, names = numbered(docs)
    mixed = mix(own, names[source_col], names[id_col], names[text_col], **options).where("mix_copies > 0")
    return restored(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mix_copies")))), names)
