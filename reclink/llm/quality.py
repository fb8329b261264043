"""Quality by hierarchical empirical Bayes: a document classifier, and posteriors of its host and path.

1. A logistic regression over features of the whole text (shares of kinds of characters, repetition, word and line shapes)
   is fitted to a bounded sample of labelled rows (``TRAIN_DOCS``, by a hash of the id) and gives each document its own
   evidence p.
2. Expected good documents (the sum of p) are counted for each host and each path by grouped aggregation over all
   documents, whatever their labels.
3. A host's share is shrunk towards the global share, a path's towards its host's, as much as the spread between hosts (by
   moments) says: (good + k * prior) / (n + k).  A document's own p is left out of its path's count.
4. The score adds the path's log odds, relative to the global ones and weighted by ``SITE_WEIGHT``, to the document's.

Groups are pre-aggregated before they are shuffled, and a path that holds a third of all rows is one row of the table that is
joined back, by broadcast if it has at most ``BROADCAST_PATHS`` rows (counted first), else by a shuffled join.

Defined cases: a null or empty text has all features zero; null hosts and paths are groups of their own; without labels of
both classes every document has the labels' share (1 without labels) as evidence; labels of null are ignored, of several of
one document the highest counts; of rows that repeat a labelled id the one with the first text is learnt from; repeated rows are scored each; extra columns are kept, but ``assess`` replaces those named like
its results (``accepted`` keeps them too).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.llm.logistic import fit as fit_weights
from reclink.llm.logistic import sigmoid
from reclink.llm.toxicity import held_out
from reclink.llm.words import exact, numbered, restored
from reclink.session import written

TRAIN_DOCS, SITE_WEIGHT, BROADCAST_PATHS, THRESHOLD = 12_000, 0.5, 100_000, 0.5
_KINDS = np.zeros((9, 256))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"!?", b"#$%&*@^~+=<>", b".,;:", b"\n", bytes(range(128, 256)), b"{}[]()\\/_\"'")):
    _KINDS[_i, list(_chars)] = 1
N_FEATURES = 18


def features(text: str) -> list[float]:
    """Shares and shapes of a text; zeros for an empty one."""
    data = text.encode()
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    kinds = _KINDS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    distinct = len(set(words))
    lines = text.split("\n")
    repeats = sum(map(eq, words, words[1:])) / n
    second = sum(map(eq, words, words[2:])) / n
    pairs = len(set(zip(words, words[1:]))) / n
    log_n = np.log1p(n)
    return [*kinds.tolist(), repeats, second, distinct / n, pairs, np.log1p(distinct) / log_n, len(set(lines)) / len(lines), min(len(data) / n, 30) / 10, log_n / 5, 1.0 / n]


@dataclass
class Classifier:
    weights: list[float] | None
    base: float
    centre: list[float]
    scale: list[float]

    def evidence(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        w = np.array(self.weights)
        return sigmoid((x - self.centre) / self.scale @ w[:-1] + w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> Classifier:
    """Fit the document classifier on a bounded sample of labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, train_docs / max(1, n)) * (1 << 20)) + 1)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x or "") for x in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Classifier(None, float(y[0]) if len(y) else 1.0, [0.0] * N_FEATURES, [1.0] * N_FEATURES)
    x = np.array([r["x"] for r in rows], float)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    return Classifier(fit_weights((x - centre) / scale, y).tolist(), float(y.mean()), centre.tolist(), scale.tolist())


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def assess(docs: DataFrame, model: Classifier, host: Column, path: Column, text_col: str = "text") -> DataFrame:
    """``docs`` with q_evidence, q_host, q_path (posterior shares of good documents), q_score and q_keep."""

    @F.pandas_udf("double")
    def evidence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(model.evidence(np.array([features(x or "") for x in series], float).reshape(-1, N_FEATURES)))

    extra = ("q_evidence", "q_host", "q_path", "q_score", "q_keep")
    docs = docs.select(*exact([c for c in docs.columns if c not in extra]))
    seen = docs.withColumns({"q__h": host, "q__p": path}).withColumn("q_evidence", evidence(F.col(f"`{text_col}`")))
    paths = seen.groupBy("q__h", "q__p").agg(F.sum("q_evidence").alias("good"), F.count(F.lit(1)).alias("n"))
    paths = written(paths, "quality-paths")
    hosts = paths.groupBy("q__h").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("paths")).first()
    n, share = total["n"] or 0, (total["good"] or 0.0) / max(1, total["n"] or 0)
    spread = hosts.agg(F.sum(F.col("host_n") * F.pow(F.col("host_good") / F.col("host_n") - share, 2)).alias("s"), F.count(F.lit(1)).alias("h")).first()
    # moments: what the hosts' shares vary beyond chance; none left means full shrinkage
    between = (spread["s"] or 0.0) / max(1, n) - share * (1 - share) * (spread["h"] or 0) / max(1, n)
    k = min(1e6, max(1.0, share * (1 - share) / between - 1)) if between > 0 else 1e6
    prior = hosts.select(F.col("q__h").alias("h"), ((F.col("host_good") + k * share) / (F.col("host_n") + k)).alias("q_host"))
    shrunk = paths.join(prior, F.col("q__h").eqNullSafe(F.col("h"))).select(F.col("q__h").alias("q__h2"), F.col("q__p").alias("q__p2"), F.col("good").alias("q__good"), F.col("n").alias("q__n"), "q_host")
    if total["paths"] <= BROADCAST_PATHS:
        shrunk = F.broadcast(shrunk)
    joined = seen.join(shrunk, F.col("q__h").eqNullSafe(F.col("q__h2")) & F.col("q__p").eqNullSafe(F.col("q__p2")))
    q_path = (F.col("q__good") - F.col("q_evidence") + k * F.col("q_host")) / (F.col("q__n") - 1 + k)
    logit = _logit(F.col("q_evidence")) + SITE_WEIGHT * (_logit(q_path) - _logit(F.lit(float(share))))
    scored = joined.withColumns({"q_path": q_path, "q_score": 1 / (1 + F.exp(-logit))})
    return scored.withColumn("q_keep", F.col("q_score") >= THRESHOLD).select(*exact(docs.columns), *extra)


def accepted(docs: DataFrame, model: Classifier, host: str = "source", path: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, in its columns, whatever their names."""
    own, names = numbered(docs)
    return restored(assess(own, model, F.col(names[host]), F.col(names[path]), names[text_col]).where("q_keep"), names)
