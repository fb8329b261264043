"""Learning of parameters: expectation-maximisation, L-BFGS and stochastic steps, as iterated Spark jobs.

Parameters stay tables (model, kind, label, key, value) throughout: an iteration joins features with them, decodes, and sums
counts by key, so vocabularies of any size work.  L-BFGS keeps its vectors as columns of one such table and takes all inner
products of an iteration in one aggregation; only these few numbers reach the driver.  Each iteration's table is written to
the shared folder, which cuts the lineage.  Asynchronous updates become synchronous mini-batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.config import OTHER_EMISSION, SELF_TRANSITION, SMOOTHING, Options
from reclink.operators.constraints import Domain, constrained_expectations
from reclink.operators.lattice import Chain, counted, counts_of, expectations, scored
from reclink.operators.params import normalised, sum_counts
from reclink.session import dropped, written

KEYS = ["model", "kind", "label", "key"]
PLAIN = Domain(lambda words, labels, depth, ends: [], 0, 0.0)


def parameter_keys(examples: DataFrame, labels: list[str], least_word: int = 1, least_feature: int = 1) -> DataFrame:
    """Every (model, kind, label, key) that parameters may have: labels with labels, and with the terms that are frequent enough."""
    names = F.array(*map(F.lit, labels))
    words = examples.select(F.explode("word_features").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_word)
    feats = examples.select(F.explode(F.flatten("feats")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_feature)
    one = lambda rows, model: rows.select(F.lit(model).alias("model"), F.lit("E").alias("kind"), F.explode(names).alias("label"), "key")
    chain = examples.sparkSession.createDataFrame(
        [(m, "S", x, None) for m in ("gen", "disc") for x in labels] + [(m, "T", x, y) for m in ("gen", "disc") for x in labels for y in labels], "model string, kind string, label string, key string"
    )
    return one(words, "gen").unionByName(one(feats, "disc")).unionByName(chain)


def initial(keys: DataFrame, smoothing: float = SMOOTHING, self_transition: float = SELF_TRANSITION, other_emission: float = 0.0) -> DataFrame:
    """Even distributions of the generative model, whose labels other than O keep to themselves a little less (and whose O emissions may count more); weights of 0."""
    loop = (F.col("kind") == "T") & (F.col("label") == F.col("key")) & (F.col("label") != "O")
    other = (F.col("kind") == "E") & (F.col("label") == "O")
    value = F.when(F.col("model") == "disc", F.lit(0.0)).otherwise(F.lit(1.0 + smoothing) + F.when(loop, F.lit(self_transition)).otherwise(0.0) + F.when(other, F.lit(other_emission)).otherwise(0.0))
    rows = keys.withColumn("value", value)
    return normalised(rows.where("model = 'gen'"), 0.0).select(*KEYS, "value").unionByName(rows.where("model = 'disc'").select(*KEYS, "value"))


def hotel_initial(keys: DataFrame) -> DataFrame:
    return initial(keys, other_emission=OTHER_EMISSION)


def filled(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """``counts`` with a 0 for every other key."""
    k, c = keys.alias("k"), counts.alias("c")
    on = [F.col(f"k.{x}").eqNullSafe(F.col(f"c.{x}")) for x in KEYS]
    return k.join(c, on, "left").select(*[F.col(f"k.{x}") for x in KEYS], F.coalesce(F.col("c.value"), F.lit(0.0)).alias("value"))


@dataclass
class Setting:
    """What learning works on: examples (features of mentions), keys, labels, longest segments, options."""

    examples: DataFrame
    keys: DataFrame
    labels: list[str]
    longest: dict[str, int]
    options: Options = field(default_factory=Options)
    domain: Domain = field(default_factory=lambda: PLAIN)
    candidates: DataFrame | None = None
    state: DataFrame | None = None

    def records(self) -> DataFrame:
        return self.examples.where("is_record")

    def texts(self) -> DataFrame:
        return self.examples.where("not is_record")


def _total(posteriors: DataFrame, examples: DataFrame) -> float:
    rows = posteriors.where("error is null")
    if "copies" in examples.columns:
        rows = rows.join(examples.select("mention_id", "copies"), "mention_id").withColumn("log_z", F.col("log_z") * F.col("copies"))
    return float(rows.agg(F.coalesce(F.sum("log_z"), F.lit(0.0)).alias("z")).first()["z"])


def failures(posteriors: DataFrame) -> DataFrame:
    """Mentions that were left out, with the reason."""
    return posteriors.where("error is not null").select("mention_id", "error")


class Counts:
    """A sum of scaled expectations with their log partitions."""

    def __init__(self, setting: Setting, params: DataFrame):
        self.setting, self.params, self.chain = setting, params, Chain.of(params, setting.labels)
        self.parts: list[DataFrame] = []
        self.log_z = 0.0

    def add(self, rows: DataFrame, use_gen: bool, use_disc: bool, gen: float, disc: float, sign: float = 1.0, true_only: bool | None = False, joint: bool = False, constrained: bool = False) -> None:
        """Expectations under the models in use (and the domain's constraints); ``gen`` and ``disc`` scale the counts, ``sign`` both and the log partition."""
        if rows.isEmpty():
            return
        s = self.setting
        if not (joint or constrained):
            rows = written(counted(rows), "counted")
        ready = scored(rows, self.params, s.labels, use_gen, use_disc)
        if joint or constrained:
            alone = not joint or s.candidates is None
            if not alone:
                ready = ready.join(s.candidates.select("mention_id", "candidates"), "mention_id", "left")
            found = constrained_expectations(ready, self.chain, s.longest, s.domain, s.state, use_gen, use_disc, alone)
        else:
            found = expectations(ready, self.chain, s.longest, use_gen, use_disc, true_only)
        found = written(found, "expectations")
        self.log_z += sign * _total(found, rows)
        self.parts.append(counts_of(found, rows, s.labels, gen * sign, disc * sign))

    def kl(self, rows: DataFrame, sign: float = 1.0) -> None:
        """Posteriors of the generative model alone, as counts of the other one; the objective is the expected score of the other."""
        if rows.isEmpty():
            return
        s = self.setting
        found = written(expectations(scored(rows, self.params, s.labels, True, False), self.chain, s.longest, True, False, False), "expectations")
        counts = written(counts_of(found, rows, s.labels, 0.0, 1.0), "counts")
        weights, c = self.params.where("model = 'disc'").alias("w"), counts.alias("c")
        on = [F.col(f"w.{x}").eqNullSafe(F.col(f"c.{x}")) for x in KEYS]
        self.log_z += sign * float(weights.join(c, on).agg(F.coalesce(F.sum(F.col("w.value") * F.col("c.value")), F.lit(0.0)).alias("z")).first()["z"])
        self.parts.append(counts.withColumn("value", F.col("value") * sign))

    def learn_records(self, rows: DataFrame, use_gen: bool, use_disc: bool) -> None:
        """Labelled counts of each model, less what the discriminative one expects."""
        if use_disc:
            self.add(rows, False, True, 0.0, 1.0, true_only=True)
        if use_gen:
            self.add(rows, True, False, 1.0, 0.0, true_only=True)
        if use_disc:
            self.add(rows, False, True, 0.0, 1.0, sign=-1.0)

    def learn_texts(self, rows: DataFrame, use_gen: bool, use_disc: bool, kl: bool = False, joint: bool = False, weight: float = 1.0, supervised: bool = False) -> None:
        """What the models expect of texts, less what the discriminative one expects; nothing without the generative one, unless labels are used."""
        if supervised:
            return self.learn_records(rows.withColumn("is_record", F.lit(False)), use_gen, use_disc)
        if not use_gen and not joint:
            return None
        s = self.setting
        half = 0.5 if use_gen and use_disc else 1.0
        if kl and use_gen and use_disc:
            self.kl(rows, weight)
        else:
            self.add(rows, use_gen, use_disc, half * weight if use_gen else 0.0, half * weight if use_disc else 0.0, joint=joint, constrained=s.domain is not PLAIN)
        if use_disc:
            self.add(rows, False, True, 0.0, weight, sign=-1.0)
        return None

    def table(self) -> DataFrame:
        out = self.parts[0] if self.parts else self.params.where("false")
        for more in self.parts[1:]:
            out = out.unionByName(more)
        return sum_counts(out)


def _gather(s: Setting, params: DataFrame, use_gen: bool, use_disc: bool, kl: bool, joint: bool, supervised: bool = False, text_gate: float | None = None) -> Counts:
    counts, weight = Counts(s, params), s.options.coref_text_weight if joint else s.options.seg_text_weight
    if supervised:
        counts.learn_texts(s.texts(), use_gen, use_disc, supervised=True)
        return counts
    counts.learn_records(s.records(), use_gen, use_disc)
    if (weight if text_gate is None else text_gate) > 0:
        counts.learn_texts(s.texts(), use_gen, use_disc, kl, joint, weight)
    return counts


def em(s: Setting, params: DataFrame, iterations: int, joint: bool = False, smoothing: float = SMOOTHING, supervised: bool = False, text_gate: float | None = None, after: Callable[[int, DataFrame], None] | None = None) -> tuple[DataFrame, list[float]]:
    """Generative parameters by expectation-maximisation, and the objective before each step; records teach by their labels, texts by their weight.

    ``text_gate`` decides whether texts take part; by default the weight of the learner itself (some pipelines test that of the
    segmentation for joint learning too).
    """
    history, disc = [], params.where("model = 'disc'").select(*KEYS, "value")
    for i in range(iterations):
        counts = _gather(s, params, True, False, False, joint, supervised, text_gate)
        history.append(counts.log_z)
        gen = normalised(filled(s.keys.where("model = 'gen'"), counts.table()), smoothing).select(*KEYS, "value")
        params = written(gen.unionByName(disc), "params")
        if after:
            after(i, params)
    return params, history


@dataclass
class Objective:
    """1/2 inverse variance |w|^2 less the log likelihood, and its gradient as a table."""

    setting: Setting
    gen: DataFrame
    use_gen: bool = False
    kl: bool = False
    joint: bool = False
    supervised: bool = False

    def __call__(self, weights: DataFrame) -> tuple[float, DataFrame]:
        params = self.gen.unionByName(weights.select(*KEYS, "value"))
        counts = _gather(self.setting, params, self.use_gen, True, self.kl, self.joint, self.supervised)
        v = self.setting.options.inverse_variance
        norm = weights.agg(F.sum(F.col("value") * F.col("value")).alias("n")).first()["n"] or 0.0
        of = filled(self.setting.keys.where("model = 'disc'"), counts.table().where("model = 'disc'")).withColumnRenamed("value", "c")
        w, c = weights.alias("w"), of.alias("c")
        on = [F.col(f"w.{x}").eqNullSafe(F.col(f"c.{x}")) for x in KEYS]
        gradient = w.join(c, on).select(*[F.col(f"w.{x}") for x in KEYS], F.col("w.value").alias("w"), (v * F.col("w.value") - F.col("c.c")).alias("g"))
        return 0.5 * v * norm - counts.log_z, gradient


def lbfgs(objective: Callable[[DataFrame], tuple[float, DataFrame]], weights: DataFrame, iterations: int, memory: int = 4, least_change: float = 1e-3, after: Callable[[int, DataFrame], None] | None = None) -> tuple[DataFrame, list[float]]:
    """Weights (KEYS, value) that minimise the objective, and its values.

    The state is a table of columns w, g, s_i, y_i.  All inner products among g, s_i and y_i come from one aggregation; the
    two-loop recursion works on them alone and gives the direction as a combination of the columns.
    """
    value, gradient = objective(weights)
    state = written(gradient, "lbfgs")
    history, have = [value], 0
    for it in range(iterations):
        basis = [f"s{i}" for i in range(have)] + [f"y{i}" for i in range(have)] + ["g"]
        pairs = [(a, b) for i, a in enumerate(basis) for b in basis[i:]]
        row = state.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]).first()
        dots = {(a, b): row[f"{a}_{b}"] or 0.0 for a, b in pairs}
        dots |= {(b, a): v for (a, b), v in dots.items()}
        c = dict.fromkeys(basis, 0.0)
        c["g"] = -1.0
        alpha = {}
        inner = lambda name: sum(c[b] * dots[name, b] for b in basis)
        for i in range(have):  # 0 is the newest pair
            if dots[f"s{i}", f"y{i}"] <= 0:
                continue
            alpha[i] = inner(f"s{i}") / dots[f"s{i}", f"y{i}"]
            c[f"y{i}"] -= alpha[i]
        if have and dots["y0", "y0"] > 0 and dots["s0", "y0"] > 0:
            scale = dots["s0", "y0"] / dots["y0", "y0"]
            c = {b: v * scale for b, v in c.items()}
        for i in reversed(range(have)):
            if i in alpha:
                c[f"s{i}"] += alpha[i] - inner(f"y{i}") / dots[f"s{i}", f"y{i}"]
        slope = inner("g")
        if slope >= 0:  # not a descent direction: start anew
            c, slope = {b: -1.0 if b == "g" else 0.0 for b in basis}, -dots["g", "g"]
        if slope > -1e-12:
            break
        direction = sum((F.col(b) * F.lit(v) for b, v in c.items() if v), F.lit(0.0))
        step = 1.0 if have else min(1.0, 1.0 / max(1e-12, np.sqrt(dots["g", "g"])))
        found = None
        while step > 1e-8:
            trial = written(state.withColumn("p", direction * F.lit(step)).withColumn("value", F.col("w") + F.col("p")), "lbfgs")
            v, gradient = objective(trial.select(*KEYS, "value"))
            if v <= value + 1e-4 * step * slope:
                found = (v, gradient)
                break
            step /= 2
            dropped(trial.sparkSession, trial)
        if found is None:
            break
        keep = min(memory, have + 1)
        t, g = trial.alias("t"), found[1].select(*KEYS, F.col("g").alias("g_new")).alias("n")
        on = [F.col(f"t.{x}").eqNullSafe(F.col(f"n.{x}")) for x in KEYS]
        columns = [F.col(f"t.{x}").alias(x) for x in KEYS] + [F.col("t.value").alias("w"), F.col("n.g_new").alias("g"), F.col("t.p").alias("s0"), (F.col("n.g_new") - F.col("t.g")).alias("y0")]
        columns += [F.col(f"t.{k}{i - 1}").alias(f"{k}{i}") for k in "sy" for i in range(1, keep)]
        state = written(t.join(g, on).select(*columns), "lbfgs")
        change = abs(value - found[0]) / max(1e-12, (abs(value) + abs(found[0])) / 2)
        value, have = found[0], keep
        history.append(value)
        if after:
            after(it, state.select(*KEYS, F.col("w").alias("value")))
        if change < least_change:
            break
    return state.select(*KEYS, F.col("w").alias("value")), history


def fit_weights(s: Setting, params: DataFrame, iterations: int, use_gen: bool = False, kl: bool = False, joint: bool = False, supervised: bool = False, after: Callable[[int, DataFrame], None] | None = None) -> tuple[DataFrame, list[float]]:
    """Discriminative weights by L-BFGS; with ``joint`` and a domain, under constraints that are fitted anew at every evaluation."""
    gen = params.where("model = 'gen'").select(*KEYS, "value")
    weights, history = lbfgs(Objective(s, gen, use_gen, kl, joint, supervised), params.where("model = 'disc'").select(*KEYS, "value"), iterations, after=after)
    return gen.unionByName(weights), history


def added(params: DataFrame, counts: DataFrame, step: float) -> DataFrame:
    """Discriminative parameters plus ``step`` times the counts; a key that the parameters lack is dropped."""
    p, c = params.alias("p"), counts.where("model = 'disc'").alias("c")
    on = [F.col(f"p.{x}").eqNullSafe(F.col(f"c.{x}")) for x in KEYS]
    return p.join(c, on, "left").select(*[F.col(f"p.{x}").alias(x) for x in KEYS], (F.col("p.value") + step * F.coalesce(F.col("c.value"), F.lit(0.0))).alias("value"))


def mini_batches(s: Setting, params: DataFrame, batches: DataFrame, epochs: int = 1, use_gen: bool = False, kl: bool = False, joint: bool = False, order: list[int] | None = None, after: Callable[[int, DataFrame], None] | None = None) -> tuple[DataFrame, list[float]]:
    """Stochastic steps over ``batches`` (mention_id, batch_id, in order unless ``order`` names another), and the objective of each epoch.

    With one mention a batch these are online steps.
    """
    numbers = order or [r["batch_id"] for r in batches.select("batch_id").distinct().orderBy("batch_id").collect()]
    marked = written(s.examples.join(batches.select("mention_id", "batch_id"), "mention_id").repartition("batch_id"), "batches")
    weight = s.options.coref_text_weight if joint else s.options.seg_text_weight
    history, updates = [], 0
    for epoch in range(epochs):
        total = 0.0
        for b in numbers:
            rows = marked.where(F.col("batch_id") == b)
            counts = Counts(s, params)
            counts.learn_records(rows.where("is_record"), use_gen, True)
            if weight > 0:
                counts.learn_texts(rows.where("not is_record"), use_gen, True, kl, joint, weight)
            total += counts.log_z
            params = written(added(params, counts.table(), s.options.step_size(updates)), "params")
            updates += 1
        history.append(total)
        if after:
            after(epoch, params)
    return params, history


def shuffled_batches(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """(mention_id, batch_id): batches in random order by the hash of an id."""
    from reclink.sources.mentions import batches, shuffle_key

    keyed = rows.select("mention_id", F.conv(F.substring(shuffle_key(F.col("mention_id"), seed), 1, 13), 16, 10).cast("bigint").alias("k"))
    return batches(keyed, "k", size).select("mention_id", "batch_id")
