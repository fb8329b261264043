"""Semi-Markov segmentation lattices: scores by joins, dynamic programming in Arrow functions, counts by aggregation.

A mention of N tokens and L labels has the segment scores S[i, d, l]: the score of label l over the tokens [i, i + d + 1), or
-inf where that isn't allowed.  Emission scores come from a join of features with parameters, so parameters of any size
work; only starts and transitions (L and L x L numbers) go to the tasks with the function.  A mention is decoded alone.

Scores: parameters of the generative model ("gen") are probabilities and count by their logarithm, those of the
discriminative one ("disc") are weights; each counts half if both are used.  Unseen features score 0.  Starts and transitions
of records score 0.  Ties go to the smallest (label, begin, end).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.config import NO_RECORD, WITH_RECORD
from reclink.functions.text import from_bio
from reclink.session import by_shuffle, ship

#: Smallest probability that is scored.
LEAST = 1e-300
SEGMENTS = "array<struct<begin:int,end:int,label:string>>"


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    """log(sum(exp(x))) that bears -inf."""
    top = np.max(x, axis=axis)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis)) + safe


# -- dynamic programming over one mention -----------------------------------------------------------------------------


@dataclass
class Posterior:
    """Log partition, and expected numbers of segments (N, D, L), first labels (L) and label pairs (L, L)."""

    log_z: float
    segments: np.ndarray
    starts: np.ndarray
    transitions: np.ndarray

    def tokens(self) -> np.ndarray:
        """Expected labels of tokens (N, L)."""
        n, depth, labels = self.segments.shape
        steps = np.zeros((n + 1, labels))
        for d in range(depth):
            steps[:n] += self.segments[:, d]
            np.subtract.at(steps, np.minimum(np.arange(n) + d + 1, n), self.segments[:, d])
        return np.cumsum(steps, 0)[:n]


def forward_backward(scores: np.ndarray, start: np.ndarray, transition: np.ndarray) -> Posterior:
    """Sums over all segmentations; a mention without one has a log partition of -inf and no counts."""
    n, depth, labels = scores.shape
    if n == 0:
        return Posterior(0.0, np.zeros((0, depth, labels)), np.zeros(labels), np.zeros((labels, labels)))
    ends = np.full((n + 1, labels), -np.inf)  # segmentations of [0, j) whose last label is l
    into = np.full((n + 1, labels), -np.inf)  # the same, with the step to a next label at j
    into[0] = start
    for j in range(1, n + 1):
        d = np.arange(min(depth, j))
        ends[j] = _sum_exp(into[j - 1 - d] + scores[j - 1 - d, d], 0)
        if j < n:
            into[j] = _sum_exp(ends[j][:, None] + transition, 0)
    log_z = float(_sum_exp(ends[n], 0))
    if not np.isfinite(log_z):
        return Posterior(-np.inf, np.zeros(scores.shape), np.zeros(labels), np.zeros((labels, labels)))
    rest = np.full((n + 1, labels), -np.inf)  # what may follow a segment of label l that ends at j
    onward = np.full((n + 1, labels), -np.inf)  # what may follow from a segment of label l that begins at i
    rest[n] = 0.0
    for i in range(n - 1, -1, -1):
        d = np.arange(min(depth, n - i))
        onward[i] = _sum_exp(scores[i, d] + rest[i + 1 + d], 0)
        if i:
            rest[i] = _sum_exp(transition + onward[i][None, :], 1)
    at = np.minimum(np.arange(n)[:, None] + np.arange(depth)[None, :] + 1, n)
    segments = np.exp(into[:n, None, :] + scores + rest[at] - log_z)
    pairs = np.zeros((labels, labels))
    for i in range(1, n):
        pairs += np.exp(ends[i][:, None] + transition + onward[i][None, :] - log_z)
    return Posterior(log_z, segments, np.exp(start + onward[0] - log_z), pairs)


def viterbi(scores: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[float, list[tuple[int, int, int]]]:
    """The best score and its segments (begin, end, label)."""
    n, depth, labels = scores.shape
    if n == 0:
        return 0.0, []
    ends = np.full((n + 1, labels), -np.inf)
    into = np.full((n + 1, labels), -np.inf)
    length = np.zeros((n + 1, labels), int)
    before = np.full((n + 1, labels), -1)
    into[0] = start
    for j in range(1, n + 1):
        d = np.arange(min(depth, j))[::-1]  # earlier beginnings first
        found = into[j - 1 - d] + scores[j - 1 - d, d]
        best = found.argmax(0)
        ends[j], length[j] = found[best, np.arange(labels)], d[best] + 1
        if j < n:
            steps = ends[j][:, None] + transition
            before[j] = steps.argmax(0)
            into[j] = steps[before[j], np.arange(labels)]
    label = int(ends[n].argmax())
    score, j, out = float(ends[n][label]), n, []
    if not np.isfinite(score):
        return -np.inf, []
    while j > 0:
        i = j - int(length[j, label])
        out.append((i, j, label))
        label, j = int(before[i, label]), i
    return score, out[::-1]


def segment_scores(emission: np.ndarray, longest: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Scores (N, D, L) from token scores (N, L): sums over a segment's tokens; -inf beyond a label's longest segment and where not ``allowed``."""
    n, labels = emission.shape
    depth = int(min(max(longest.max(initial=1), 1), max(n, 1)))
    sums = np.concatenate([np.zeros((1, labels)), np.cumsum(emission, 0)])
    begin, d = np.arange(n)[:, None], np.arange(depth)[None, :]
    end = np.minimum(begin + d + 1, n)
    out = sums[end] - sums[begin]
    fits = (begin + d + 1 <= n)[:, :, None] & (d[0][:, None] < longest[None, :])[None]
    return np.where(fits & allowed[:, :depth], out, -np.inf)


def allowed_segments(n: int, labels: list[str], longest: np.ndarray, ends: np.ndarray, gold: list[tuple[int, int, str]] | None, is_record: bool, true_only: bool) -> np.ndarray:
    """Which segments may be (N, D, L): the labelled ones only; or, within a record's labelled segments, those that end where one may; or in texts all of these."""
    depth = int(min(max(longest.max(initial=1), 1), max(n, 1)))
    if gold is not None and (true_only or is_record):
        depth = max([depth, *(e - b for b, e, _ in gold)])
        longest = np.maximum(longest, depth if true_only else longest)
    shape = (n, depth, len(labels))
    number = {x: i for i, x in enumerate(labels)}
    if true_only:
        out = np.zeros(shape, bool)
        for b, e, label in gold or []:
            if label in number:
                out[b, e - b - 1, number[label]] = True
        return out
    begin, d = np.arange(n)[:, None], np.arange(depth)[None, :]
    end = np.minimum(begin + d + 1, n)
    may = ends[end]
    other = np.array([x == "O" for x in labels])
    if not is_record or gold is None:
        return may[:, :, None] | np.broadcast_to(other, shape)
    limit = np.zeros(n, int)
    for b, e, _ in gold:
        limit[b:e] = e
    inside = begin + d + 1 <= limit[:, None]
    return inside[:, :, None] & ((may | (begin + d + 1 == limit[:, None]))[:, :, None] | other)


# -- parameters -------------------------------------------------------------------------------------------------------


@dataclass
class Chain:
    """Starts and transitions of both models as numbers, for tasks."""

    labels: list[str]
    gen_start: np.ndarray
    gen_transition: np.ndarray
    disc_start: np.ndarray
    disc_transition: np.ndarray
    #: First labels and label pairs that may not be, in records too.
    barred: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, params: DataFrame, labels: list[str]) -> Chain:
        """From a table of parameters; those that are missing are even (gen) or 0 (disc)."""
        n, number = len(labels), {x: i for i, x in enumerate(labels)}
        gs, gt = np.full(n, 1.0 / n), np.full((n, n), 1.0 / n)
        ds, dt = np.zeros(n), np.zeros((n, n))
        for r in params.where("kind in ('S', 'T')").collect():
            if r["label"] not in number or (r["kind"] == "T" and r["key"] not in number):
                continue
            one, two = (gs, gt) if r["model"] == "gen" else (ds, dt)
            if r["kind"] == "S":
                one[number[r["label"]]] = r["value"]
            else:
                two[number[r["label"]], number[r["key"]]] = r["value"]
        return cls(labels, gs, gt, ds, dt)

    def restricted(self, start: Callable[[str], bool] | None = None, step: Callable[[str, str], bool] | None = None) -> Chain:
        """This chain where mentions may begin only with the labels of ``start`` and go only from label to label as ``step`` says."""
        may_start = np.array([start is None or bool(start(x)) for x in self.labels])
        may_step = np.array([[step is None or bool(step(x, y)) for y in self.labels] for x in self.labels])
        return replace(self, barred=(~may_start, ~may_step))

    def scores(self, is_record: bool, use_gen: bool, use_disc: bool) -> tuple[np.ndarray, np.ndarray]:
        start, transition = self._free(is_record, use_gen, use_disc)
        if self.barred is not None:
            start, transition = np.where(self.barred[0], -np.inf, start), np.where(self.barred[1], -np.inf, transition)
        return start, transition

    def _free(self, is_record: bool, use_gen: bool, use_disc: bool) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.labels)
        if is_record:
            return np.zeros(n), np.zeros((n, n))
        half = 0.5 if use_gen and use_disc else 1.0
        start, transition = np.zeros(n), np.zeros((n, n))
        if use_gen:
            start, transition = start + half * np.log(np.maximum(self.gen_start, LEAST)), transition + half * np.log(np.maximum(self.gen_transition, LEAST))
        if use_disc:
            start, transition = start + half * self.disc_start, transition + half * self.disc_transition
        return start, transition


def emission_table(params: DataFrame, labels: list[str], model: str) -> DataFrame:
    """(key, by_label: array<double>): scores of a feature for each label, logarithms of probabilities or weights."""
    value = F.log(F.greatest("value", F.lit(LEAST))) if model == "gen" else F.col("value")
    rows = params.where((F.col("model") == model) & (F.col("kind") == "E"))
    missing = float(np.log(LEAST)) if model == "gen" else 0.0
    cells = [F.coalesce(F.max(F.when(F.col("label") == x, value)), F.lit(missing)) for x in labels]
    return rows.groupBy("key").agg(F.array(*cells).alias("by_label"))


def emission_scores(examples: DataFrame, params: DataFrame, labels: list[str], use_gen: bool = True, use_disc: bool = False) -> DataFrame:
    """(mention_id, position, scores: array<double>) of every token; ``examples`` has word_features (one of each token) and feats (arrays of them)."""
    half = 0.5 if use_gen and use_disc else 1.0
    parts = []
    if use_gen:
        keys = examples.select("mention_id", F.posexplode("word_features").alias("position", "key"))
        parts.append(keys.join(emission_table(params, labels, "gen"), "key", "left").select("mention_id", "position", "by_label"))
    if use_disc:
        keys = examples.select("mention_id", F.posexplode("feats").alias("position", "f")).select("mention_id", "position", F.explode_outer("f").alias("key"))
        parts.append(keys.join(emission_table(params, labels, "disc"), "key", "left").select("mention_id", "position", "by_label"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    cells = [(F.coalesce(F.sum(F.get("by_label", F.lit(i))), F.lit(0.0)) * half).alias(f"s{i}") for i in range(len(labels))]
    return rows.groupBy("mention_id", "position").agg(*cells).select("mention_id", "position", F.array(*[f"s{i}" for i in range(len(labels))]).alias("scores"))


def scored(examples: DataFrame, params: DataFrame, labels: list[str], use_gen: bool = True, use_disc: bool = False) -> DataFrame:
    """``examples`` with emission: array<array<double>> (a row of label scores for each token)."""
    rows = emission_scores(examples, params, labels, use_gen, use_disc)
    each = rows.groupBy("mention_id").agg(F.sort_array(F.collect_list(F.struct("position", "scores"))).alias("e")).select("mention_id", F.col("e.scores").alias("emission"))
    return examples.join(by_shuffle(each), "mention_id", "left")


# -- inference over tables --------------------------------------------------------------------------------------------


def _rows(column) -> list:
    return column.to_pylist()


@dataclass
class Row:
    """One mention in a task."""

    id: str
    words: list[str]
    is_record: bool
    gold: list[tuple[int, int, str]] | None
    ends: np.ndarray
    emission: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, n_labels: int):
        names = batch.schema.names
        columns = {c: batch.column(names.index(c)).to_pylist() for c in ("mention_id", "words", "is_record", "gold", "ends", "emission")}
        for i in range(batch.num_rows):
            words = columns["words"][i] or []
            n = len(words)
            gold = columns["gold"][i]
            ends = columns["ends"][i]
            emission = columns["emission"][i]
            yield cls(
                columns["mention_id"][i], words, bool(columns["is_record"][i]), None if gold is None else [(s["begin"], s["end"], s["label"]) for s in gold],
                np.ones(n + 1, bool) if ends is None else np.array(ends, bool), np.array(emission, float).reshape(n, n_labels) if n and emission is not None else np.zeros((n, n_labels)),
            )


def _lattice_input(rows: DataFrame) -> list:
    gold = from_bio(F.col("labels")) if "labels" in rows.columns else F.lit(None).cast(SEGMENTS)
    ends = F.col("ends") if "ends" in rows.columns else F.lit(None).cast("array<boolean>")
    return [F.col("mention_id").cast("string").alias("mention_id"), "words", "is_record", gold.alias("gold"), ends.alias("ends"), "emission"]


def lattice_of(row: Row, labels: list[str], longest: np.ndarray, true_only: bool) -> np.ndarray:
    allowed = allowed_segments(len(row.words), labels, longest, row.ends, row.gold, row.is_record, true_only)
    if allowed.shape[1] > longest.max(initial=1) and (true_only or row.is_record):
        longest = np.full(len(labels), allowed.shape[1]) if true_only else longest
    return segment_scores(row.emission, longest, allowed)


def _lengths(labels: list[str], longest: dict[str, int]) -> np.ndarray:
    return np.array([longest.get(x, 1) for x in labels])


def decode(rows: DataFrame, chain: Chain, longest: dict[str, int], use_gen: bool = True, use_disc: bool = False, records_by_gold: bool = True) -> DataFrame:
    """(mention_id, score, segments) of ``scored`` rows: the best segmentation; records take their labels."""
    labels, lengths = chain.labels, _lengths(chain.labels, longest)
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            ids, scores, out = [], [], []
            for row in Row.read(batch, len(labels)):
                true_only = records_by_gold and row.is_record and row.gold is not None
                score, best = viterbi(lattice_of(row, labels, lengths, true_only), *chain.scores(row.is_record, use_gen, use_disc))
                ids.append(row.id)
                scores.append(score)
                out.append([{"begin": b, "end": e, "label": labels[x]} for b, e, x in best])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(scores, pa.float64()), pa.array(out, _SEGMENT_LIST)], names=["mention_id", "score", "segments"])

    return rows.select(*_lattice_input(rows)).mapInArrow(run, f"mention_id string, score double, segments {SEGMENTS}")


_SEGMENT_LIST = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
_POSTERIOR = "mention_id string, log_z double, tokens array<double>, starts array<double>, transitions array<double>, error string"


def expectations(rows: DataFrame, chain: Chain, longest: dict[str, int], use_gen: bool = True, use_disc: bool = False, true_only: bool | None = False) -> DataFrame:
    """(mention_id, log_z, tokens, starts, transitions, error) of ``scored`` rows; true_only None: as the row is a record.

    A mention that can't be segmented has a log_z of -inf, no counts, and an error.
    """
    labels, lengths = chain.labels, _lengths(chain.labels, longest)
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for row in Row.read(batch, len(labels)):
                gold_only = row.is_record if true_only is None else true_only
                found = forward_backward(lattice_of(row, labels, lengths, gold_only), *chain.scores(row.is_record, use_gen, use_disc))
                error = None if np.isfinite(found.log_z) else "no segmentation is allowed"
                out.append((row.id, found.log_z, found.tokens().ravel(), found.starts, found.transitions.ravel(), error))
            yield _posterior_batch(out)

    return rows.select(*_lattice_input(rows)).mapInArrow(run, _POSTERIOR)


def _posterior_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.string(), pa.float64(), *[pa.list_(pa.float64())] * 3, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["mention_id", "log_z", "tokens", "starts", "transitions", "error"])


#: Columns of examples on which scores and expectations depend.
CONTENT = ("is_record", "words", "labels", "ends", "word_features", "feats")


def counted(examples: DataFrame) -> DataFrame:
    """Examples of equal content as one, with their number (copies) and an id of the content for theirs."""
    content = [c for c in CONTENT if c in examples.columns]
    rows = examples.groupBy(*content).agg(F.count(F.lit(1)).alias("copies"))
    return rows.withColumn("mention_id", F.sha2(F.to_json(F.struct(*content)), 256))


def counts_of(posteriors: DataFrame, examples: DataFrame, labels: list[str], gen: float = 0.0, disc: float = 0.0, least: float = 1e-12) -> DataFrame:
    """Parameter-shaped counts (model, kind, label, key, value) of posteriors, times ``gen`` and ``disc`` (and ``copies``, if examples are counted); records have no starts and transitions."""
    n = len(labels)
    names = F.array(*map(F.lit, labels))
    rows = posteriors.where("error is null").join(examples.select(F.col("mention_id").cast("string").alias("mention_id"), "is_record", "word_features", "feats", F.col("copies") if "copies" in examples.columns else F.lit(1).alias("copies")), "mention_id")
    models = [(m, s) for m, s in (("gen", gen), ("disc", disc)) if s]
    out = None

    def add(more):
        nonlocal out
        out = more if out is None else out.unionByName(more)

    for model, scale in models:
        key_of = F.col("word_features") if model == "gen" else F.col("feats")
        tokens = rows.select(F.posexplode(key_of).alias("position", "k"), "tokens", "copies")
        tokens = tokens.select(F.col("k").alias("key") if model == "gen" else F.explode("k").alias("key"), F.slice("tokens", F.col("position") * n + 1, F.lit(n)).alias("p"), "copies")
        add(tokens.select(F.lit("E").alias("kind"), "key", F.posexplode("p").alias("i", "value"), "copies").select(F.lit(model).alias("model"), "kind", F.get(names, F.col("i")).alias("label"), "key", (F.col("value") * scale).alias("value"), "copies"))
        texts = rows.where("not is_record")
        add(texts.select(F.posexplode("starts").alias("i", "value"), "copies").select(F.lit(model).alias("model"), F.lit("S").alias("kind"), F.get(names, F.col("i")).alias("label"), F.lit(None).cast("string").alias("key"), (F.col("value") * scale).alias("value"), "copies"))
        pair = texts.select(F.posexplode("transitions").alias("i", "value"), "copies")
        add(pair.select(F.lit(model).alias("model"), F.lit("T").alias("kind"), F.get(names, F.floor(F.col("i") / n).cast("int")).alias("label"), F.get(names, F.col("i") % n).alias("key"), (F.col("value") * scale).alias("value"), "copies"))
    if out is None:
        return examples.sparkSession.createDataFrame([], "model string, kind string, label string, key string, value double")
    return out.where(F.abs("value") > least).groupBy("model", "kind", "label", "key").agg(F.sum(F.col("value") * F.col("copies")).alias("value"))


# -- joint decoding with records --------------------------------------------------------------------------------------

#: Scores of aligning the span [begin, end) with a value, added to the lattice: (field, words, begin, end, value's words) -> number.
Overlap = Callable[[str, list[str], int, int, list[str]], float]
#: Scores of going from a label to another one within a candidate record: (candidate, label, next label) -> number.
Handover = Callable[[dict, str, str], float]


def with_candidates(texts: DataFrame, candidates: DataFrame, values: DataFrame, chunk: int | None = None) -> DataFrame:
    """``texts`` with candidates: array of (record_id, values: array of (field, value_id, phrase)) in the order of ids.

    With ``chunk``, a text has a row for each part of about that many candidates, numbered from 0, so that no row grows with a hot
    key, and one numbered -1 for the segmentation without a record; ``decode_joint`` puts them together again.
    """
    wanted = candidates.select("record_id").distinct()
    of = values.join(wanted, "record_id").groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("field", "value_id", "phrase"))).alias("values"))
    keys = ["mention_id"]
    if chunk:
        parts = candidates.groupBy("mention_id").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts__"))
        candidates = candidates.join(parts, "mention_id").withColumn("chunk", F.pmod(F.xxhash64("record_id"), F.col("parts__")).cast("int"))
        keys.append("chunk")
    each = candidates.join(of, "record_id").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("record_id", "values"))).alias("candidates"))
    if not chunk:
        return texts.join(each, "mention_id", "left")
    none = F.lit(None).cast(each.schema["candidates"].dataType)
    return texts.join(each, "mention_id").unionByName(texts.withColumn("chunk", F.lit(-1)).withColumn("candidates", none))


def aligned(base: np.ndarray, labels: list[str], values: list[dict], words: list[str], overlap: Overlap | None) -> tuple[np.ndarray, dict[int, list[tuple[str, np.ndarray]]]]:
    """Segment scores of a candidate record before summing over values: -inf for labels (not O) without a value; and for each label its values with their overlap scores (N, D)."""
    out = base.copy()
    n, depth, _ = base.shape
    choices: dict[int, list[tuple[str, np.ndarray]]] = {}
    for x, label in enumerate(labels):
        if label == "O":
            continue
        own = [v for v in values if v["field"] == label]
        if not own:
            out[:, :, x] = -np.inf
            continue
        choices[x] = []
        for v in own:
            extra = np.zeros((n, depth))
            if overlap is not None:
                for b, d in zip(*np.nonzero(np.isfinite(base[:, :, x]))):
                    extra[b, d] = overlap(label, words, int(b), int(b + d + 1), v["phrase"])
            choices[x].append((v["value_id"], extra))
    return out, choices


def decode_joint(rows: DataFrame, chain: Chain, longest: dict[str, int], use_gen: bool = True, use_disc: bool = False, overlap: Overlap | None = None, handover: Handover | None = None) -> DataFrame:
    """(mention_id, record_id, score, log_z, segments with record_id and value_id): the best segmentation over no record and each candidate.

    The record is chosen at the start alone, so each candidate is decoded by itself and the best one wins; ties go to no
    record, then to the smallest id.
    """
    labels, lengths = chain.labels, _lengths(chain.labels, longest)
    chunked = "chunk" in rows.columns
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            candidates, chunks = batch.column(names.index("candidates")).to_pylist(), batch.column(names.index("chunk")).to_pylist()
            out = []
            for row, own, part in zip(Row.read(batch, len(labels)), candidates, chunks):
                base = lattice_of(row, labels, lengths, row.is_record and row.gold is not None)
                none_weight = NO_RECORD if part < 0 else -np.inf
                out.append((row.id, *best_joint(base, chain.scores(row.is_record, use_gen, use_disc), labels, own or [], row.words, overlap, none_weight, handover)))
            yield joint_batch(out)

    found = rows.select(*_lattice_input(rows), "candidates", F.col("chunk") if chunked else F.lit(-1).alias("chunk")).mapInArrow(run, JOINT)
    if not chunked:
        return found
    best = F.min_by(F.struct("record_id", "score", "segments"), F.struct(-F.col("score"), F.coalesce("record_id", F.lit(""))))
    both = found.groupBy("mention_id").agg(best.alias("b"), F.collect_list("log_z").alias("z"), F.max("log_z").alias("m"))
    total = F.col("m") + F.log(F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("m"))))
    return both.select("mention_id", "b.record_id", "b.score", F.when(F.col("m") > float("-inf"), total).otherwise(F.col("m")).alias("log_z"), "b.segments")


JOINT = "mention_id string, record_id string, score double, log_z double, segments array<struct<begin:int,end:int,label:string,record_id:string,value_id:string>>"
_JOINT_LIST = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("record_id", pa.string()), ("value_id", pa.string())]))


def joint_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), _JOINT_LIST]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["mention_id", "record_id", "score", "log_z", "segments"])


def best_joint(base: np.ndarray, chain: tuple[np.ndarray, np.ndarray], labels: list[str], candidates: list[dict], words: list[str], overlap: Overlap | None, none_weight: float = NO_RECORD, handover: Handover | None = None):
    """(record_id, score, log_z, segments) of one mention."""
    score, best = viterbi(base, *chain)
    found = (None, score + none_weight, best, {})
    parts = [forward_backward(base, *chain).log_z + none_weight]
    for c in candidates:
        plain, choices = aligned(base, labels, c["values"], words, overlap)
        top, total = plain.copy(), plain.copy()
        for x, of in choices.items():
            stack = np.stack([e for _, e in of])
            top[:, :, x] += stack.max(0)
            total[:, :, x] += _sum_exp(stack, 0)
        own = chain if handover is None else (chain[0], chain[1] + np.array([[handover(c, x, y) for y in labels] for x in labels]))
        score, best = viterbi(top, *own)
        parts.append(forward_backward(total, *own).log_z + WITH_RECORD)
        if score + WITH_RECORD > found[1]:
            found = (c["record_id"], score + WITH_RECORD, best, choices)
    record, score, best, choices = found
    segments = []
    for b, e, x in best:
        value = None
        if x in choices:
            of = choices[x]
            value = of[int(np.argmax([extra[b, e - b - 1] for _, extra in of]))][0]
        segments.append({"begin": b, "end": e, "label": labels[x], "record_id": record, "value_id": value})
    return record, score, float(_sum_exp(np.array(parts), 0)), segments
