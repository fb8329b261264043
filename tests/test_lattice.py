"""The dynamic programs against enumeration of all segmentations, and properties of learning."""

import math

import numpy as np
import pytest
from corpus import mentions
from pyspark.sql import functions as F

from reclink.config import NO_RECORD, Options
from reclink.operators import blocking, constraints, evaluate, fields, lattice, learn
from reclink.operators.fields import HOTEL_FIELDS
from reclink.plans import examples, pipelines


def all_segmentations(scores, start, transition):
    """(score, segments) of every segmentation."""
    n, depth, labels = scores.shape

    def grow(i, last, score, path):
        if i == n:
            yield score, path
            return
        for d in range(min(depth, n - i)):
            for x in range(labels):
                if np.isfinite(scores[i, d, x]):
                    step = start[x] if last is None else transition[last, x]
                    yield from grow(i + d + 1, x, score + step + scores[i, d, x], [*path, (i, i + d + 1, x)])

    yield from grow(0, None, 0.0, [])


@pytest.mark.parametrize("seed", range(6))
def test_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    n, labels = int(rng.integers(1, 6)), int(rng.integers(1, 4))
    allowed = rng.random((n, 3, labels)) < 0.8
    allowed[:, 0, 0] = True
    scores = lattice.segment_scores(rng.normal(size=(n, labels)), np.array([1, 2, 3][:labels]), allowed)
    start, transition = rng.normal(size=labels), rng.normal(size=(labels, labels))
    every = list(all_segmentations(scores, start, transition))
    best, path = lattice.viterbi(scores, start, transition)
    assert best == pytest.approx(max(s for s, _ in every))
    assert (best, path) in [(pytest.approx(s), p) for s, p in every]
    found = lattice.forward_backward(scores, start, transition)
    z = np.array([s for s, _ in every])
    log_z = float(np.log(np.exp(z - z.max()).sum()) + z.max())
    assert found.log_z == pytest.approx(log_z) and best <= found.log_z + 1e-9
    weight = np.exp(z - log_z)
    segments, starts, pairs = np.zeros(scores.shape), np.zeros(labels), np.zeros((labels, labels))
    for w, (_, p) in zip(weight, every):
        for k, (b, e, x) in enumerate(p):
            segments[b, e - b - 1, x] += w
            if k:
                pairs[p[k - 1][2], x] += w
            else:
                starts[x] += w
    assert np.allclose(found.segments, segments) and np.allclose(found.starts, starts) and np.allclose(found.transitions, pairs)
    assert np.allclose(found.tokens().sum(1), 1)


def test_degenerate_lattices():
    empty = lattice.forward_backward(np.zeros((0, 1, 2)), np.zeros(2), np.zeros((2, 2)))
    assert empty.log_z == 0 and lattice.viterbi(np.zeros((0, 1, 2)), np.zeros(2), np.zeros((2, 2))) == (0.0, [])
    none = np.full((2, 1, 2), -np.inf)
    assert lattice.forward_backward(none, np.zeros(2), np.zeros((2, 2))).log_z == -np.inf
    assert lattice.viterbi(none, np.zeros(2), np.zeros((2, 2))) == (-np.inf, [])


@pytest.fixture(scope="module")
def run(spark):
    ready = examples.hotel_examples(mentions(spark))
    return pipelines.prepare(ready, HOTEL_FIELDS, Options(seg_text_weight=0.5))


def test_prepare(run):
    assert run.setting.labels == ["O", "hotelname", "localarea", "starrating"]
    assert run.setting.longest == {"O": 1, "hotelname": 3, "localarea": 2, "starrating": 1}


def test_blocking(spark, run):
    texts, records = run.setting.texts(), run.setting.records()
    pairs = blocking.conjunctive(texts, records, run.values, run.fields, run.setting.longest)
    found = {(r["mention_id"], r["record_id"]) for r in pairs.collect()}
    assert found == {("t1", "r1"), ("t1", "r3"), ("t2", "r2"), ("t2", "r3")}
    by_field = blocking.candidates_by_field(texts, fields.field_index(run.values), run.fields, run.setting.longest)
    assert {(r["mention_id"], r["record_id"]) for r in blocking.all_keys(by_field, 1).collect()} == found
    assert {(r["mention_id"], r["record_id"]) for r in blocking.any_key(by_field).collect()} == found
    report = blocking.blocking_quality(texts, pairs, records.select("mention_id", "true_cluster")).first()
    assert (report["n_texts"], report["n_with_cluster"], report["n_matches_clustered"], report["n_right"], report["recall"]) == (3, 2, 4, 2, 1.0)
    with pytest.raises(ValueError):
        blocking.conjunctive(texts, records, run.values, [f for f in run.fields if not f.is_key], run.setting.longest)


def test_em_improves_and_partitions_do_not_matter(spark, run):
    params, history = learn.em(run.setting, run.params, 3)
    assert all(b >= a - 1e-6 for a, b in zip(history[1:], history[2:]))
    sums = params.where("model = 'gen' and kind = 'E'").groupBy("label").agg(F.sum("value").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)
    other = learn.Setting(run.setting.examples.repartition(1), run.setting.keys, run.setting.labels, run.setting.longest, run.setting.options)
    again, history_again = learn.em(other, run.params, 3)
    assert history == pytest.approx(history_again)
    run.params = params
    guess = {r["mention_id"]: r["guess"] for r in pipelines.segmentation(run).collect()}
    assert all(s["label"] != "starrating" for s in guess["t3"])


def test_gradient_of_weights(spark, run):
    objective = learn.Objective(run.setting, run.params.where("model = 'gen'").select(*learn.KEYS, "value"))
    weights = run.params.where("model = 'disc'").select(*learn.KEYS, (F.pmod(F.xxhash64("label", "key"), F.lit(7)) / 20.0).alias("value"))
    value, gradient = objective(weights)
    for r in [gradient.orderBy(F.desc(F.abs("g")), "label", "key").first(), gradient.where("kind = 'E'").orderBy("label", "key").first()]:
        step = 1e-3
        same = (F.col("kind") == r["kind"]) & (F.col("label") == r["label"]) & F.col("key").eqNullSafe(F.lit(r["key"]))
        more, _ = objective(weights.withColumn("value", F.when(same, F.col("value") + step).otherwise(F.col("value"))))
        assert (more - value) / step == pytest.approx(r["g"], abs=5e-3)


def test_lbfgs_on_a_quadratic(spark):
    rows = spark.createDataFrame([("disc", "E", "a", str(i), 0.0) for i in range(5)], "model string, kind string, label string, key string, value double")
    target = [1.0, -2.0, 3.0, 0.5, 10.0]

    def objective(w):
        k = F.col("key").cast("int")
        goal = F.get(F.array(*map(F.lit, target)), k)
        scaled = w.withColumn("d", (F.col("value") - goal)).withColumn("c", k + 1.0)
        value = scaled.agg(F.sum(0.5 * F.col("c") * F.col("d") * F.col("d")).alias("v")).first()["v"]
        return value, scaled.select(*learn.KEYS, F.col("value").alias("w"), (F.col("c") * F.col("d")).alias("g"))

    found, history = learn.lbfgs(objective, rows, 30, least_change=1e-12)
    assert all(b <= a + 1e-9 for a, b in zip(history, history[1:]))
    assert [r["value"] for r in found.orderBy("key").collect()] == pytest.approx(target, abs=1e-2)


def test_weights_learn_records(spark, run):
    run.params, history = learn.fit_weights(run.setting, run.params, 4)
    assert history[-1] < history[0]
    marked = evaluate.token_scores(pipelines.segmentation(run, False, True)).where("label = 'starrating'").first()
    assert marked["n_both"] >= 1
    _, kl = learn.fit_weights(run.setting, run.params, 1, use_gen=True, kl=True)
    assert all(map(math.isfinite, kl))


def test_mini_batches(spark, run):
    batches = learn.shuffled_batches(run.setting.examples, 2, 1)
    assert sorted(r["batch_id"] for r in batches.collect()) == [0, 0, 1, 1, 2, 2]
    _, history = learn.mini_batches(run.setting, run.params, batches, 1)
    assert math.isfinite(history[0])


def test_joint_decoding(spark, run):
    joint = pipelines.with_joint(run)
    found = {r["mention_id"]: r for r in pipelines.joint_decoding(joint).collect()}
    assert found["t3"]["record_id"] is None and found["t1"]["record_id"] in ("r1", "r3") and found["t2"]["record_id"] in ("r2", "r3")
    for r in found.values():
        assert r["score"] <= r["log_z"] + 1e-9
        ends = [0, *[s["end"] for s in r["segments"]]]
        assert [s["begin"] for s in r["segments"]] == ends[:-1]
        assert all(s["value_id"] is not None for s in r["segments"] if s["label"] != "O" and r["record_id"])
    pairs = blocking.conjunctive(run.setting.texts(), run.setting.records(), run.values, run.fields, run.setting.longest)
    parted = lattice.with_candidates(run.setting.texts(), pairs, run.values, 1)
    again = lattice.decode_joint(lattice.scored(run.setting.texts(), run.params, run.setting.labels).select("mention_id", "emission").join(parted, "mention_id"), joint.chain, run.setting.longest)
    assert {r["mention_id"]: (r["record_id"], pytest.approx(r["score"]), pytest.approx(r["log_z"])) for r in again.collect()} == {i: (r["record_id"], r["score"], r["log_z"]) for i, r in found.items()}
    report = pipelines.joint_report(joint, pipelines.joint_decoding(joint)).first()
    assert report["n_texts"] == 3 and report["correct_literal"] >= 1


def test_best_joint_against_enumeration():
    rng = np.random.default_rng(5)
    labels, words = ["O", "a"], ["x", "y"]
    base = lattice.segment_scores(rng.normal(size=(2, 2)), np.array([1, 2]), np.ones((2, 2, 2), bool))
    chain = (rng.normal(size=2), rng.normal(size=(2, 2)))
    candidates = [{"record_id": "r", "values": [{"field": "a", "value_id": "v1", "phrase": ["x"]}, {"field": "a", "value_id": "v2", "phrase": ["y"]}]}, {"record_id": "s", "values": []}]
    overlap = lambda label, w, b, e, phrase: 0.7 if w[b:e] == phrase else 0.0
    every = [(s + NO_RECORD, None, p) for s, p in all_segmentations(base, *chain)]
    for s, p in all_segmentations(base, *chain):
        spans = [(b, e) for b, e, x in p if x == 1]
        if not spans:
            every.append((s, "s", p))
        totals = [s]
        for b, e in spans:
            totals = [t + overlap("a", words, b, e, v["phrase"]) for t in totals for v in candidates[0]["values"]]
        every += [(t, "r", p) for t in totals]
    record, score, log_z, segments = lattice.best_joint(base, chain, labels, candidates, words, overlap)
    z = np.array([s for s, _, _ in every])
    assert score == pytest.approx(z.max()) and log_z == pytest.approx(np.log(np.exp(z).sum()))
    assert record == max(every, key=lambda e: e[0])[1]
    assert all(s["value_id"] for s in segments if s["label"] == "a" and record == "r")


def test_constraints_descend_and_theta_is_kept(spark, run):
    joint = pipelines.with_joint(run)
    ready = lattice.scored(joint.joint, joint.params, joint.setting.labels, True, False)
    found = constraints.constrained_decode(ready, joint.chain, joint.setting.longest, joint.domain)
    for r in found.collect():
        assert all(b <= a + 1e-9 for a, b in zip(r["objective"], r["objective"][1:]))
        assert all(v >= 0 for v in r["theta"].values())
    again = constraints.constrained_decode(ready, joint.chain, joint.setting.longest, joint.domain, state=found.select("mention_id", "theta"), update=False)
    scores = {r["mention_id"]: r["score"] for r in found.collect()}
    assert {r["mention_id"]: pytest.approx(r["score"]) for r in again.collect()} == scores


def test_constraint_gradient():
    rng = np.random.default_rng(3)
    words, labels = ["4*", "red", "lion", "$65"], ["O", "hotelname", "localarea", "starrating"]
    longest = np.array([1, 3, 2, 1])
    row = lattice.Row("t", words, False, None, np.ones(5, bool), rng.normal(size=(4, 4)))
    base = lattice.lattice_of(row, labels, longest, False)
    values = [{"field": "hotelname", "value_id": "v", "phrase": ["red", "lion", "hotel"]}, {"field": "starrating", "value_id": "w", "phrase": ["4*"]}]
    model = constraints.Constrained(row, base, (rng.normal(size=4), rng.normal(size=(4, 4))), labels, [{"record_id": "r", "values": values}], constraints.hotel_domain(HOTEL_FIELDS))
    theta = rng.random(len(model.names))
    value, gradient = model.value_and_gradient(theta)
    for i in range(len(theta)):
        moved = theta.copy()
        moved[i] += 1e-5
        assert (model.value_and_gradient(moved)[0] - value) / 1e-5 == pytest.approx(gradient[i], abs=1e-3)


def test_constrained_learning(spark):
    """Expectations under constraints are distributions over labels, break the rules less often, and steer what is learnt."""
    ready = examples.hotel_examples(mentions(spark))
    free = pipelines.prepare(ready, HOTEL_FIELDS, Options(seg_text_weight=1.0))
    bound = pipelines.prepare(ready, HOTEL_FIELDS, Options(seg_text_weight=1.0, constrained_learning=True))
    assert free.setting.domain is learn.PLAIN and bound.setting.domain is bound.domain
    labels = free.setting.labels
    scored = lattice.scored(free.setting.texts(), free.params, labels)
    plain = {r["mention_id"]: r for r in lattice.expectations(scored, free.chain, free.setting.longest).collect()}
    held = {r["mention_id"]: r for r in constraints.constrained_expectations(scored, free.chain, free.setting.longest, bound.domain, only_segmentation=True).collect()}
    words = {r["mention_id"]: r["words"] for r in scored.collect()}

    def broken(posteriors):
        out = 0.0
        for i, r in posteriors.items():
            tokens = np.array(r["tokens"]).reshape(-1, len(labels))
            assert tokens.sum(1) == pytest.approx(np.ones(len(tokens)))
            for k, probabilities in enumerate(tokens):
                hit = {rule.name: rule for rule in constraints.HOTEL_RULES if rule.matches(words[i], k)}
                out += sum(p for rule in hit.values() for x, p in zip(labels, probabilities) if (x in rule.labels) == rule.inside)
        return out

    assert broken(held) < broken(plain)
    one, _ = learn.em(free.setting, free.params, 1)
    two, _ = learn.em(bound.setting, bound.params, 1)
    values = [{(r["kind"], r["label"], r["key"]): r["value"] for r in p.where("model = 'gen'").collect()} for p in (one, two)]
    assert set(values[0]) == set(values[1]) and any(abs(v - values[1][k]) > 1e-6 for k, v in values[0].items())
    joint = pipelines.with_joint(bound)
    _, history = learn.fit_weights(joint.setting, two, 1, use_gen=True, joint=True)
    assert joint.setting.domain is bound.domain and all(map(math.isfinite, history))


def test_constrained_inference_by_option(spark):
    ready = examples.hotel_examples(mentions(spark))
    run = pipelines.prepare(ready, HOTEL_FIELDS, Options(constrained_inference=True))
    rows = lambda df: sorted(map(str, df.select("mention_id", "guess").collect()))
    assert rows(pipelines.segmentation(run)) == rows(pipelines.segmentation(run, constrained=True))


def test_options_bound_scans(spark):
    run = pipelines.prepare(examples.hotel_examples(mentions(spark)), HOTEL_FIELDS, Options(max_records=2, max_texts=1))
    assert sorted(r["mention_id"] for r in run.setting.examples.collect()) == ["r1", "r2", "t1"]


def test_restricted_chain():
    chain = lattice.Chain(["O", "a"], np.full(2, 0.5), np.full((2, 2), 0.5), np.zeros(2), np.zeros((2, 2))).restricted(lambda x: x == "a", lambda x, y: x != y)
    for is_record in (False, True):
        start, step = chain.scores(is_record, True, False)
        assert start[0] == -np.inf and np.isfinite(start[1]) and (step[[0, 1], [0, 1]] == -np.inf).all() and np.isfinite(step[[0, 1], [1, 0]]).all()
    score, best = lattice.viterbi(np.zeros((3, 1, 2)), *chain.scores(False, True, False))
    assert [x for _, _, x in best] == [1, 0, 1] and score == pytest.approx(3 * np.log(0.5))


def test_citation_pipeline(spark):
    """From mentions to reports, with the citation rules."""
    rows = mentions(spark)
    for old, new in (("hotelname", "title"), ("localarea", "author"), ("starrating", "date")):
        rows = rows.withColumn("labels", F.transform("labels", lambda x: F.regexp_replace(x, old, new)))
    options = Options(seg_gen_iterations=1, seg_text_weight=0.5, seg_disc_iterations=1, seg_kl_iterations=0, coref_gen_iterations=1, coref_disc_iterations=0, batch_size=6)
    run, reports = pipelines.citations(examples.citation_examples(rows), options)
    assert run.domain.penalties is constraints.citation_penalties and run.domain.match_share == 0.95
    assert {"segmentation.gen", "segmentation.gen.constrained", "segmentation.disc", "joint.gen.constrained"} <= set(reports)
    assert reports["joint.gen"].first()["n_texts"] == 3


def test_longest_segments(spark):
    values = spark.createDataFrame([("a", ["x", "y"], True), ("a", ["x"] * 5, False), ("b", ["x"], True)], "field string, phrase array<string>, is_observed boolean")
    of = [fields.OTHER, fields.Field("a"), fields.Field("b", least_length=6), fields.Field("c")]
    assert fields.max_lengths(values, of) == {"O": 1, "a": 2, "b": 6, "c": 1}


def test_citation_rules():
    words = ["[1]", "J.", "Smith,", "Proceedings", "1998", "pp.", "1--9"]
    labels = ["O", "author", "booktitle", "date", "pages"]
    found = {p.name: p for p in constraints.citation_penalties(words, labels, 2, np.ones(8, bool))}
    assert found["booktitleField"].segments[3, 0].tolist() == [1, 1, 0, 1, 1]
    assert found["matchesPatternAndNotYear"].segments[4, 0].tolist() == [1, 1, 1, 0, 1]
    assert found["refMarkerIsNotOther"].segments[0, 0].tolist() == [0, 1, 1, 1, 1]
    assert found["nameContainsOnlyInitials"].segments[1, 0].tolist() == [0, 1, 0, 0, 0]
    assert found["matchPatternAndNotPage"].segments[5, 1].tolist() == [2, 2, 2, 2, 0]
    assert found["invalidStart"].starts.tolist() == [0, 0, 1, 1, 1]
    assert found["newAuthorsSegment"].transitions[:, 1].tolist() == [1, 0, 1, 1, 1]


def test_pipelines_end_to_end(spark):
    options = Options(seg_gen_iterations=1, seg_disc_iterations=1, seg_kl_iterations=0, coref_gen_iterations=1, coref_disc_iterations=0, batch_size=3)
    _, reports = pipelines.hotels(examples.hotel_examples(mentions(spark)), options)
    assert {"segmentation.gen", "segmentation.disc.constrained", "joint.gen", "joint.disc.constrained"} <= set(reports)
    assert reports["joint.gen.constrained"].first()["n_texts"] == 3


def test_supervised(spark):
    rows = mentions(spark).where("not is_record").withColumn("labels", F.transform("labels", lambda x: F.regexp_replace(x, "hotelname", "title")))
    ready = examples.citation_examples(rows)
    _, scores = pipelines.supervised(ready, ready, Options(seg_disc_iterations=0))
    assert {r["label"] for r in scores.collect()} >= {"O", "title"}
