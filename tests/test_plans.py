"""Sources, sinks, evaluation, streaming; and every registered query against its SQL."""

import math

import duckdb
import pytest
from corpus import mentions, one
from pyspark.sql import functions as F

import __spark_entry__ as contract
from reclink.config import Options, Settings
from reclink.functions import phrases
from reclink.operators import evaluate, learn, params
from reclink.plans import examples, inputs, pipelines
from reclink.plans.queries import ORACLE_SQL, QUERIES
from reclink.sources import mentions as M
from reclink.sources import sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert _rows(df.columns, df.collect()) == _rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() == 3
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_linkage_prunes_columns_and_joins_by_key(spark, data):
    plan = QUERIES["passage_linkage"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "n_chars" not in plan


def test_settings(tmp_path):
    path = tmp_path / "a.properties"
    path.write_text("# note\nn = 3\nx=0.5\nyes=true\nmany=a, b\n")
    s = Settings.load(str(tmp_path / "missing"), str(path))
    assert (s.get("n", int), s.get("x", float), s.get("yes", bool), s.get_list("many"), s.get("none", str, "d")) == (3, 0.5, True, ["a", "b"], "d")
    with pytest.raises(KeyError):
        s.get("none")


def test_options():
    assert [Options().step_size(t) for t in range(3)] == pytest.approx([2**-0.5, 3**-0.5, 0.5])
    assert Options.from_flags(["--segcoref.batch_size", "5", "--step-mult", "2"]).batch_size == 5
    with pytest.raises(KeyError):
        Options.from_flags(["--nothing", "1"])


def test_labelled_file(spark, tmp_path):
    path = tmp_path / "labelled.txt"
    path.write_text("<author>A. Smith</author>, <title>On Joins</title>. <conference>Proc. X</conference>, <date>1998</date>\n\n<title>B</title>\n")
    rows = M.labelled_citations(spark, str(path)).collect()
    first = next(r for r in rows if len(r["words"]) > 1)
    assert len(rows) == 2 and "B-booktitle" in first["labels"] and len(first["words"]) == len(first["labels"])


def test_prepare_and_quarantine(spark, tmp_path):
    raw = spark.createDataFrame([("1", "dblp", "<title>On Joins</title>", "c"), ("2", "texts", "<title>X</title> y", None), ("3", "texts", "", None)], "_id string, sourceId string, sgml string, clusterId string")
    good, bad = M.prepare(raw, citation=True, record_source="dblp")
    found = {r["mention_id"]: r for r in good.collect()}
    assert set(found) == {"1", "2"} and found["1"]["is_record"] and not found["2"]["is_record"] and found["2"]["labels"] == ["B-title", "O"]
    sinks.write_quarantine(bad, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    M.write_mentions(good, str(tmp_path / "m"))
    assert M.records(M.read_mentions(spark, str(tmp_path / "m"))).count() == 1


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.txt").write_text("alpha\nbeta gamma\n\n")
    assert M.dictionary(spark, str(tmp_path / "none"), str(tmp_path / "d.txt")).count() == 2
    assert M.dictionary(spark, str(tmp_path / "none")).count() == 0


def test_positions_with_ties_and_strings(spark):
    rows = spark.createDataFrame([(f"k{i % 37:03d}", i) for i in range(500)], "k string, i int")
    assert sorted(r["position"] for r in M.positions(rows, "k").collect()) == list(range(1, 501))
    ordered = [r["k"] for r in M.positions(rows, "k").orderBy("position").collect()]
    assert ordered == sorted(ordered)
    assert M.positions(rows.where("false"), "i").count() == 0


def test_scans_with_limits(spark):
    rows = mentions(spark)
    assert [r["mention_id"] for r in M.records(rows, 2).collect()] == ["r1", "r2"]
    assert [r["mention_id"] for r in M.texts(rows, 1).collect()] == ["t1"]
    keys = {r["mention_id"]: r["rndkey"] for r in M.with_random_keys(rows, 1, 6, most=4).collect()}
    assert [k for k, v in keys.items() if v == 2_147_483_647] == ["t2", "t3"]


def test_phrase_matching_is_shortest_first_and_does_not_overlap(spark):
    lexicon = phrases.phrases(spark.createDataFrame([("a b",), ("a b c",), ("b c",), ("d",)], "entry string"))
    mark = phrases.matcher(lexicon, "X")
    assert one(spark, mark(F.col("w")), w=["a", "b", "c", "d", "b", "c"]) == ["X", "X", None, "X", "X", "X"]
    rows = spark.createDataFrame([("m", ["a", "b", "c"])], "mention_id string, words array<string>")
    assert {(r["begin"], r["end"]) for r in phrases.phrase_starts(rows, lexicon, 3).collect()} == {(0, 2), (1, 3)}


def test_long_phrase_lists_match_the_same(spark):
    lexicon = phrases.phrases(spark.createDataFrame([("a b",), ("a b c",), ("b c",), ("d",), ("c a",)], "entry string"))
    texts = [["a", "b", "c", "d", "b", "c"], ["c", "a", "b", "c", "a"], [], None, ["x"], ["A", "b"]]
    rows = spark.createDataFrame([(str(i), w) for i, w in enumerate(texts)], "mention_id string, words array<string>")
    for lower in (False, True):
        short = {r["mention_id"]: r["phrase_marks"] for r in phrases.with_marks(rows, lexicon, "X", lower).collect()}
        long = {r["mention_id"]: r["phrase_marks"] for r in phrases.with_marks(rows, lexicon, "X", lower, most=2).collect()}
        assert short == long and short["0"] == ["X", "X", None, "X", "X", "X"]


def test_ww_files(spark, tmp_path):
    made = ['>>\n>word\n0\t"a"\n\n>mention\n\n', '>>\n>word\n0\t"b"\n\n>mention\n0\t0\t"x"\n']
    evaluate.write_ww(spark.createDataFrame([(w,) for w in made], "ww string").coalesce(1), str(tmp_path / "ww"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "ww").glob("part-*")))
    assert text == "".join(w + "\n\n" for w in made)


def test_vocabularies(spark, tmp_path):
    terms = [("word", t) for t in ("b", "a", "ab", "a", "ä")] + [("feature", "z")]
    sinks.write_vocabulary(spark.createDataFrame(terms, "kind string, term string"), str(tmp_path / "v"))
    known = sinks.read_vocabulary(spark, str(tmp_path / "v"), "word")
    assert {r["term"]: r["id"] for r in known.collect()} == {"a": 0, "ab": 1, "b": 2, "ä": 3}
    assert sinks.ids_of(spark.createDataFrame([("none",)], "term string"), known).first()["id"] == -1
    assert sinks.terms_of(spark.createDataFrame([(7,)], "id bigint"), known).first()["term"] is None
    sinks.write_vocabulary(spark.createDataFrame([], "kind string, term string"), str(tmp_path / "e"))


def test_segments_grow(spark):
    none = F.array().cast(evaluate.SEGMENTS)
    first = one(spark, evaluate.appended(none, F.lit("a"), F.lit(2)))
    assert [(s["begin"], s["end"], s["label"]) for s in first] == [(0, 2, "a")]
    both = one(spark, evaluate.prepended(evaluate.appended(none, F.lit("a"), F.lit(2)), F.lit("b"), F.lit(1)))
    assert [(s["begin"], s["end"], s["label"]) for s in both] == [(0, 1, "b"), (1, 3, "a")]


def test_online_learner_goes_on(spark, tmp_path):
    """A batch that comes again counts once, and a new learner goes on from the tables."""
    from reclink.streaming.decoding import OnlineLearner

    ready = examples.hotel_examples(mentions(spark))
    run = pipelines.prepare(ready, inputs.PART_FIELDS[:1], Options())
    weights = lambda x: sorted((r["kind"], r["label"], str(r["key"]), round(r["value"], 9)) for r in x.params.where("model = 'disc'").collect())
    one_go = OnlineLearner(run.setting, run.params)
    for _ in range(2):
        one_go.step(ready)
    kept = OnlineLearner(run.setting, run.params, path=f"file://{tmp_path}/state")
    kept.step(ready, 0)
    again = OnlineLearner(run.setting, run.params, path=f"file://{tmp_path}/state")
    assert again.updates == 1 and weights(again) == weights(kept)
    again.step(ready, 0)
    again.step(ready, 1)
    assert again.updates == 2 and weights(again) == weights(one_go) and again.objective == pytest.approx(one_go.objective)


def test_citation_examples(spark):
    rows = mentions(spark)
    lexicons = [examples.Lexicon("AREA", spark.createDataFrame([("Downtown",)], "entry string")), examples.Lexicon("INN", spark.createDataFrame([("red lion",)], "entry string"), phrases=True)]
    known = spark.createDataFrame([("red",), ("lion",)], "term string")
    found = {r["mention_id"]: r for r in examples.citation_examples(rows, lexicons, known).collect()}
    assert "LEXICON=AREA" in found["r2"]["feats"][2] and "INN" in found["r1"]["feats"][0]
    assert any(f.endswith("@1") for f in found["t1"]["feats"][0]) and not any("@" in f for f in found["r1"]["feats"][0])
    assert found["r1"]["word_features"][:3] == ["red", "lion", "$OOV$"]


@pytest.mark.parametrize(("words", "segments", "expected"), [([",", "red", "lion", "."], [(0, 4, "h")], [(0, 1, "O"), (1, 3, "h"), (3, 4, "O")]), (["-", "."], [(0, 2, "h")], [(0, 2, "O")]), (["a", "-", "b"], [(0, 3, "h")], [(0, 3, "h")])])
def test_punctuation(spark, words, segments, expected):
    made = F.array(*[F.struct(F.lit(b).alias("begin"), F.lit(e).alias("end"), F.lit(x).alias("label")) for b, e, x in segments])
    found = one(spark, evaluate.adjusted(F.col("w"), made), w=words)
    assert [(s["begin"], s["end"], s["label"]) for s in found] == expected
    assert one(spark, evaluate.valid_segments(made))


def test_ww(spark):
    made = F.array(F.struct(F.lit(0).alias("begin"), F.lit(2).alias("end"), F.lit("hotelname").alias("label")))
    assert one(spark, evaluate.ww_text(F.col("w"), made), w=["red", "lion"]) == '>>\n>word\n0\t"red"\n1\t"lion"\n\n>mention\n0\t1\t"hotelname"\n'


def test_coref_scores_count_missing_clusters(spark):
    rows = spark.createDataFrame([("a", "a"), (None, None), ("b", None), (None, "c")], "true_cluster string, guess_cluster string")
    r = evaluate.coref_scores(rows).first()
    assert (r["correct_literal"], r["correct"], r["possible"], r["predicted"]) == (2, 1, 2, 2)
    assert r["precision_literal"] == 1.0 and r["precision"] == 0.5


def test_empty_evaluation(spark):
    rows = spark.createDataFrame([], "true_cluster string, guess_cluster string")
    assert evaluate.coref_scores(rows).first()["accuracy"] is None


def test_params_files(spark, tmp_path):
    rows = spark.createDataFrame([("gen", "S", "a", None, 0.5), ("gen", "T", "a", "b", 0.25), ("gen", "E", "a", "w", 0.0)], "model string, kind string, label string, key string, value double")
    sinks.write_params(rows, str(tmp_path / "p"))
    assert sinks.read_params(spark, str(tmp_path / "p")).count() == 3
    sinks.write_params_text(rows, str(tmp_path / "t"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()} == {"S\ta\t0.500000", "T\ta\tb\t0.250000"}
    assert params.dot(rows, rows).first()["dot"] == pytest.approx(0.3125)


def test_streams(spark, tmp_path):
    from reclink.streaming.decoding import OnlineLearner, arrivals, decode_stream

    rows = mentions(spark)
    rows.write.parquet(str(tmp_path / "in"))
    run = pipelines.prepare(examples.hotel_examples(rows), inputs.PART_FIELDS[:1], Options())
    incoming = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    decode_stream(incoming, examples.hotel_examples, run.params, run.setting.labels, run.setting.longest, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    learner = OnlineLearner(run.setting, run.params)
    examples.hotel_examples(rows).write.parquet(str(tmp_path / "ex"))
    stream = spark.readStream.schema(examples.hotel_examples(rows).schema).parquet(str(tmp_path / "ex"))
    learner.run(stream, str(tmp_path / "check2")).awaitTermination()
    assert learner.updates == 1 and math.isfinite(learner.objective[0])
    timed = spark.readStream.format("rate").load()
    assert arrivals(timed, "timestamp", "1 minute", "10 seconds", ["value"]).isStreaming


def test_failures_are_reported(spark):
    rows = spark.createDataFrame([("m", -math.inf, [0.0], [0.0], [0.0], "no segmentation is allowed")], "mention_id string, log_z double, tokens array<double>, starts array<double>, transitions array<double>, error string")
    assert learn.failures(rows).first()["error"] == "no segmentation is allowed"
