"""The corpus pipeline's stages, one after the other, against what each of them promises."""

import subprocess
import sys

import corpus_pipeline
import pytest
from edge import documents
from pyspark.sql import functions as F

from reclink.llm import bpe, mixing, quality, simhash, substring_dedup
from reclink.llm.queries import vocabulary


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    folder, rows, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{data}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, data).write.parquet(str(folder / str(k)))
        done = spark.read.parquet(str(folder / str(k)))
        out.append((name, rows, done))
        rows = done
    return out


def test_columns(stages, docs):
    for _, _, after in stages[:-1]:
        assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]


def test_quality_stage(spark, stages, data):
    _, before, after = stages[0]
    model = quality.fit(before, spark.read.parquet(f"{data}/labels.parquet"))
    kept = quality.assess(before, model, F.col("source"), F.col("lang")).where("q_keep").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in after.select("doc_id").collect())


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    groups = simhash.similar_documents(before).collect()
    assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in groups}


def test_substring_stage(stages):
    _, before, after = stages[2]
    expected = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(before).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_mixing_stage(stages):
    _, before, after = stages[3]
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mix(before).collect()}
    found = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert found == {i: n for i, n in copies.items() if n}


def test_bpe_stage(spark, stages, data):
    _, before, after = stages[4]
    assert after.count() == before.count()
    own = bpe.load(vocabulary())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(bytes(r["ids"]) == own.encode_batch([texts[r["doc_id"]] or ""])[0] for r in after.collect())
    assert corpus_pipeline.run(spark, data).count() == after.count()


def test_awkward_documents_go_through(spark, data):
    rows = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, data)
        assert rows.columns == documents(spark).columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, data).count() == rows.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark).where("false"), data).count() == 0


def test_nothing_else_imports_the_subpackage():
    code = "import sys, reclink.plans.queries, reclink.plans.pipelines, reclink.streaming.decoding, reclink.sources.sinks; sys.exit(any(m.startswith('reclink.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rpartition("/")[0]).returncode == 0
