"""The queries of this subpackage over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.session import ship


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reclink.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reclink.llm.quality import assess, fit

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"))
    return assess(docs, model, F.col("source"), F.col("lang")).select("doc_id", "source", "lang", "q_evidence", "q_host", "q_path", "q_score", "q_keep")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reclink.llm.substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents"), digests=True)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reclink.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reclink.llm.token_store import write_store

    return write_store(_table(spark, sf_dir, "documents"), vocabulary(), end_id=1).documents()


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reclink.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reclink.llm.jpeg import media_features, store_texts

    return media_features(store_texts(_table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reclink.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_tokens", "mix_weight", "mix_copies")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reclink.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), vocabulary(), outputs=())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reclink.llm.warc import read_archives, write_archives

    return read_archives(spark, write_archives(_table(spark, sf_dir, "pages")), payloads=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_nearest": op4_nearest,
    "op5_token_store": op5_token_store,
    "op6_simhash": op6_simhash,
    "op7_media": op7_media,
    "op8_mixing": op8_mixing,
    "op9_bpe": op9_bpe,
    "op10_warc": op10_warc,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op8_mixing": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s, md5(coalesce(doc_id::VARCHAR, 'null') || ':17') AS h,
                                    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS mix_tokens FROM documents),
        t AS (SELECT s, sum(mix_tokens)::BIGINT AS tokens FROM d GROUP BY s),
        q AS (SELECT s, tokens, tokens / (SELECT sum(tokens) FROM t) AS q FROM t WHERE tokens > 0),
        e AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
              SELECT i + 1, CASE WHEN h >= 0.95 * ln(n) THEN m ELSE lo END, CASE WHEN h >= 0.95 * ln(n) THEN hi ELSE m END
              FROM (SELECT i, lo, hi, m, (SELECT ln(sum(pow(q, m))) - m * sum(pow(q, m) * ln(q)) / sum(pow(q, m)) FROM q) AS h, (SELECT count(*) FROM q) AS n
                    FROM (SELECT *, (lo + hi) / 2 AS m FROM e WHERE i < 40))),
        r AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
              SELECT i + 1, CASE WHEN k <= 4 THEN lo ELSE m END, CASE WHEN k <= 4 THEN m ELSE hi END
              FROM (SELECT i, lo, hi, m, (SELECT max(pow(q, m) / q) / sum(pow(q, m)) FROM q) AS k FROM (SELECT *, (lo + hi) / 2 AS m FROM r WHERE i < 40))),
        a AS (SELECT CASE WHEN (SELECT count(*) FROM q) < 2 THEN 1.0 ELSE round(greatest(
                  CASE WHEN (SELECT -sum(q * ln(q)) FROM q) >= 0.95 * ln((SELECT count(*) FROM q)) THEN 1.0 ELSE (SELECT lo FROM e WHERE i = 40) END,
                  CASE WHEN (SELECT hi FROM r WHERE i = 40) > 1e-9 THEN (SELECT hi FROM r WHERE i = 40) ELSE 0.0 END), 6) END AS a),
        w AS (SELECT s, tokens, round(pow(q, (SELECT a FROM a)) / (SELECT sum(pow(q, (SELECT a FROM a))) FROM q), 9) AS w FROM q),
        b AS (SELECT s, tokens, w, floor(w * (SELECT sum(tokens) FROM t))::BIGINT AS budget FROM w),
        c AS (SELECT d.*, w, budget // tokens AS whole, budget % tokens AS rest, sum(mix_tokens) OVER (PARTITION BY d.s ORDER BY h, mix_tokens ROWS UNBOUNDED PRECEDING) AS so_far FROM d LEFT JOIN b USING (s))
        SELECT doc_id, source, mix_tokens, coalesce(w, 0.0)::DOUBLE AS mix_weight, coalesce(whole + (so_far <= rest)::INT, 0)::BIGINT AS mix_copies FROM c""",
    "op10_warc": """
        WITH d AS (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS original FROM d)
        SELECT page_id, url, CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type, payload_bytes, payload_digest,
               CASE WHEN page_id < original THEN original END AS refers_to FROM m""",
}
