"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_codec, embedding_dedup, exact_dedup, language_id, mixing, ngram_join, secrets_scan, token_counts, token_store, toxicity
from .common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    scored = toxicity.toxic_spans(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), toxicity.joined_spans("spans").alias("spans"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs, crc_mod("doc_id", 4) != 2)
    return language_id.identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_counts(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_codec.byte_encode(_table(spark, sf_dir, "documents"), with_ids=False)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.secret_spans(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in secrets_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_tokens(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1,
    "op2_toxicity": op2,
    "op3_language_id": op3,
    "op4_ngram_jaccard_join": op4,
    "op5_embedding_dedup": op5,
    "op6_source_mixing": op6,
    "op7_token_counts": op7,
    "op8_byte_bpe": op8,
    "op9_secret_scan": op9,
    "op10_token_store": op10,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
    """,
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT l.a, l.b FROM l JOIN n x ON x.doc_id = l.a JOIN n y ON y.doc_id = l.b WHERE 100 * l.c >= 80 * (x.n + y.n - l.c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.a = w.doc_id GROUP BY 1, 2
    """,
    "op6_source_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{mixing.SEED}'), 1, {mixing.PLACE_DIGITS}))::BIGINT AS place FROM documents),
        p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, 2 * source_size AS cap FROM p),
        x AS (SELECT *, CASE k % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight FROM w),
        f AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM x),
        t AS (SELECT source, k, source_size, coalesce(least(cap::DOUBLE, weight * (SELECT arg_min(level, cap / weight) FROM f WHERE level <= cap / weight)), cap::DOUBLE) AS target FROM f),
        h AS (SELECT *, sum(target) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS hi FROM t),
        g AS (SELECT max(hi) AS total, least(1024, greatest(1, floor(max(hi) / 1048576)))::BIGINT AS block FROM h),
        e AS (SELECT k, floor((hi - target) / total * 2147483648)::BIGINT AS a, CASE WHEN hi >= total THEN 2147483648 ELSE floor(hi / total * 2147483648)::BIGINT END AS b FROM h, g WHERE target > 0),
        s AS (SELECT slot, ((slot + 1) % 2147483648 * {mixing.GOLDEN}) % 2147483648 AS u FROM (SELECT unnest(range(0, ceil(total / block)::BIGINT)) AS slot FROM g)),
        r AS (SELECT k, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS j FROM s JOIN e ON u >= a AND u < b),
        n AS (SELECT k, count(*) AS blocks FROM r GROUP BY k),
        o AS (SELECT d.doc_id, d.size, t.k, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY t.k ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
            FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
        SELECT o.doc_id, o.size, o.source_size, o.target, (greatest(0, least(first + size, coalesce(blocks, 0) * block) - first) + greatest(0, least(first + source_size + size, coalesce(blocks, 0) * block) - first - source_size))::BIGINT AS taken, coalesce(r.slot, -1) AS first_slot
        FROM o CROSS JOIN g LEFT JOIN n ON n.k = o.k LEFT JOIN r ON r.k = o.k AND o.size > 0 AND r.j = o.first // g.block
    """,
    "op5_embedding_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT x.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, x.vec_id = c.component_id AS kept
        FROM embeddings x JOIN c ON c.a = x.vec_id LEFT JOIN n ON n.a = x.vec_id
    """,
}
