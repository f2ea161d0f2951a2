"""The text operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxlake.llm.bpe import encode_documents
from voxlake.llm.decontaminate import contaminated
from voxlake.llm.html_template import extract
from voxlake.llm.lm_score import lattice_scores
from voxlake.llm.metric_join import range_classes
from voxlake.llm.near_dedup import near_duplicate_groups
from voxlake.llm.pii import find_private
from voxlake.llm.quality import importance_resample
from voxlake.llm.substring_dedup import repeated_passages
from voxlake.llm.tables import read
from voxlake.llm.warc import derivatives, page_responses


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read(spark, sf_dir, "documents"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(page_responses(read(spark, sf_dir, "pages")), keep="page_id")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))


def op6_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op7_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(read(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(read(spark, sf_dir, "documents"))


def op9_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_classes(read(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_html_template": op6_html_template,
    "op7_pii_tagger": op7_pii_tagger,
    "op8_lm_score": op8_lm_score,
    "op9_embedding_range_join": op9_embedding_range_join,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x01-\x20]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        p AS (SELECT doc_id, w, CAST(unnest(generate_series(0, len(w) - 50)) AS BIGINT) AS i FROM w WHERE len(w) >= 50),
        k AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM p),
        r AS (SELECT DISTINCT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(DISTINCT (doc_id, i)) > 1)),
        s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM r),
        g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s)
        SELECT doc_id, min(i) AS start_word, max(i) + 50 - min(i) AS n_words FROM g GROUP BY doc_id, island
    """,
    "op9_embedding_range_join": """
        WITH p AS (
            SELECT DISTINCT a.vec_id AS id_a, b.vec_id AS id_b
            FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
            WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95
        ),
        e AS (SELECT id_a AS id, id_b AS other FROM p UNION SELECT id_b, id_a FROM p UNION SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL),
        n AS (SELECT id, string_agg(CAST(other AS VARCHAR), ' ' ORDER BY other) AS others, count(*) - 1 AS links FROM e GROUP BY id),
        m AS (SELECT id, min(id) OVER (PARTITION BY others) AS class_id, links FROM n)
        SELECT 'member' AS kind, id, class_id, links FROM m
        UNION ALL
        SELECT 'link', least(x.class_id, y.class_id), greatest(x.class_id, y.class_id), count(*)
        FROM p JOIN m x ON p.id_a = x.id JOIN m y ON p.id_b = y.id WHERE x.class_id <> y.class_id GROUP BY 2, 3
    """,
}
