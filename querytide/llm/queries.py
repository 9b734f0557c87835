"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.llm import (
    backtracking_bpe,
    cholesky_whitening,
    circulant_minhash,
    collision_search,
    decision_list,
    decontaminate,
    four_russians,
    line_edit_join,
    relative_lempel_ziv,
    site_template,
    skip_chain,
    token_files,
    warc_salvage,
)
from querytide.llm.common import table
from querytide.session import shared_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "op1-archives")
    pages = table(spark, sf_dir, "pages")
    warc_salvage.write_archives(warc_salvage.with_revisits(pages, "page_id", "url", "html"), path)
    found = warc_salvage.read_archives(spark, path, payloads=False).filter("gap IS NULL")

    def page(column: str):
        return F.regexp_extract(column, r"^urn:page:(-?\d+)$", 1).try_cast("long")

    return found.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edit_join.line_report(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtracking_bpe.digests(
        backtracking_bpe.encode_and_decode(table(spark, sf_dir, "documents"), VOCABULARY)
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lempel_ziv.kept_digests(relative_lempel_ziv.factor(table(spark, sf_dir, "documents")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_template.extract(table(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "op8-tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), VOCABULARY, path, end_id=1)
    return token_files.with_crc32(token_files.read_token_files(spark, path))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.leak_digests(found)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_chain.span_digests(skip_chain.find_personal_data(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", turned)
    return four_russians.hard_negatives(rows, lambda i: i % 100 == 0, "vec_id", "embedding", "label")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, "vec_id", "embedding")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cholesky_whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe": op4_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_main_text": op7_main_text,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_personal_data": op10_personal_data,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_nearest": op12_nearest,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
        o AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS original FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
            CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> original THEN original END AS refers_to
        FROM o
    """,
    "op11_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
              list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
          SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label,
              list_inner_product(a.vec, c.vec)::BIGINT AS score
          FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
        ),
        p AS (
          SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
            (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE label <> p.anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
}
