"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, BPE encoding.

Each stage gets what the one before it kept, written and read again; so when a stage is called, the tables that the stage
before it has stored on its way are not needed any more, and are deleted. Stages that change texts keep n_chars in step. A
document whose lines all repeat earlier ones stays, with an empty text. ORACLE_SQL is None: the learned rules, the edit join, the similarity
components and the token merges have no SQL; the tests compare run() with a brute-force version instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.llm import backtracking_bpe, circulant_minhash, decision_list, decontaminate, line_edit_join
from querytide.llm.common import table
from querytide.llm.queries import VOCABULARY
from querytide.session import drop_stored, stored, stored_paths

#: Tables that the last stage of an application has stored.
_OF_LAST_STAGE: dict[str, list[str]] = {}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _alone(stage: Stage) -> Stage:
    """The stage, without what the one before it has left."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        drop_stored(spark, _OF_LAST_STAGE.pop(application, []))
        before = set(stored_paths(spark))
        result = stage(spark, docs, sf_dir)
        _OF_LAST_STAGE[application] = [path for path in stored_paths(spark) if path not in before]
        return result

    return run_stage


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


@_alone
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    return decision_list.accepted(docs, table(spark, sf_dir, "labels"))


@_alone
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go."""
    return _counted(line_edit_join.without_repeated_lines(docs))


@_alone
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return circulant_minhash.one_of_each(docs)


@_alone
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return _counted(decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")))


@_alone
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text."""
    return backtracking_bpe.encode_and_decode(docs, VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", encoding),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
