"""Top-k lists: count descending, then query ascending by bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytide.errors import InvalidArgumentError
from querytide.settings import TOP_LIMIT_DEFAULT, TOP_LIMIT_MAX, TOP_LIMIT_MIN


def top_order() -> list[Column]:
    return [F.desc("count"), F.asc("query")]


def top_k(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent queries; planned as a heap per partition and one merge of k rows each."""
    if k < 1:
        raise InvalidArgumentError(f"k must be at least 1, got {k}")
    return counts.select("query", "count").orderBy(*top_order()).limit(k)


def trim(top: DataFrame, n: int) -> DataFrame:
    """The first n rows of a published top list; n <= 0 returns all of it."""
    ordered = top.select("query", "count").orderBy(*top_order())
    return ordered if n <= 0 else ordered.limit(n)


def requested_limit(limit: int | None = None) -> int:
    """The public contract: 50 unless given, and 1 to 100."""
    if limit is None:
        return TOP_LIMIT_DEFAULT
    if not TOP_LIMIT_MIN <= limit <= TOP_LIMIT_MAX:
        raise InvalidArgumentError(f"limit must be {TOP_LIMIT_MIN} to {TOP_LIMIT_MAX}, got {limit}")
    return limit


def first_k_per_group(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: Sequence[str], salts: int = 64
) -> DataFrame:
    """The first k rows of every group, with their position in column `rank`.

    Up to the session's window-group-limit threshold Catalyst cuts each map task's share of a group to k rows before
    the shuffle. Above it the same is done by hand: rank within (group, salt), keep k, rank the survivors.
    `spread` names the columns that tell the rows of a group apart; the salt comes from them.
    """
    threshold = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > threshold:
        salt = F.pmod(F.xxhash64(*spread), F.lit(salts))
        per_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = (
            rows.withColumn("_salt", salt)
            .withColumn("rank", F.row_number().over(per_salt))
            .where(F.col("rank") <= k)
            .drop("_salt", "rank")
        )
    per_group = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(per_group)).where(F.col("rank") <= k)
