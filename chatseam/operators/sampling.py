"""A capped, repeatable sample per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PREFIX = 4


def _draw(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def capped_sample(
    rows: DataFrame,
    group: str,
    key: str,
    cap: int,
    seed: int = 42,
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """``min(cap, size)`` rows of every group: those whose seeded hash is smallest.

    The draw depends on ``(seed, key)`` only, so it survives repartitioning.
    Ranking whole groups would sort a hot group in one task. Instead a count
    per hash prefix tells how much room the smaller prefixes leave in the cap.
    Rows meet that table by group and prefix, so a group of any size is split
    into up to 65,536 keys: prefixes without room go unseen, and rows are ranked
    within their prefix only. ``groups`` keeps the listed groups only.
    """
    if groups is not None:
        rows = rows.where(F.col(group).isin(*groups))
    drawn = rows.withColumn("_draw", _draw(seed, key)).withColumn("_prefix", F.substring("_draw", 1, _PREFIX))
    per_prefix = drawn.groupBy(group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(group).orderBy("_prefix"))
    limits = (
        per_prefix.withColumn("_room", F.lit(cap) - (up_to - F.col("_n")))
        .where("_room > 0")
        .select(F.col(group).alias("_group"), F.col("_prefix").alias("_key"), "_room")
    )
    same = drawn[group].eqNullSafe(limits["_group"]) & (drawn["_prefix"] == limits["_key"])
    place = F.row_number().over(Window.partitionBy(group, "_prefix").orderBy("_draw", key))
    return (
        drawn.join(limits, same)
        .withColumn("_place", place)
        .where("_place <= _room")
        .drop("_draw", "_prefix", "_group", "_key", "_room", "_place")
    )
