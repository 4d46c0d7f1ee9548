"""Sharding by a hierarchical weighted hash tree.

A row descends from the root: at every level each child draws ``ln(u) / weight`` with ``u`` hash-
uniform in the row's id and the child's name, and the largest draw wins, so a child gets its share
of weight. A draw depends on nothing but id, name and weight: when weights change, a row only moves
into subtrees whose weight grew or out of those whose weight shrank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.llm.common import stored, table, with_sum_before
from chatseam.llm.registry import query


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def topology(shards: int, regions: int = 2, racks: int = 3) -> tuple[Shard, ...]:
    """Shards of equal weight, dealt to racks of regions in equal runs."""
    places = [(f"region{r}", f"rack{r}.{k}") for r in range(regions) for k in range(racks)]
    return tuple(Shard(n, *places[n * len(places) // shards]) for n in range(shards))


def with_new_shard(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, in a region and rack of its own: no other subtree's weight changes, so rows only move into it."""
    number = max(s.number for s in tree) + 1
    return (*tree, Shard(number, f"region-of-{number}", f"rack-of-{number}", weight))


def _draw(key: Column, children: dict[str, tuple[float, Column]]) -> Column:
    """The payload of the child with the largest draw; ties go to the larger name."""
    draws = []
    for name, (weight, payload) in children.items():
        uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        draws.append(F.struct((F.ln(uniform) / F.lit(weight)).alias("draw"), F.lit(name).alias("name"), payload.alias("to")))
    return F.array_max(F.array(*draws))["to"]


def shard_of(key: Column, tree: tuple[Shard, ...]) -> Column:
    """The shard number of a key; descends region, rack and shard, drawing among the chosen node's children only."""

    def choice(nodes: dict[str, list[Shard]], below) -> Column:
        weights = {name: sum(s.weight for s in shards) for name, shards in sorted(nodes.items())}
        names = list(weights)
        picked = _draw(key, {name: (weights[name], F.lit(name)) for name in names})
        result = below(nodes[names[-1]])
        for name in reversed(names[:-1]):
            result = F.when(picked == name, below(nodes[name])).otherwise(result)
        return result

    def grouped(shards: list[Shard], field: str) -> dict[str, list[Shard]]:
        groups: dict[str, list[Shard]] = {}
        for shard in shards:
            groups.setdefault(getattr(shard, field), []).append(shard)
        return groups

    def leaf(shards: list[Shard]) -> Column:
        return _draw(key, {f"shard{s.number}": (s.weight, F.lit(s.number)) for s in shards})

    def rack(shards: list[Shard]) -> Column:
        return choice(grouped(shards, "rack"), leaf)

    return choice(grouped([s for s in tree if s.weight > 0], "region"), rack)


def place(documents: DataFrame, tree: tuple[Shard, ...]) -> DataFrame:
    """Shard and slot of every row: ``doc_id, size, text_crc32, shard, slot, grown_shard``.

    ``slot`` counts from 0 within a shard, without gaps, in hash order. ``grown_shard`` is the shard
    after one more is opened. Null or empty text has size 8 and checksum 0. Null ids are one key and
    so go to one shard; so do repeated ids, with a slot for each row. Very long texts are only read
    once, for their length and checksum. An empty table gives an empty result.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(
        documents.select(
            "doc_id",
            (F.octet_length(raw) + 8).cast("bigint").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            shard_of(F.col("doc_id"), tree).alias("shard"),
            shard_of(F.col("doc_id"), with_new_shard(tree)).alias("grown_shard"),
        ).withColumn("_key", F.shiftrightunsigned(F.xxhash64("doc_id", "size", "text_crc32"), 4))
    )
    return with_sum_before(
        rows, "shard", "_key", F.lit(1).cast("bigint"), "slot", ("doc_id", "size", "text_crc32"), bits=10
    ).drop("_key")


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(table(spark, sf_dir, "documents"), topology(24))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard"
    )
