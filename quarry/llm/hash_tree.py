"""Sharding by a hierarchical weighted hash tree (operator 3, native).

A key descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from key and child, and the least draw wins:
children get keys in proportion to their weights, and a changed weight moves keys
only between that child and its siblings. A shard added as a subtree of its own
changes no other weight below the root, so the keys that move go to it alone.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 40
PER_RACK = 5
RACKS_PER_REGION = 2
BUCKETS = 256  # numbering of a shard is split into so many parts


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int = SHARDS) -> list[Leaf]:
    """``shards`` equal shards, five to a rack and two racks to a region."""
    per_region = PER_RACK * RACKS_PER_REGION
    return [Leaf(s // per_region, s // PER_RACK, s) for s in range(shards)]


def grown(tree: Sequence[Leaf]) -> list[Leaf]:
    """The tree and one more shard, in a region of its own."""
    return [
        *tree,
        Leaf(max(x.region for x in tree) + 1, max(x.rack for x in tree) + 1, max(x.shard for x in tree) + 1),
    ]


def _draw(key: str, level: str, children: str) -> str:
    """SQL: the child of the least weighted draw. 52 bits of md5, in (0, 1]."""
    bits = f"cast(conv(substr(md5(concat({key}, '/{level}', c.id)), 1, 13), 16, 10) as bigint)"
    return (
        f"array_min(transform({children}, c -> named_struct('draw', "
        f"-ln(({bits} + 1) / 4503599627370496D) / c.w, 'id', c.id))).id"
    )


def _children(weights: dict[int, float]) -> str:
    return "array(" + ", ".join(f"named_struct('id', {i}, 'w', {w!r}D)" for i, w in sorted(weights.items())) + ")"


def _by_parent(parents: dict[int, dict[int, float]], parent: str) -> str:
    pairs = ", ".join(f"{p}, {_children(c)}" for p, c in sorted(parents.items()))
    return f"element_at(map({pairs}), {parent})"


def place(docs: DataFrame, key: Column, tree: Sequence[Leaf], name: str) -> DataFrame:
    """``docs`` with the shard of each row's ``key`` (a string) as column ``name``."""
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, dict[int, float]] = {}
    for x in tree:
        regions[x.region] = regions.get(x.region, 0.0) + x.weight
        own = racks.setdefault(x.region, {})
        own[x.rack] = own.get(x.rack, 0.0) + x.weight
        shards.setdefault(x.rack, {})[x.shard] = x.weight
    out = (
        docs.withColumn("_key", key)
        .withColumn("_region", F.expr(_draw("_key", "region", _children(regions))))
        .withColumn("_rack", F.expr(_draw("_key", "rack", _by_parent(racks, "_region"))))
        .withColumn(name, F.expr(_draw("_key", "shard", _by_parent(shards, "_rack"))))
    )
    return out.drop("_key", "_region", "_rack")


def shard(docs: DataFrame, shards: int = SHARDS, tree: Sequence[Leaf] | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of
    ``docs(doc_id, text)``; law ``key``: doc_id and the tree decide.

    Slots number a shard's rows from 0 without gaps, by a hash of the doc_id, then
    doc_id, checksum and size. Each of 256 parts of a shard is numbered on its own and
    starts where the counts of those before it end.

    * null text: size 16, checksum 0; empty text alike;
    * null doc_id: a key of its own, placed like any other;
    * rows that repeat a doc_id share its shard; equal rows get slots in any order;
    * an empty table gives no rows; other columns are ignored.
    """
    tree = list(tree or layout(shards))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(place(rows, key, tree, "shard"), key, grown(tree), "grown_shard")
    part = F.conv(F.substring(F.md5(F.concat(key, F.lit("/slot"))), 1, 2), 16, 10).cast("int").alias("part")
    ids = place(docs.select("doc_id"), key, tree, "shard").select("shard", part)
    counts = ids.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.alias("c").selectExpr(
        "shard as s",
        "part as p",
        "sum(n) over (partition by shard order by part rows between unbounded preceding and current row) - n as first",
    )
    numbered = rows.select("*", part).selectExpr(
        "*", "row_number() over (partition by shard, part order by doc_id, text_crc32, size) - 1 as r"
    )
    # at most 256 rows a shard
    return numbered.join(
        F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p"))
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("r")).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )
