"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Every document descends from the root through region and rack to a shard. On each level the children draw
a number each from a hash of (document, child), and the child with the smallest ``-ln(u) / weight`` wins.
A child's draw depends on nothing but the document and the child, so a document leaves a child only if
weights change there or beside it: within a subtree whose weights stay, nothing moves.

Law ``key``: shard and grown shard depend on ``doc_id`` and the topology alone. An added shard opens a
region of its own; the draws of the old regions stay as they are, so a document either stays where it is
or goes to the added shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendery.llm.common import table

RACKS_PER_REGION = 2
SHARDS_PER_RACK = 2
# Slots are numbered within (shard, bucket); a bucket is a 16-bit prefix of a hash, so that at most
# shards * 65,536 counts exist whatever the input is. They are broadcast: 16 bytes each.
BUCKET_DIGITS = 4
_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def topology(shards: int, added: int = 0) -> list[Shard]:
    """Regular tree of ``shards`` shards of equal weight; each added one opens a region of its own."""
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    regular = [
        Shard(n, f"r{n // per_region}", f"r{n // per_region}/k{n % per_region // SHARDS_PER_RACK}")
        for n in range(shards)
    ]
    return regular + [Shard(n, f"x{n}", f"x{n}/k0") for n in range(shards, shards + added)]


def _draw(key: Column, child: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{child}"))), 1, _DIGITS), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 4 * _DIGITS)) / F.lit(weight)


def _winner(key: Column, children: dict[str, tuple[float, Column]]) -> Column:
    """The result of the child with the smallest draw; equal draws go to the child named first."""
    if len(children) == 1:
        return next(iter(children.values()))[1]
    return F.array_min(
        F.array(
            *[
                F.struct(_draw(key, name, weight).alias("draw"), F.lit(i).alias("at"), result.alias("shard"))
                for i, (name, (weight, result)) in enumerate(children.items())
            ]
        )
    )["shard"]


def descend(key: Column, shards: list[Shard]) -> Column:
    """Shard number of a key: one weighted draw on each level."""
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)

    def rack(members: list[Shard]) -> tuple[float, Column]:
        leaves = {f"{s.rack}/s{s.number}": (s.weight, F.lit(s.number)) for s in members}
        return sum(s.weight for s in members), _winner(key, leaves)

    def region(racks: dict[str, list[Shard]]) -> tuple[float, Column]:
        inner = {name: rack(members) for name, members in racks.items()}
        return sum(w for w, _ in inner.values()), _winner(key, inner)

    return _winner(key, {name: region(racks) for name, racks in regions.items()})


def shard_documents(documents: DataFrame, shards: list[Shard], grown: list[Shard]) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the number of UTF-8 bytes plus 1; a null text has none (size 1, checksum of the empty text).
    Documents without an id share the key of the empty text. Rows that share an id share a shard; each gets
    a slot of its own. An empty table gives no rows. Other columns are not looked at.

    Slots are gapless from 0 in every shard. Counts per (shard, hash bucket) are aggregated before the
    shuffle, their running totals are a bounded table, and rows are only numbered inside their bucket, so
    no task holds a whole shard.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, shards).cast("int").alias("shard"),
        descend(key, grown).cast("int").alias("grown_shard"),
        F.substring(F.md5(F.concat(key, F.lit("|bucket|"), F.crc32(text.cast("binary")).cast("string"))), 1, BUCKET_DIGITS).alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("shard").alias("at_shard"),
        F.col("bucket").alias("at_bucket"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    local = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    return (
        rows.withColumn("local", local)
        .join(
            F.broadcast(starts),
            (F.col("shard") == F.col("at_shard")) & (F.col("bucket") == F.col("at_bucket")),
        )
        .select(
            "doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("local")).cast("bigint").alias("slot"), "grown_shard"
        )
    )


SHARDS = 8


def op6_hash_tree_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"), topology(SHARDS), topology(SHARDS, added=1))

