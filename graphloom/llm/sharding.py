"""Sharding by weighted rendezvous hashing of stable record keys.

Each shard draws a score from the key and its own name; the highest score
gets the record. A new shard takes records from the others and moves none
between them. The place of a record within its shard is gapless; it comes
from counts by (shard, part of the key's hash) and a rank within such a part,
so no task ever orders a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import without

PARTS = 256


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard whose weighted score -w / ln(u) is highest, u in (0, 1) drawn from (key, shard).

    Scores tie with a chance of 2**-53; then the greater shard number wins.
    A null key hashes as its shard number alone, so all null keys share a shard.
    Repeated and very long keys are like any other; no other column is read.
    """
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights) if w > 0])

    def score(s):
        u = (F.shiftrightunsigned(F.xxhash64(s["i"], key), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-s["w"] / F.log(u)).alias("score"), s["i"].alias("i"))

    return F.array_max(F.transform(table, score))["i"]


def assign_shards(df: DataFrame, key: str = "doc_id", weights: list[float] | None = None, n_shards: int = 40, grown_weight: float = 1.0, order: tuple[str, ...] = (), parts: int = PARTS) -> DataFrame:
    """Adds shard, slot (gapless from 0 in each shard) and grown_shard (with one more shard).

    slot follows (part of the key's hash, key, ``order``); rows equal in all
    of these are interchangeable. The same key always gets the same shard,
    null included. Shards of weight 0 get nothing. Input columns of these
    names are replaced. Empty tables give empty results.
    """
    weights = list(weights or [1.0] * n_shards)
    k = F.col(f"`{key}`")
    base = without(df, "shard", "slot", "grown_shard")
    columns, sorts = [f"c{i}" for i in range(len(base.columns))], [f"s{i}" for i in range(len(order))]
    part = F.pmod(F.xxhash64(F.lit(7), k), F.lit(parts))
    placed = base.select(k, shard_of(k, weights), part, *[F.col(f"`{c}`") for c in order], *[F.col(f"`{c}`") for c in base.columns]).toDF("key", "shard", "part", *sorts, *columns)
    # At most shards * parts rows, whatever the input.
    counts = base.select(shard_of(k, weights).alias("shard"), part.alias("part")).groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("of_shard"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "part").orderBy("key", *sorts)
    ranked = placed.withColumn("rank", F.row_number().over(inner) - 1)
    joined = ranked.join(F.broadcast(starts), (F.col("shard") == F.col("of_shard")) & (F.col("part") == F.col("of_part")))
    own = [F.col(p).alias(c) for p, c in zip(columns, base.columns, strict=True)]
    return joined.select(*own, "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), shard_of(F.col("key"), [*weights, grown_weight]).alias("grown_shard"))
