"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a score for every key, -ln(u) / weight with u from MD5 of key and shard; the lowest score takes the key.
A further shard wins some keys and moves no others; a shard that goes gives up its own keys only. Native DataFrame code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fine buckets in each shard; slots are numbered bucket by bucket, so that no window holds a whole shard.
BUCKETS = 4096


def _draw(key: Column, salt: str) -> Column:
    """52 hashed bits of key and salt as a long."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}")).cast("binary")), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard (a key of `weights`) that takes `key`, in proportion to the weights.

    Depends on the key's text and on the shards alone. Null keys act as the empty text; ties go to the lower shard number.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive, one for each shard at least")
    text = F.coalesce(key.cast("string"), F.lit(""))
    score = lambda s, w: -F.log((_draw(text, str(s)) + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(w))
    drawn = [F.struct(score(s, w).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return (drawn[0] if len(drawn) == 1 else F.least(*drawn))["shard"]


def with_slots(df: DataFrame, shard: str, key: str, ties: list[str], buckets: int = BUCKETS) -> DataFrame:
    """`df` with `slot`: gapless from 0 in each shard, by (bucket of the key, key, ties).

    Windows hold one bucket of one shard. The bucket offsets that are broadcast number shards x buckets at most.
    Rows equal in key and ties get consecutive slots in any order.
    """
    bucketed = df.withColumn("_bucket", F.pmod(_draw(F.coalesce(F.col(key).cast("string"), F.lit("")), "slot"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(key, *ties))
    return (
        bucketed.withColumn("_rank", rank)
        .join(F.broadcast(offsets), [shard, "_bucket"])
        .withColumn("slot", F.col("_before") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_before")
    )


def shard_records(df: DataFrame, key: str, weights: Mapping[int, float], grown: Mapping[int, float], ties: list[str]) -> DataFrame:
    """`df` with shard, slot and grown_shard (the shard under the `grown` weights).

    Null keys all go to one shard; an empty table stays empty; columns named like the results are replaced.
    """
    placed = df.drop("shard", "slot", "grown_shard").withColumn("shard", rendezvous(F.col(key), weights)).withColumn("grown_shard", rendezvous(F.col(key), grown))
    return with_slots(placed, "shard", key, ties)
