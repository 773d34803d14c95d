"""Rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the least -ln(u) / weight, u a uniform hash of record and shard. Each
shard wins with a chance in proportion to its weight, whatever the others; one more shard takes
records only into itself. Built from Spark functions alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import numbered

SHARDS, SLOT_ROWS = 24, 8192


def cost(key: Column, shard: Column | int, weight: Column | float = 1.0) -> Column:
    uniform = (F.pmod(F.xxhash64(key, F.lit(shard) if isinstance(shard, int) else shard), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8 (null: 8), text_crc32 null for a null text. A null doc_id is a
    key like any other. Equal texts with different ids are placed apart: the law is `key`. Slots count
    from 0 within a shard, in the order of hash, doc_id and text_crc32; repeated rows get a slot each.
    Slots come from counts of small hash ranges, so that no task sorts a shard; equal rows are counted
    before anything is shuffled and numbered by many tasks. An empty table gives an empty result.
    """
    key, n = F.col("doc_id"), len(weights)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    best = F.array_min(F.array(*[F.struct(cost(key, i, float(w)).alias("c"), F.lit(i).alias("i")) for i, w in enumerate(weights)]))
    slim = slim.withColumn("best", best).withColumn("grown", cost(key, n, grown_weight))
    slim = slim.select("doc_id", "size", "text_crc32", F.col("best.i").alias("shard"), F.when(F.col("grown") < F.col("best.c"), n).otherwise(F.col("best.i")).alias("grown_shard"))
    ranges = max(16, -(-docs.count() // (n * SLOT_ROWS)))
    slim = slim.withColumn("range", F.pmod(F.xxhash64("doc_id", F.lit("slot"), "text_crc32"), F.lit(ranges)).cast("int"))
    equal = slim.groupBy(*slim.columns).agg(F.count("*").alias("copies"))
    counts = slim.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = equal.join(offsets, ["shard", "range"]).withColumn("first", F.col("offset") + F.coalesce(F.sum("copies").over(within), F.lit(0)))
    out = lambda rows, slot: rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")
    # One of each, then what it has of equals.
    more = numbered(rows.where("copies > 1").withColumn("others", F.col("copies") - 1), "others", "doc_id", "text_crc32")
    return out(rows, F.col("first")).unionAll(out(more, F.col("first") + F.col("i") + 1))
