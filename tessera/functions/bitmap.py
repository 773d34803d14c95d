"""Posting sets as Spark bitmaps: one row per (term, bucket) of 32,768 ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_bitmaps(postings: DataFrame) -> DataFrame:
    """(term, doc_id) to (term, bucket, bits)."""
    return postings.groupBy("term", F.bitmap_bucket_number("doc_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits")
    )


def union_bitmaps(bitmaps: DataFrame, *keys: str) -> DataFrame:
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersect_bitmaps(bitmaps: DataFrame, operands: int) -> DataFrame:
    """Bits present for all of `operands` terms; a bucket that lacks a term has no common id."""
    both = bitmaps.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.countDistinct("term").alias("n"))
    return both.where(F.col("n") == operands).drop("n")


def to_ids(bitmaps: DataFrame) -> DataFrame:
    """Set bits as doc_id rows. Words of eight bytes without a bit are dropped before anything is exploded."""
    words = F.expr("filter(sequence(0, cast(length(bits) / 8 as int) - 1), w -> substring(bits, w * 8 + 1, 8) <> X'0000000000000000')")
    rows = bitmaps.select("*", F.explode(words).alias("word"))
    rows = rows.select("*", F.expr("substring(bits, word * 8 + 1, 8)").alias("eight")).drop("bits")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    rows = rows.select("*", F.expr("cast(conv(hex(substring(eight, i + 1, 1)), 16, 10) as int)").alias("byte")).where("byte <> 0")
    rows = rows.select("*", F.expr("word * 8 + i").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    rows = rows.where(F.expr("(shiftright(byte, bit) & 1) = 1"))
    ident = F.expr("(bucket - 1) * 32768 + at * 8 + bit + 1")
    rest = [c for c in bitmaps.columns if c not in ("bucket", "bits")]
    return rows.select(*rest, F.when(F.col("bucket") == 0, F.lit(0)).otherwise(ident).cast("long").alias("doc_id"))
