"""Reads over versioned key-value rows (key, value, tombstone, seq, epoch, run_id).

A version is ordered by (epoch, seq): seq restarts with each opening of a store, epoch doesn't.
Key predicates stay below the aggregate, so they reach the Parquet scan; the tombstone filter
stays above it, or deleted keys would come back.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "struct(epoch, seq)"


def put(rows: DataFrame, epoch: int = 0, run_id: int = 0) -> DataFrame:
    """Version rows of writes; rows have key, value, seq and may have tombstone."""
    tombstone = F.coalesce(F.col("tombstone"), F.lit(False)) if "tombstone" in rows.columns else F.lit(False)
    value = F.when(~tombstone & (F.length("value") > 0), F.col("value"))
    return rows.select("key", value.alias("value"), tombstone.alias("tombstone"), F.col("seq").cast("long").alias("seq"), F.lit(epoch).cast("long").alias("epoch"), F.lit(run_id).cast("long").alias("run_id"))


def delete(keys: DataFrame, epoch: int = 0, run_id: int = 0) -> DataFrame:
    """Tombstones of keys, known or not; keys have key and seq."""
    return put(keys.select("key", "seq", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("tombstone")), epoch, run_id)


def newest(versions: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones included; aggregates partially before its shuffle."""
    top = F.max_by(F.struct("value", "tombstone", "seq", "epoch"), F.expr(VERSION)).alias("top")
    return versions.groupBy("key").agg(top).select("key", "top.*")


def latest(versions: DataFrame) -> DataFrame:
    """Live keys with their newest value."""
    return newest(versions).where(~F.col("tombstone")).select("key", "value")


def get(versions: DataFrame, key: str) -> DataFrame:
    return latest(versions.where(F.col("key") == key))


def multi_get(versions: DataFrame, keys: Iterable[str] | DataFrame) -> DataFrame:
    """Several keys at once: a short list becomes a pushed-down filter, a frame a semi-join."""
    if isinstance(keys, DataFrame):
        return latest(versions.join(keys.select("key").distinct(), "key", "left_semi"))
    return latest(versions.where(F.col("key").isin(list(keys))))


def range_scan(versions: DataFrame, start: str, end: str) -> DataFrame:
    """Live keys between two bounds, both included, in byte order."""
    return latest(versions.where(F.col("key").between(start, end))).orderBy("key")


def seek(versions: DataFrame, start: str) -> DataFrame:
    """Newest versions of the keys from a bound on, in byte order."""
    return newest(versions.where(F.col("key") >= start)).orderBy("key")


def all_values(versions: DataFrame, key: str | None = None) -> DataFrame:
    """Each run's newest non-empty live value of a key, newest run first; runs don't mask each other."""
    rows = versions if key is None else versions.where(F.col("key") == key)
    per_run = rows.groupBy("key", "run_id").agg(F.max_by(F.struct("value", "tombstone"), F.expr(VERSION)).alias("top"))
    live = per_run.where(~F.col("top.tombstone") & (F.length("top.value") > 0))
    chunks = F.sort_array(F.collect_list(F.struct("run_id", "top.value")), asc=False)
    return live.groupBy("key").agg(F.transform(chunks, lambda x: x["value"]).alias("chunks"))


def history(versions: DataFrame) -> DataFrame:
    """All versions in merge order: key, then newest first, the later run before the earlier."""
    return versions.orderBy(F.asc("key"), F.desc("epoch"), F.desc("seq"), F.desc("run_id"))


def merge_latest(*runs: DataFrame) -> DataFrame:
    """One run out of several: newest version of each key, tombstones gone."""
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.unionByName(r)
    return newest(rows).where(~F.col("tombstone"))


def merge_union(*runs: DataFrame) -> DataFrame:
    """One run of postings out of several."""
    rows = runs[0].select("term", "doc_id")
    for r in runs[1:]:
        rows = rows.unionByName(r.select("term", "doc_id"))
    return rows.distinct()
