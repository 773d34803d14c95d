"""What the training-data operators share: tables in the shared folder, components of a graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session, whose executors are threads of the driver, may go without the setting.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, a lost executor costs a reread.

    The files go when the driver's JVM ends, or with `drop`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4()}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = hadoop
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables from `written` that no later step reads."""
    for t in tables:
        t.written_to.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(t.written_to, True)


def row_keys(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit sums of all columns: a key of 128 bits. Maps, which have no hash, count as their text.

    The hash passes over nulls, so the second sum also takes which columns are null.
    """
    cols = [F.col(f"`{c}`").cast("string") if "map<" in kind else F.to_json(f"`{c}`") if kind == "variant" else F.col(f"`{c}`") for c, kind in df.dtypes]
    return F.xxhash64(*cols), F.xxhash64(*map(F.isnull, cols), *cols)


MAP_BITS = 1 << 26  # of a map of numbers, at most: 8 MB, however many they are
BUCKET_BITS = 1 << 15  # of one binary of bitmap_construct_agg


def marked(rows: DataFrame, key: str, numbers: DataFrame) -> DataFrame:
    """rows and a boolean `maybe`: false only where the long `key`, a hash, isn't among `numbers` (one column, from a written table).

    A map of bits is broadcast, 64 a number up to MAP_BITS: with more numbers more rows are marked that needn't be.
    """
    bits = min(MAP_BITS, max(BUCKET_BITS, 1 << (64 * numbers.count() - 1).bit_length()))
    at = F.pmod(F.col(numbers.columns[0]), F.lit(bits))
    # Dealt first, so that a bucket's map is made once.
    dealt = numbers.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND(F.lit(BUCKET_BITS - 1)).alias("bit")).repartition("bucket")
    maps = F.broadcast(dealt.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")))
    at = F.pmod(F.col(key), F.lit(bits))
    bit = at.bitwiseAND(F.lit(BUCKET_BITS - 1))
    byte = F.conv(F.hex(F.substring("map", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return rows.join(maps, F.shiftright(at, 15) == F.col("bucket"), "left").select(*rows.columns, maybe.alias("maybe"))


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of docs for each of the keys (two columns, see row_keys); columns are those of docs, whatever their names.

    Rows whose key is neither left out nor that of several equal rows stay where they are: a map of such keys
    tells them, and only what it marks is shuffled and looked up.
    """
    on = ["key0", "key1"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = [k.alias(n) for k, n in zip(row_keys(docs), on)]
    keys = written(keys.toDF(*on))
    found = docs.select(*named).groupBy(*on).agg(F.count("*").alias("n")).join(keys.withColumn("kept", F.lit(True)), on, "left")
    keyed = marked(docs.select(*named, row), "key0", written(found.where("n > 1 or kept is null").select("key0")))
    single = keyed.where(~F.col("maybe")).select("row.*")
    return single.unionAll(keyed.where("maybe").drop("maybe").dropDuplicates(on).join(keys, on, "left_semi").select("row.*"))


EDGES_A_FILE = 1 << 18
COPIES_AT_ONCE = 4096  # equal rows that a task makes at once


def numbered(rows: DataFrame, copies: str, *by: str) -> DataFrame:
    """Each row as often as its column `copies` says, numbered from 0 in `i`; large numbers go to many tasks, dealt with `by`."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(COPIES_AT_ONCE).cast("long")))
    rows = rows.where(F.col(copies) > 0).withColumn("chunk", chunk).repartition(*by, "chunk")
    return rows.withColumn("i", F.explode(F.sequence("chunk", F.least(F.col("chunk") + COPIES_AT_ONCE, F.col(copies)) - 1)))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph with undirected edges (a, b): the root is the least node reachable.

    Alternates large stars and small stars until nothing changes, a logarithmic number of rounds in
    practice. Only minima are gathered at a node, never its neighbours, and each round ends in a table
    of the shared folder. Nodes without an edge are not returned. Loops are ignored.
    """
    state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(state)
    # Few edges make few files.
    files = max(1, -(-before[0] // EDGES_A_FILE))
    while before[0]:
        both = state.union(state.select("b", "a")).toDF("u", "v")
        # Minima are written: the join's sides are then plain shuffles, and a hub's rows can be split.
        first = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).coalesce(files))
        large = both.join(first, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.coalesce(files))
        drop(state, first)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(files))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = written(small.union(least).distinct().coalesce(files))
        drop(large, least)
        now = _signature(state)
        if now == before:
            break
        before = now
    return state.toDF("node", "root")
