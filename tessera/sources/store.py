"""Stores on a shared file system: sorted Parquet runs under a numbered manifest.

A store is a directory with `runs/<number>-<uuid>` (Parquet, sorted by key, Bloom filter on the key) and
`manifest/<number>.json`. The highest readable manifest is the current state. Opening changes nothing; a
writer takes its epoch with its first commit. A commit creates the next manifest exclusively, so that one
of two racing writers fails; its run lies in a folder of its own, which it removes. A manifest that a writer
died over is unreadable: readers pass over it and its number is not used again.

Runs that a merge replaced stay as long as one of the last `KEPT` manifests names them, for readers that
are under way. Everything goes through Hadoop's file systems; the one in use must create a file without
overwriting as one step, as HDFS and object stores with conditional writes do.
"""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import versioned
from tessera.schema import KV, KV_LATEST, POSTINGS, UNION, StoreOptions


KEPT = 10  # manifests, and the runs they name
TIER = 4  # a merge takes in an older run of up to so many times its rows


class CommitConflict(RuntimeError):
    """Another writer committed first."""


class Files:
    """The few file operations a manifest needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; fails if the name is taken."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self.fs.create(self._path(f"{self.root}/{name}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                raise CommitConflict(name) from e
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{name}"), True)


class Store:
    """A versioned table (mode kv_latest) or a posting table (mode union)."""

    def __init__(self, spark: SparkSession, path: str, options: StoreOptions | None = None):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.state = {"number": 0, "epoch": 0, "next_run": 1, "runs": [], "rows": {}}
        numbers = self._manifests()
        for n in reversed(numbers):
            try:
                self.state = json.loads(self.files.read(f"manifest/{n:012d}.json"))
                break
            except ValueError:  # its writer died over it
                continue
        self.next_number = max(numbers, default=0) + 1
        if "options" in self.state:
            names = {f.name for f in fields(StoreOptions)}
            stored = StoreOptions(**{k: v for k, v in self.state["options"].items() if k in names})
            if options and (options.mode, options.lang) != (stored.mode, stored.lang):
                raise ValueError(f"the store has mode {stored.mode} and language {stored.lang}")
            self.options = options or stored
        else:
            self.options = options or StoreOptions()
        # Sequence numbers may restart with each opening: versions compare by epoch first.
        self.epoch, self.pending = self.state["epoch"] + 1, None

    def _manifests(self) -> list[int]:
        return sorted(int(n[:12]) for n in self.files.names("manifest") if n.endswith(".json"))

    # Reading

    def runs(self) -> DataFrame:
        """All rows of all live runs and of the pending batch, which is newer than any run."""
        rows = self._read(self.state["runs"])
        return rows if self.pending is None else rows.unionByName(self.pending)

    def _read(self, runs: list[str]) -> DataFrame:
        schema = KV if self.options.mode == KV_LATEST else POSTINGS
        paths = [f"{self.path}/runs/{r}" for r in runs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def file_names(self) -> list[str]:
        """The data files of the live runs, oldest run first."""
        return [f"{self.path}/runs/{r}/{n}" for r in self.state["runs"] for n in sorted(self.files.names(f"runs/{r}")) if n.endswith(".parquet")]

    def pending_dump(self) -> DataFrame:
        """The batch that isn't flushed yet, in key order."""
        rows = self.pending if self.pending is not None else self._read([])
        return rows.orderBy(*(["key"] if self.options.mode == KV_LATEST else ["term", "doc_id"]))

    def get(self, key: str) -> DataFrame:
        return versioned.get(self.runs(), key)

    def range(self, start: str, end: str) -> DataFrame:
        return versioned.range_scan(self.runs(), start, end)

    def latest(self) -> DataFrame:
        return versioned.latest(self.runs())

    def all_values(self, key: str) -> DataFrame:
        return versioned.all_values(self.runs(), key)

    # Writing

    def write(self, rows: DataFrame) -> None:
        """Take a batch (key, value, seq[, tombstone]), or postings (term, doc_id); flush at the threshold.

        Empty keys raise as the batch is written.
        """
        if self.options.mode == KV_LATEST:
            key = F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit("empty key")).cast("string"))
            rows = versioned.put(rows.withColumn("key", key), self.epoch, self.state["next_run"])
        else:
            rows = rows.select("term", "doc_id")
        old = self.pending
        rows = rows if old is None else old.unionByName(rows)
        if self.options.mode == KV_LATEST:
            rows = versioned.newest(rows).withColumn("run_id", F.lit(self.state["next_run"]).cast("long")).select(*KV.names)
        else:
            rows = rows.distinct()
        # Kept, so that neither counting nor the next batch makes it again; a lost part is made from its source.
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        keys = rows.select(self._key).distinct().limit(max(1, self.options.flush_keys)).count()
        self.pending = rows
        if old is not None:
            old.unpersist()
        if keys >= self.options.flush_keys:
            self.flush()

    def delete(self, keys: DataFrame) -> None:
        """Write tombstones of (key, seq); posting tables have no delete."""
        if self.options.mode == UNION:
            raise ValueError("postings can't be deleted")
        self.write(keys.select("key", F.lit(None).cast("binary").alias("value"), "seq", F.lit(True).alias("tombstone")))

    def flush(self) -> None:
        """Write the pending batch as a run, and merge if there are too many."""
        if self.pending is None:
            return
        self._replace([], self.pending, self.epoch)
        self.pending.unpersist()
        self.pending = None
        if len(self.state["runs"]) > self.options.max_runs:
            self._merge(self._tier())

    def compact(self) -> None:
        """Merge all runs into one."""
        self._merge(list(self.state["runs"]))

    def _tier(self) -> list[str]:
        """The newest runs to merge: at least two, and older ones while they aren't much larger than those merged so far."""
        runs, rows = self.state["runs"], self.state["rows"]
        taken, total = [runs[-1]], rows.get(runs[-1], 0)
        for r in reversed(runs[:-1]):
            if len(taken) > 1 and rows.get(r, 0) > TIER * max(1, total):
                break
            taken.insert(0, r)
            total += rows.get(r, 0)
        return taken

    def _merge(self, old: list[str]) -> None:
        """One run out of the newest runs; tombstones go only if no older run is left for them to hide."""
        if not old:
            return
        if self.options.mode == KV_LATEST:
            merged = versioned.newest(self._read(old))
            if len(old) == len(self.state["runs"]):
                merged = merged.where(~F.col("tombstone"))
            merged = merged.withColumn("run_id", F.lit(self.state["next_run"]).cast("long")).select(*KV.names)
        else:
            merged = versioned.merge_union(self._read(old))
        self._replace(old, merged, self.state["epoch"])

    def close(self) -> None:
        self.flush()

    @property
    def _key(self) -> str:
        return "key" if self.options.mode == KV_LATEST else "term"

    def _replace(self, old: list[str], rows: DataFrame, epoch: int) -> None:
        """Write rows as the newest run in place of the old ones, and commit that."""
        number, key = self.state["next_run"], self._key
        run = f"{number:012d}-{self.files.jvm.java.util.UUID.randomUUID()}"
        # Range partitions keep each file to a narrow key range; row groups carry min, max and Bloom filter.
        writer = rows.repartitionByRange(key).sortWithinPartitions(key).write
        if self.options.row_group_rows:
            writer = writer.option("parquet.block.row.count.limit", self.options.row_group_rows)
        (
            writer.option("parquet.block.size", self.options.row_group_bytes)
            .option(f"parquet.bloom.filter.enabled#{key}", "true")
            .option(f"parquet.bloom.filter.fpp#{key}", str(self.options.bloom_fp))
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(f"{self.path}/runs/{run}")
        )
        runs = [*(r for r in self.state["runs"] if r not in old), run]
        counts = {r: n for r, n in self.state["rows"].items() if r in runs} | {run: self._read([run]).count()}
        try:
            self._commit(runs=runs, rows=counts, next_run=number + 1, epoch=epoch)
        except CommitConflict:
            self.files.delete(f"runs/{run}")
            raise

    def _commit(self, **changes) -> None:
        state = self.state | changes | {"number": self.next_number, "options": asdict(self.options)}
        self.files.create(f"manifest/{state['number']:012d}.json", json.dumps(state))
        self.state, self.next_number = state, state["number"] + 1
        numbers = self._manifests()
        if len(numbers) > KEPT:
            runs = [self._runs_of(n) for n in numbers]
            kept = {r for of in runs[-KEPT:] for r in of}
            for n, of in zip(numbers[:-KEPT], runs):
                for r in of - kept:
                    self.files.delete(f"runs/{r}")
                self.files.delete(f"manifest/{n:012d}.json")

    def _runs_of(self, number: int) -> set[str]:
        try:
            return set(json.loads(self.files.read(f"manifest/{number:012d}.json"))["runs"])
        except ValueError:
            return set()


__all__ = ["CommitConflict", "Store"]
