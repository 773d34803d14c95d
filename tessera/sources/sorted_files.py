"""Single-file sorted tables: reading existing ones into Spark, and writing them.

For moving data in and out; stores themselves are Parquet. A file is a sequence of blocks of entries
sorted by key, an index of the blocks' first keys, a Bloom filter and a footer of four numbers. All
numbers are little-endian and lengths are 32 bits:

    block  = count, then per entry: key length, key, tombstone byte, seq (64 bits), value length, value
    index  = count, then per block: key length, first key, offset (64 bits)
    Bloom  = bits, probes (64 bits each), the bit array
    footer = offset and size of the index, offset and size of the Bloom filter (64 bits each)
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import takewhile
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.bloom import Bloom

FOOTER = struct.Struct("<4q")
BLOCK_ENTRIES = 128


class CorruptFile(ValueError):
    pass


class Entry(NamedTuple):
    key: str
    value: bytes | None
    tombstone: bool
    seq: int


class _Reader:
    """Reads numbers and byte strings one after another; running out is corruption of the named part."""

    def __init__(self, data: bytes, part: str):
        self.data, self.part, self.at = data, part, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise CorruptFile(f"corrupted {self.part}")
        self.at += n
        return out

    def number(self, kind: str) -> int:
        s = struct.Struct("<" + kind)
        return s.unpack(self.take(s.size))[0]

    def key(self) -> str:
        n = self.number("I")
        if not n:
            raise CorruptFile(f"corrupted {self.part}")
        return self.take(n).decode()


def pack_block(entries: Iterable[Entry]) -> bytes:
    parts = []
    for e in entries:
        key, value = e.key.encode(), e.value or b""
        if not key:
            raise ValueError("empty key")
        parts.append(struct.pack("<I", len(key)) + key + struct.pack("<?QI", e.tombstone, e.seq, len(value)) + value)
    return struct.pack("<I", len(parts)) + b"".join(parts)


def unpack_block(data: bytes) -> Iterator[Entry]:
    """Entries of a block; a value without bytes is null."""
    r = _Reader(data, "block")
    for _ in range(r.number("I")):
        key, tombstone, seq = r.key(), r.number("B") == 1, r.number("Q")
        yield Entry(key, r.take(r.number("I")) or None, tombstone, seq)


def pack_file(entries: list[Entry], block_entries: int = BLOCK_ENTRIES, fp: float = 0.01) -> bytes:
    """A whole file of entries in key order; without entries it has no block and an empty index."""
    body, index, bloom = b"", [], Bloom(len(entries), fp)
    for i in range(0, len(entries), max(1, block_entries)):
        block = entries[i : i + max(1, block_entries)]
        first = block[0].key.encode()
        index.append(struct.pack("<I", len(first)) + first + struct.pack("<q", len(body)))
        body += pack_block(block)
        for e in block:
            bloom.add(e.key)
    packed, bits = struct.pack("<I", len(index)) + b"".join(index), bloom.to_bytes()
    at = len(body)
    return body + packed + bits + FOOTER.pack(at, len(packed), at + len(packed), len(bits))


class SortedFile:
    """A file's content with point and range access."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER.size:
            raise CorruptFile("corrupted footer")
        self.data = data
        index_at, index_size, bloom_at, bloom_size = FOOTER.unpack(data[-FOOTER.size :])
        if min(index_at, bloom_at) < 0 or min(index_size, bloom_size) <= 0 or max(index_at + index_size, bloom_at + bloom_size) > len(data):
            raise CorruptFile("corrupted footer")
        r = _Reader(data[index_at : index_at + index_size], "index")
        self.first, starts = [], []
        for _ in range(r.number("I")):
            self.first.append(r.key().encode())
            starts.append(r.number("q"))
        self.bounds = [*starts, index_at]
        try:
            self.bloom = Bloom.from_bytes(data[bloom_at : bloom_at + bloom_size])
        except ValueError as e:
            raise CorruptFile("corrupted Bloom filter") from e

    def entries(self, start: str = "") -> Iterator[Entry]:
        """Entries from a key on, in key order; blocks before it aren't decoded."""
        low = start.encode()
        skip = max(0, bisect_right(self.first, low) - 1)
        for a, b in list(zip(self.bounds, self.bounds[1:]))[skip:]:
            if not 0 <= a < b:
                raise CorruptFile("corrupted block")
            yield from (e for e in unpack_block(self.data[a:b]) if e.key.encode() >= low)

    def get(self, key: str) -> Entry | None:
        """The key's entry, a tombstone too."""
        if not self.bloom.might_contain(key):
            return None
        # The block that may hold the key is the last one that doesn't begin after it.
        at = bisect_right(self.first, key.encode()) - 1
        if not key or at < 0:
            return None
        a, b = self.bounds[at : at + 2]
        if not 0 <= a < b:
            raise CorruptFile("corrupted block")
        entries = list(unpack_block(self.data[a:b]))
        i = bisect_left(entries, key.encode(), key=lambda e: e.key.encode())
        return entries[i] if i < len(entries) and entries[i].key == key else None


COLUMNS = "key string, value binary, tombstone boolean, seq long, epoch long, run_id long"


def read(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """All versions in the files `*.sst` of a folder, as rows for `tessera.operators.versioned`.

    The files' order by name is their age and becomes the epoch, so that a later file's version is newer
    whatever its seq. A range of keys skips blocks. A file is a task's work and must fit its memory.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path)
    names = sorted(r.path for r in files.select("path").collect())
    ages = spark.createDataFrame([(p, i) for i, p in enumerate(names)], "path string, age long")

    return unpack_files(files.join(F.broadcast(ages), "path").select("content", "age"), start, end)


def unpack_files(files: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The versions in files (content, age), those of a range of keys if asked; blocks outside aren't decoded."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, age in zip(batch.column("content"), batch.column("age").to_pylist()):
                found = list(takewhile(lambda e: end is None or e.key.encode() <= end.encode(), SortedFile(content.as_py()).entries(start or "")))
                columns = [pa.array([e[i] for e in found], k) for i, k in enumerate((pa.string(), pa.binary(), pa.bool_(), pa.int64()))]
                age = pa.array([age] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, age, age], names=["key", "value", "tombstone", "seq", "epoch", "run_id"])

    return files.select("content", "age").mapInArrow(run, COLUMNS)


def lookup(files: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, tombstone, seq, epoch, run_id) of the keys in files (content, age): Bloom filter, block search, then the block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, age in zip(batch.column("content"), batch.column("age").to_pylist()):
                f = SortedFile(content.as_py())
                found = [e for k in keys if (e := f.get(k)) is not None]
                columns = [pa.array([e[i] for e in found], k) for i, k in enumerate((pa.string(), pa.binary(), pa.bool_(), pa.int64()))]
                age = pa.array([age] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, age, age], names=["key", "value", "tombstone", "seq", "epoch", "run_id"])

    return files.select("content", "age").mapInArrow(run, COLUMNS)


def pack_files(rows: DataFrame, files: int, block_entries: int = BLOCK_ENTRIES, fp: float = 0.01) -> DataFrame:
    """(file, content): `files` key ranges of rows (key, value, tombstone, seq), one version a key, packed.

    Callers save `content` where they need it; a range must fit a task's memory.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[Entry] = []
        file = 0
        for batch in batches:
            entries += map(Entry, *(batch.column(c).to_pylist() for c in ("key", "value", "tombstone", "seq")))
            file = batch.column("file")[0].as_py() if batch.num_rows else file
        if entries:
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([pack_file(entries, block_entries, fp)], pa.binary())], names=["file", "content"])

    dealt = rows.select("key", "value", "tombstone", "seq").repartitionByRange(files, "key").sortWithinPartitions("key")
    return dealt.withColumn("file", F.spark_partition_id()).mapInArrow(run, "file int, content binary")


# The portable format of compressed integer sets.
NO_RUNS, RUNS, NO_OFFSETS_BELOW, ARRAY_MOST = 12346, 12347, 4, 4096


def set_members(data: bytes) -> list[int]:
    """Members of a serialised compressed set of 32-bit numbers (array, bitmap and run containers)."""
    r = _Reader(data, "bitmap")
    cookie = r.number("I")
    if cookie & 0xFFFF == RUNS:
        n = (cookie >> 16) + 1
        flags = r.take((n + 7) // 8)
        is_run = [flags[i >> 3] >> (i & 7) & 1 for i in range(n)]
    elif cookie == NO_RUNS:
        n = r.number("I")
        is_run = [0] * n
    else:
        raise CorruptFile("corrupted bitmap")
    heads = [(r.number("H"), r.number("H") + 1) for _ in range(n)]
    if cookie == NO_RUNS or n >= NO_OFFSETS_BELOW:
        r.take(4 * n)
    out: list[int] = []
    for run, (high, size) in zip(is_run, heads):
        if run:
            pairs = np.frombuffer(r.take(4 * r.number("H")), "<u2").reshape(-1, 2).tolist()
            low = [x for a, more in pairs for x in range(a, a + more + 1)]
        elif size <= ARRAY_MOST:
            low = np.frombuffer(r.take(2 * size), "<u2").tolist()
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(r.take(8192), np.uint8), bitorder="little")).tolist()
        out += [high << 16 | x for x in low]
    return out


def pack_set(members: Iterable[int]) -> bytes:
    """The serialised set, as array and bitmap containers."""
    by_high: dict[int, list[int]] = {}
    for x in sorted(set(members)):
        by_high.setdefault(x >> 16, []).append(x & 0xFFFF)
    heads, offsets, bodies = b"", [], b""
    start = 8 + 8 * len(by_high)
    for high, low in by_high.items():
        heads += struct.pack("<HH", high, len(low) - 1)
        offsets.append(start + len(bodies))
        if len(low) <= ARRAY_MOST:
            bodies += np.array(low, "<u2").tobytes()
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[low] = 1
            bodies += np.packbits(bits, bitorder="little").tobytes()
    return struct.pack("<II", NO_RUNS, len(by_high)) + heads + np.array(offsets, "<u4").tobytes() + bodies


def merge_sets(a: bytes, b: bytes) -> bytes:
    """The union of two serialised sets; either one malformed is an error."""
    return pack_set([*set_members(a), *set_members(b)])


def pack_sets(postings: DataFrame) -> DataFrame:
    """(term, high, value) of (term, doc_id): a term's ids that share their upper 16 bits as a serialised set, 65,536 at most."""

    @F.pandas_udf("binary")
    def pack(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: pack_set(int(i) for i in x))

    high = F.shiftright("doc_id", 16).alias("high")
    return postings.groupBy("term", high).agg(F.collect_set("doc_id").alias("ids")).select("term", "high", pack("ids").alias("value"))


def merge_packed(a: DataFrame, b: DataFrame) -> DataFrame:
    """The two tables of `pack_sets` as one: sets of both are united; a malformed one fails the job."""

    @F.pandas_udf("binary")
    def either(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([merge_sets(p, q) if p is not None and q is not None else p if q is None else q for p, q in zip(x, y)])

    both = a.withColumnRenamed("value", "one").join(b.withColumnRenamed("value", "other"), ["term", "high"], "full")
    return both.select("term", "high", either("one", "other").alias("value"))


def unpack_sets(sets: DataFrame) -> DataFrame:
    """(term, doc_id) of (term, value)."""

    @F.pandas_udf("array<long>")
    def members(values: pd.Series) -> pd.Series:
        return values.map(lambda v: set_members(bytes(v)))

    return sets.select("term", F.explode(members("value")).alias("doc_id"))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id) of an index kept in such files: the union of a term's sets over all files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for term, value in zip(batch.column("key").to_pylist(), batch.column("value")):
                ids = set_members(value.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([term] * len(ids), pa.string()), pa.array(ids, pa.int64())], names=["term", "doc_id"])

    rows = read(spark, path).where("NOT tombstone AND value IS NOT NULL").select("key", "value")
    return rows.mapInArrow(run, "term string, doc_id long").distinct()
