"""A Bloom filter value: double hashing over two FNV sums, serialisable to bytes.

Run files carry Parquet's own Bloom filters; this sketch is for callers that want a portable one.
Build it by shards of keys, or on the driver for bounded key lists.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Offset and prime of the 64-bit FNV sums.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SALT = b"salt"


def dimensions(n: int, fp: float) -> tuple[int, int]:
    """Number of bits and of probes for n keys at a false-positive rate."""
    n = max(n, 1)
    fp = fp if 0 < fp < 1 else 0.01
    m = max(1, math.ceil(-n * math.log(fp) / math.log(2) ** 2))
    return m, max(1, math.ceil(m / n * math.log(2)))


def _fnv(keys: list[bytes], add_first: bool) -> np.ndarray:
    """FNV sums of many keys at once, byte by byte; add_first tells the two variants apart."""
    lengths = np.array([len(k) for k in keys])
    order = np.argsort(-lengths, kind="stable")  # the longest first: those that still have a byte are a prefix
    flat = np.frombuffer(b"".join(keys), np.uint8)
    starts = (np.cumsum(lengths) - lengths)[order]
    h = np.full(len(keys), FNV_OFFSET, np.uint64)
    active = len(keys) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max(initial=0))), side="right")
    for i, n in enumerate(active.tolist()):
        byte = flat[starts[:n] + i].astype(np.uint64)
        h[:n] = (h[:n] ^ byte) * np.uint64(FNV_PRIME) if add_first else h[:n] * np.uint64(FNV_PRIME) ^ byte
    out = np.empty_like(h)
    out[order] = h
    return out


class Bloom:
    def __init__(self, n: int, fp: float = 0.01):
        self.m, self.k = dimensions(n, fp)
        self.bits = bytearray((self.m + 7) // 8)

    def _probes(self, keys: list[str]) -> np.ndarray:
        """(keys, probes) bit positions."""
        data = [k.encode() for k in keys]
        a, b = _fnv(data, True), _fnv([SALT + k for k in data], False)
        b[b == 0] = 1
        return (a[:, None] + np.arange(self.k, dtype=np.uint64) * b[:, None]) % np.uint64(self.m)

    def add_all(self, keys: list[str]) -> None:
        at = self._probes(keys).ravel()
        np.bitwise_or.at(np.frombuffer(self.bits, np.uint8), at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))

    def might_contain_all(self, keys: list[str]) -> np.ndarray:
        at = self._probes(keys)
        return (np.frombuffer(self.bits, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(1)

    def add(self, key: str) -> None:
        self.add_all([key])

    def might_contain(self, key: str) -> bool:
        return bool(self.might_contain_all([key])[0])

    def to_bytes(self) -> bytes:
        return struct.pack("<QQ", self.m, self.k) + bytes(self.bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> Bloom:
        if len(data) < 16:
            raise ValueError("a Bloom filter has a header of 16 bytes")
        out = cls.__new__(cls)
        out.m, out.k = struct.unpack_from("<QQ", data)
        out.bits = bytearray(data[16:])
        if not out.m or len(out.bits) < (out.m + 7) // 8:
            raise ValueError("truncated Bloom filter")
        return out


def build(keys: DataFrame, fp: float, shards: int, per_shard: int) -> DataFrame:
    """(shard, bloom) of (shard, key): one filter a shard, sized for `per_shard` keys; null keys are in none.

    A task takes its shard's keys batch by batch; only the filter is held.
    """

    def run(batches):
        filters: dict[int, Bloom] = {}
        for batch in batches:
            for shard, own in batch.dropna().groupby("shard")["key"]:
                filters.setdefault(int(shard), Bloom(per_shard, fp)).add_all(own.tolist())
        if filters:
            yield pd.DataFrame({"shard": list(filters), "bloom": [f.to_bytes() for f in filters.values()]})

    return keys.repartition(shards, "shard").mapInPandas(run, "shard int, bloom binary")


def probe(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """(key, found) of (shard, key): whether the shard's filter might hold the key; a filter goes to its shard once, not to each row."""

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(asked), bool)
        some = asked["key"].notna().to_numpy()
        if len(own) and some.any():
            found[some] = Bloom.from_bytes(bytes(own["bloom"].iloc[0])).might_contain_all(asked["key"][some].tolist())
        return pd.DataFrame({"key": asked["key"], "found": found})

    asked = keys.select(F.col("shard").alias("in_shard"), "key")
    return filters.groupBy("shard").cogroup(asked.groupBy("in_shard")).applyInPandas(run, "key string, found boolean")
