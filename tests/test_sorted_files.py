"""Single-file sorted tables: round trips, corruption, and reading into Spark."""

import random
import struct

import pytest

from tessera.operators import versioned as kv
from tessera.sources import sorted_files as S


def entries(keys, seq=1, value=b"v"):
    return [S.Entry(k, value + k.encode(), False, seq) for k in sorted(keys)]


@pytest.mark.parametrize("block", [1, 2, 128])
def test_round_trip(block):
    rows = [S.Entry("a", b"1", False, 1), S.Entry("b", None, True, 2**40), S.Entry("c", None, False, 3), S.Entry("й", "й".encode(), False, 4)]
    f = S.SortedFile(S.pack_file(rows, block))
    assert list(f.entries()) == rows and list(f.entries("b")) == rows[1:] and list(f.entries("bb")) == rows[2:] and list(f.entries("яя")) == []
    assert [f.get(k) for k in ("a", "b", "c", "й", "x", "")] == [*rows, None, None]


def test_layout():
    data = S.pack_file([S.Entry("k", b"xy", False, 7)])
    assert data[:4] == struct.pack("<I", 1) and data[4:9] == struct.pack("<I", 1) + b"k"
    assert data[9:10] == b"\0" and data[10:18] == struct.pack("<Q", 7) and data[18:24] == struct.pack("<I", 2) + b"xy"
    assert struct.unpack("<4q", data[-32:])[0] == 24


def test_corruption():
    data = S.pack_file(entries("abc"))
    for bad, what in ((b"", "footer"), (data[:31], "footer"), (data[:-32] + struct.pack("<4q", 1, 0, 1, 1), "footer"), (data[10:], "corrupted")):
        with pytest.raises(S.CorruptFile, match=what):
            list(S.SortedFile(bad).entries())
    with pytest.raises(S.CorruptFile, match="block"):
        list(S.unpack_block(struct.pack("<II", 2, 0)))
    with pytest.raises(ValueError, match="empty key"):
        S.pack_block([S.Entry("", b"", False, 1)])
    assert list(S.SortedFile(S.pack_file([])).entries()) == []


def test_read_and_write(spark, tmp_path):
    keys = [f"k{i:03d}" for i in range(300)]
    (tmp_path / "l0-000001.sst").write_bytes(S.pack_file(entries(keys, seq=900), 16))
    # A later file wins though its seq restarted; it also deletes a key.
    (tmp_path / "l0-000002.sst").write_bytes(S.pack_file([S.Entry("k010", b"new", False, 1), S.Entry("k011", None, True, 2)]))
    rows = S.read(spark, str(tmp_path))
    got = {r.key: bytes(r.value) for r in kv.latest(rows).collect()}
    assert len(got) == 299 and got["k010"] == b"new" and "k011" not in got
    assert [r.key for r in kv.range_scan(S.read(spark, str(tmp_path), "k009", "k012"), "k009", "k012").collect()] == ["k009", "k010", "k012"]
    packed = S.pack_files(kv.merge_latest(rows), 3).collect()
    again = [e for r in sorted(packed) for e in S.SortedFile(bytes(r.content)).entries()]
    assert {e.key: e.value for e in again} == got and [e.key for e in again] == sorted(got)


def test_sets_and_postings(spark, tmp_path):
    rng = random.Random(1)
    sets = [[], [0], [2**32 - 1, 0, 65536], rng.sample(range(2**20), 30_000), list(range(5000))]
    assert all(S.set_members(S.pack_set(s)) == sorted(s) for s in sets)
    runs = struct.pack("<IB", S.RUNS, 1) + struct.pack("<HH", 1, 5) + struct.pack("<5H", 2, 3, 2, 10, 2)
    assert S.set_members(runs) == [65536 + x for x in (3, 4, 5, 10, 11, 12)]
    with pytest.raises(S.CorruptFile):
        S.set_members(b"abcd")
    assert S.set_members(S.merge_sets(S.pack_set([1, 70000]), S.pack_set([2, 1]))) == [1, 2, 70000]
    for pair in ((b"abcd", S.pack_set([1])), (S.pack_set([1]), b"")):
        with pytest.raises(S.CorruptFile):
            S.merge_sets(*pair)
    for i, ids in enumerate(([1, 2], [3, 2])):
        (tmp_path / f"l0-{i:06d}.sst").write_bytes(S.pack_file([S.Entry("apple", S.pack_set(ids), False, 1)]))
    assert sorted(map(tuple, S.read_postings(spark, str(tmp_path)).collect())) == [("apple", 1), ("apple", 2), ("apple", 3)]
