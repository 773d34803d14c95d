import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash as S
from tessera.llm.common import components, row_keys
from tests.llm.helpers import corpus, no_docs, odd_docs


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    sums = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in sums) > len(sums))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(monkeypatch):
    _, docs = corpus(1, 30, low=0, high=40)
    texts = [" ".join(d) for d in docs] + ["É\u00a0b C\tD e\x1ff g", "one", "", None]
    assert [S.fingerprint(t.encode() if t is not None else None) for t in texts] == list(map(plain, texts))
    monkeypatch.setattr(S, "PIECE", 11)
    assert [S.fingerprint(t.encode() if t is not None else None) for t in texts] == list(map(plain, texts))


@pytest.mark.parametrize("n", [3, 40, 300])
def test_bk_tree(n):
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(max(1, n // 10))]
    fps = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for b in base for _ in range(10)})
    tree = S.BKTree(fps)
    hits = {(fps[node], q) for node, who in tree.search(np.array(fps, np.uint64), 4) for q in who.tolist()}
    assert hits == {(a, j) for a in fps for j, b in enumerate(fps) if (a ^ b).bit_count() <= 4}
    assert all({tree.fps[i] for i in tree.search_one(q, 4)} == {a for a in fps if (a ^ q).bit_count() <= 4} for q in fps[:20])


def test_blocks_follow_the_count():
    assert [S.blocks_for(n) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [6, 6, 7, 8, 9]


@pytest.mark.parametrize("shard_rows,blocks", [(3, None), (4096, None), (4096, 8)])
def test_components_against_brute_force(spark, shard_rows, blocks):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):  # chains of near fingerprints
            fps.add(fp)
            for _ in range(rng.randint(1, 6)):
                fp ^= 1 << rng.randrange(64)
    fps = sorted(f - 2**64 if f >> 63 else f for f in fps)
    want = groups([(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4], fps)
    got = S.linked(spark.createDataFrame([(f,) for f in fps], "fp long"), shard_rows=shard_rows, blocks=blocks).collect()
    found = {f: f for f in fps} | {r.node: r.root for r in got}
    assert found == want


def test_star_components(spark):
    pairs = [(i, i + 1) for i in range(100, 130)] + [(7, 7), (1, 50), (50, 3), (3, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {n: r for n, r in groups(pairs, {x for p in pairs for x in p}).items() if n != r}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_and_empty(spark):
    docs = odd_docs(spark)
    got = S.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    of = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
    assert of[1][1] == of[8][1] == 1 and of[2] == of[3] == of[4] == ("0" * 16, 2)
    assert of[None][1] is None
    assert all(of[r.doc_id][0] == f"{plain(r.text):016x}" for r in docs.collect())
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 6, 7, 9, 10] and kept.where("doc_id IS NULL").count() == 1
    assert S.near_duplicates(no_docs(spark)).count() == 0 and S.keep_one(no_docs(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    words = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(60))
    rows = [(1, words, "en", None), (1, other, "en", None), (2, words, "en", None), (None, other, "fr", "s"), (None, "y z", None, "t"), (None, "y z", "t", None), (3, "q", "en", "s"), (3, "q", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = [tuple(r) for r in S.keep_one(docs.repartition(4)).collect()]
    assert sorted(r[:2] for r in kept if r[0] is not None) == sorted([(1, words), (1, other), (3, "q")])
    assert [r[1] for r in kept if r[0] is None] == ["y z"]
    assert {tuple(r) for r in S.keep_one(docs.coalesce(1)).collect()} == set(kept)


def test_row_keys_tell_rows_apart(spark):
    rows = [("a", None, {"x": 1}), (None, "a", {"x": 1}), ("a", None, {"x": 2}), ("a", None, None), (None, None, None), ("a", None, {"x": 1})]
    docs = spark.createDataFrame(rows, "a string, b string, m map<string,int>")
    assert docs.select(*[k.alias(n) for k, n in zip(row_keys(docs), "kl")]).distinct().count() == 5


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    fps = {r.doc_id: plain(r.text) for r in rows}
    ids = sorted(fps)
    want = groups([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], ids)
    assert {r.doc_id: r.component_id for r in S.near_duplicates(docs.repartition(5, F.rand(1))).collect()} == want
