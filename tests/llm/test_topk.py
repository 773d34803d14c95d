import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk as K

VECTORS = "vec_id long, embedding array<float>, label int, chunk string, block string, v string, dim string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "", "", "", "", "") for i, v in rows], VECTORS)


def brute(rows, k=20):
    """Every row is a candidate of its own, also under a repeated vec_id."""
    clean = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) and abs(float(np.float32(x))) * 64 < 2**31 / math.sqrt(len(v)) for x in v):
            clean.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for n, (q, v) in enumerate(clean):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, c)), i) for m, (i, c) in enumerate(clean) if m != n and len(c) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, **how):
    got = K.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, **how).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


@pytest.mark.parametrize("dim,n,chunk,block", [(3, 700, 50, 7), (16, 400, 8192, 16384)])
def test_against_brute_force(spark, dim, n, chunk, block):
    rng = np.random.default_rng(dim)
    v = rng.normal(0, 0.4, (n, dim)).astype(np.float32)
    v[rng.random(n) < 0.4] = v[0]  # a very common vector: ties everywhere
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    assert run(spark, rows, chunk_rows=chunk, block_rows=block) == brute(rows)


def test_repeated_ids_and_equal_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 60)), rng.integers(-3, 4, 4).astype(float).tolist()) for _ in range(300)]
    rows += rows[:40] * 3
    assert run(spark, rows, chunk_rows=40, block_rows=5) == brute(rows)
    # The better of two rows of one id isn't lost.
    assert run(spark, [(0, [1.0]), (1, [0.5]), (1, [1.0])]) == [(0, 1, 1, 4096), (0, 2, 1, 2048)]


def test_odd_and_empty(spark):
    rows = [
        (0, [1.0, 0.5]), (20, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [0.5, 0.5]), (2, None), (3, []), (40, [float("nan"), 1.0]), (4, [None, 1.0]),
        (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (60, [1.0, 2.0, 3.0]), (7, [-1.0, 2.0, 0.25]), (-20, [0.0, 0.0]), (8, [-0.001, 0.001]),
        (9, [1e30, 1.0]), (80, [1e9, 1.0]), (10, [2e6, -3e6]), (100, [1e6, 2e6]),
    ]
    got = run(spark, rows)
    assert got == brute(rows) and not {9, 80} & {r[2] for r in got} and {10, 100} <= {r[2] for r in got}
    assert run(spark, []) == []


def exact(points, ids, k):
    scores = points[ids].astype(object) @ points.T.astype(object)
    return {q: sorted((-x, i) for i, x in enumerate(row) if i != q)[:k] for q, row in zip(ids, scores.tolist())}


def searched(points, ids, k, page=32):
    tree = K.MTree(np.arange(len(points)), np.arange(len(points)), points, max(int(x @ x) for x in points.astype(object)), page)
    search = pickle.loads(tree.packed()).searcher()
    found = {q: search(points[q], q, k) for q in ids}
    return {q: sorted((-int(s), int(i)) for i, s in zip(*f)) for q, f in found.items()}, search.computed


def test_tree_skips_work():
    rng = np.random.default_rng(2)
    centers = rng.integers(-2000, 2000, (60, 8))
    points = (centers[rng.integers(0, 60, 4000)] + rng.integers(-40, 41, (4000, 8))).astype(np.int64)
    got, computed = searched(points, range(100), 5)
    assert got == exact(points, range(100), 5)
    assert computed < 0.2 * 100 * len(points)


def test_a_score_to_beat_skips_more():
    rng = np.random.default_rng(6)
    points = rng.integers(-50, 51, (3000, 3)).astype(np.int64)
    tree = K.MTree(np.arange(3000), np.arange(3000), points, max(int(x @ x) for x in points))
    plain, told = tree.searcher(), tree.searcher()
    for q in range(30):
        ids, scores = plain(points[q], q, 10)
        again = told(points[q], q, 10, int(scores.min()))
        assert sorted(zip(*again)) == sorted(zip(ids, scores))
    assert told.computed <= plain.computed < 30 * 3000 / 2


def test_large_numbers_are_exact():
    points = np.array([[2**30, 3], [2**20, -(2**30)], [1, 1], [2**30, 2]], np.int64)
    got, _ = searched(points, range(4), 3)
    assert got == exact(points, range(4), 3) and got[0][0] == (-(2**60) - 6, 3)


def test_pages_keep_their_bounds():
    rng = np.random.default_rng(3)
    points = rng.integers(-100, 101, (900, 5))
    tree = K.MTree(np.arange(900), np.arange(900), points, max(int(x @ x) for x in points), page=16)
    space, seen = K.Space(tree.vectors, tree.top), []
    assert sorted(tree.ids) == list(range(900)) and (tree.vectors == points[tree.ids]).all()

    def walk(at):
        pivot, radius, to_parent, children, entries, to_pivot = tree.nodes[at]
        below = np.concatenate([walk(c) for c in children]) if children is not None else np.arange(*entries)
        d = space.distances(pivot, below)
        assert d.max() <= radius + 1e-9
        for c in children or []:
            assert abs(space.distances(pivot, np.array([tree.nodes[c][0]]))[0] - tree.nodes[c][2]) < 1e-9
        if children is None:
            assert np.allclose(d, to_pivot)
            seen.extend(below.tolist())
        return below

    walk(0)
    assert sorted(seen) == list(range(900))
