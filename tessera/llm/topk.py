"""Exact top-k by inner product with M-trees searched best-first.

Inner products become distances by one more component: a candidate x gets sqrt(M^2 - |x|^2), M the
largest norm, a query gets 0; then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and the nearest are the highest
scored. One computed distance is one inner product; scores themselves are exact integers.

The tree is paged over the cluster. Its root: pivots from a bounded sample, every row under its nearest
one, with each pivot's covering radius. Below a pivot, rows lie in chunks of bounded size, each an M-tree
that is built once and kept in a table: pages of entries with their distance to the page's pivot, inner
entries with a covering radius and their distance to the parent's pivot. A pivot with many rows, equal
ones too, has several chunks.

A query first searches a chunk of its nearest pivot, which gives it a score to beat; then it goes only to
the chunks of pivots whose covering radius leaves something to find. In a tree it takes pages in the order
of their least possible distance; stored distances rule out pages and entries by the triangle
inequality before anything is computed. The queries are a stated set; a task holds one chunk's tree and a
block of the queries that go to it.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

K, STEP, SCALE = 20, 20, 64
CHUNK_ROWS, BLOCK_ROWS, MOST_PIVOTS, PAGE = 8192, 4096, 1024, 512
BITS = 62  # of a score at most


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x). Every row stays a row of its own, also with a repeated vec_id.

    Out are rows with a null vec_id, a null or empty vector, a null or non-finite component, and those with
    a component so large that a score might need more than 62 bits: beyond 2^31 / sqrt(length) after scaling.
    """
    x = F.col("embedding").cast("array<double>")
    most = 2.0 ** (BITS // 2) / F.sqrt(F.size(x))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < most))
    ints = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))


class Space:
    """Distances of rows to rows, and of queries to rows, for vectors of whole numbers with squared norms up to `top`."""

    def __init__(self, vectors: np.ndarray, top: int):
        largest = max(1, int(np.abs(vectors).max(initial=0)))
        # Products of floats are quicker, and exact as long as no sum outgrows their digits.
        most = largest**2 * max(1, vectors.shape[1])
        self.v = vectors.astype(np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64)
        self.last = np.sqrt(np.maximum(float(top) - (vectors.astype(np.float64) ** 2).sum(1), 0))
        self.top = float(top)

    def distances(self, pivot: int, ids: np.ndarray) -> np.ndarray:
        d = self.v[ids].astype(np.float64) - self.v[pivot]
        return np.sqrt((d * d).sum(1) + (self.last[ids] - self.last[pivot]) ** 2)


class MTree:
    """Bulk-loaded: a page's entries are dealt to sampled pivots until pages are small enough."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, top: int, page: int = PAGE):
        self.ids, self.rows, self.vectors, self.top, self.page = ids, rows, vectors, top, page
        # A node: pivot, covering radius, distance to the parent's pivot; then children, or None, entries, their distances.
        self.nodes: list[tuple] = []
        space = Space(vectors, top)
        self._build(space, np.arange(len(ids)), 0, 0.0)
        # Rows are put in the pages' order: a page's entries become a range.
        order = np.concatenate([n[4] for n in self.nodes if n[3] is None])
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        nodes, at = self.nodes, 0
        for i, (pivot, radius, to_parent, children, entries, to_pivot) in enumerate(nodes):
            if children is None:
                entries, at = (at, at + len(entries)), at + len(entries)
            nodes[i] = (int(place[pivot]), radius, to_parent, children, entries, to_pivot)
        self.inner = [None if n[3] is None else tuple(np.array([self.nodes[c][i] for c in n[3]]) for i in range(3)) for n in self.nodes]

    def _build(self, space: Space, ids: np.ndarray, pivot: int, to_parent: float) -> int:
        d, page = space.distances(pivot, ids), self.page
        at = len(self.nodes)
        self.nodes.append(())
        if len(ids) <= page or d.max() == 0:  # equal points stay in one page
            self.nodes[at] = (pivot, float(d.max(initial=0)), to_parent, None, ids, d)
            return at
        pivots = ids[np.linspace(0, len(ids) - 1, min(32, 2 * -(-len(ids) // page))).astype(int)]
        pivots = pivots[np.unique(space.v[pivots], axis=0, return_index=True)[1]]
        if len(pivots) == 1:  # the sample was all equal
            pivots = np.array([pivots[0], ids[space.distances(pivots[0], ids).argmax()]])
        near = np.stack([space.distances(p, ids) for p in pivots]).argmin(0)
        children = [self._build(space, ids[near == i], p, float(space.distances(pivot, np.array([p]))[0])) for i, p in enumerate(pivots) if (near == i).any()]
        self.nodes[at] = (pivot, float(d.max()), to_parent, children, None, None)
        return at

    def packed(self) -> bytes:
        small = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.abs(self.vectors).max(initial=0) <= np.iinfo(t).max)
        self.vectors = self.vectors.astype(small)
        return pickle.dumps(self)

    def searcher(self) -> Searcher:
        return Searcher(self)


class Searcher:
    """Best-first search in a tree, a query at a time; `computed` counts inner products."""

    def __init__(self, tree: MTree):
        self.tree, self.space, self.computed = tree, Space(tree.vectors.astype(np.int64), tree.top), 0
        self.largest = int(np.abs(tree.vectors.astype(np.int64)).max(initial=0))

    def _scores(self, at: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        scores = self.space.v[at] @ query
        self.computed += len(scores)
        return scores

    def __call__(self, query: np.ndarray, row: int, k: int = K, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(vec_id, score) of the k best by (score, smaller vec_id) that reach `floor`, the row itself left out."""
        tree, space = self.tree, self.space
        most = int(np.abs(query).max(initial=0)) * self.largest * len(query)
        if most >= {4: 2**23, 8: 2**52}[space.v.itemsize] and space.v.dtype != np.int64:
            space.v = tree.vectors.astype(np.float64 if most < 2**52 else np.int64)
        q = query.astype(space.v.dtype)
        offset = (float((query.astype(np.float64) ** 2).sum()) + space.top) / 2  # score = offset - distance^2 / 2
        slack = 1e-9 * (abs(offset) + 1) + 1e-6  # rounding of distances
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def reach() -> float:
            """Distance within which something can still enter."""
            return np.inf if floor is None else float(np.sqrt(max(0.0, 2 * (offset - float(floor) + slack))))

        within, order = reach(), count()
        queue: list[tuple] = [(0.0, next(order), 0, float(self._to(self._scores(np.array([tree.nodes[0][0]]), q), offset)[0]))]
        while queue:
            bound, _, at, d = heapq.heappop(queue)
            if bound > within:
                break
            _, _, _, children, entries, to_pivot = tree.nodes[at]
            if children is not None:
                pivots, radii, to_parent = tree.inner[at]
                some = np.flatnonzero(np.abs(d - to_parent) - radii <= within)
                if len(some):
                    to = self._to(self._scores(pivots[some], q), offset)
                    least = np.maximum(to - radii[some], 0)
                    for i in np.flatnonzero(least <= within).tolist():
                        heapq.heappush(queue, (float(least[i]), next(order), children[some[i]], float(to[i])))
                continue
            # Entries ruled out by their stored distance need no product.
            fits = np.abs(d - to_pivot) <= within
            kept = int(np.count_nonzero(fits))
            if not kept:
                continue
            if kept == len(fits):
                scores, some = self._scores(slice(*entries), q), None
            else:
                some = np.flatnonzero(fits) + entries[0]
                scores = self._scores(some, q)
            if floor is not None:
                high = np.flatnonzero(scores >= floor)
                scores, some = scores[high], high + entries[0] if some is None else some[high]
            elif some is None:
                some = np.arange(*entries)
            other = tree.rows[some] != row
            some, scores = some[other], scores[other].astype(np.int64)  # exact whole numbers, whatever the type
            if len(some):
                best, best_id = np.append(best, scores), np.append(best_id, tree.ids[some])
                if len(best) > k:
                    top = np.lexsort((best_id, -best))[:k]
                    best, best_id = best[top], best_id[top]
                if len(best) == k:
                    floor, within = int(best.min()), 0.0
                    within = reach()
        return best_id, best

    @staticmethod
    def _to(scores: np.ndarray, offset: float) -> np.ndarray:
        return np.sqrt(np.maximum(2 * (offset - scores.astype(np.float64)), 0))


def _matrix(blobs: Iterable[bytes]) -> np.ndarray:
    blobs = list(blobs)
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), -1)


def _pivots(rows: DataFrame, total: int, chunk_rows: int) -> dict[int, np.ndarray]:
    """Length of vectors to pivots: a sample of at most MOST_PIVOTS rows, picked by hash."""
    n = max(1, min(MOST_PIVOTS, -(-total // chunk_rows)))
    found: dict[int, list[bytes]] = {}
    for r in rows.select("dim", "v").orderBy(F.xxhash64("row")).limit(n).collect():
        found.setdefault(r.dim, []).append(bytes(r.v))
    return {dim: _matrix(dict.fromkeys(blobs)) for dim, blobs in found.items()}


def _to_pivots(vectors: np.ndarray, pivots: np.ndarray, top: float, asking: bool) -> np.ndarray:
    """(rows, pivots) distances; queries have a last component of 0."""
    a, b = vectors.astype(np.float64), pivots.astype(np.float64)
    last = lambda x: np.sqrt(np.maximum(top - (x**2).sum(1), 0))
    apart = last(b)[None, :] - (0 if asking else last(a)[:, None])
    out = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T) + apart**2
    return np.sqrt(np.maximum(out, 0))


def _by_pivot(rows: DataFrame, pivots: dict[int, np.ndarray], top: float) -> DataFrame:
    """rows with `pivot`, the nearest one's position, and `apart`, the distance to it; 0 and an endless distance for lengths without pivots."""
    names = ["row", "vec_id", "dim", "asks", "v"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, blobs = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
            pivot, apart = np.zeros(len(dims), np.int32), np.full(len(dims), np.inf)
            for dim in np.unique(dims).tolist():
                if dim in pivots:
                    at = np.flatnonzero(dims == dim)
                    d = _to_pivots(_matrix([blobs[i] for i in at]), pivots[dim], top, False)
                    pivot[at], apart[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(pivot), pa.array(apart)], names=[*names, "pivot", "apart"])

    return rows.select(*names).mapInArrow(run, "row long, vec_id long, dim int, asks boolean, v binary, pivot int, apart double")


def _routes(queries: DataFrame, pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float], top: float) -> DataFrame:
    """Queries (row, vec_id, dim, v, floor) to the pivots that may hold a score of at least `floor` (null: any); `nearest` marks one."""
    names = ["row", "vec_id", "dim", "v", "floor"]
    of_dim = {dim: np.array(sorted(p for d, p in radius if d == dim)) for dim, _ in radius}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, where, best = [], [], []
            for i, (dim, blob, floor) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "v", "floor")))):
                some = have = of_dim[dim]
                nearest = have[0]
                if dim in pivots:
                    q = _matrix([blob])
                    d = _to_pivots(q, pivots[dim], top, True)[0][have]
                    nearest = have[d.argmin()]
                    if floor is not None:
                        offset = (float((q.astype(np.float64) ** 2).sum()) + top) / 2
                        within = np.sqrt(max(0.0, 2 * (offset - floor + 1e-9 * (abs(offset) + 1) + 1e-6)))
                        some = have[d - np.array([radius[dim, p] for p in have.tolist()]) <= within * (1 + 1e-9) + 1e-6 * np.sqrt(top)]
                who += [i] * len(some)
                where += some.tolist()
                best += (some == nearest).tolist()
            taken = [batch.column(c).take(pa.array(who, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(where, pa.int32()), pa.array(best, pa.bool_())], names=[*names, "pivot", "nearest"])

    return queries.select(*names).mapInArrow(run, "row long, vec_id long, dim int, v binary, floor long, pivot int, nearest boolean")


FOUND = "row long, query_id long, vec_id long, score long"


def _searched(routed: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """Results of queries (row, vec_id, v, floor, dim, pivot, sub, block) in their chunks' trees; a tree is copied once a block that asks it."""
    key = ["dim", "pivot", "sub", "block"]
    asked = routed.select(*key).distinct().toDF("dim", "pivot", "sub", "in_block").join(trees.select("dim", "pivot", "sub", "tree"), ["dim", "pivot", "sub"])
    asked = asked.toDF("in_dim", "in_pivot", "in_sub", "in_block", "tree")

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            search = pickle.loads(left["tree"].iloc[0]).searcher()
            for row, ident, blob, floor in zip(right["row"], right["vec_id"], right["v"], right["floor"]):
                ids, scores = search(np.frombuffer(blob, "<i8"), row, k, None if pd.isna(floor) else int(floor))
                out.append(pd.DataFrame({"row": row, "query_id": ident, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "query_id", "vec_id", "score")})

    asking = routed.select("row", "vec_id", "v", F.col("floor").cast("string").alias("floor"), *key)
    return asked.groupBy("in_dim", "in_pivot", "in_sub", "in_block").cogroup(asking.groupBy(*key)).applyInPandas(work, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS, page: int = PAGE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all other rows.

    is_query: a condition on vec_id. Every row is a candidate but the query's own, also rows of the same
    vec_id; of several query rows with one vec_id each gives its k rows. Vectors of different lengths don't
    meet. Nulls, empty, odd and very large vectors: see whole_numbers. Fewer than k other rows: all of them.
    An empty table gives an empty result; other columns are ignored.
    """
    pack = F.udf(lambda v: np.array(v, "<i8").tobytes(), "binary", useArrow=True)
    rows = whole_numbers(vectors, scale)
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"), norm.alias("norm"), pack("v").alias("v"))
    # Written: a row keeps its number.
    rows = written(rows)
    total, asking, top = rows.agg(F.count("*"), F.count_if("asks"), F.max("norm")).first()
    top = float(top or 0)
    pivots = _pivots(rows, total, chunk_rows)
    dealt = written(_by_pivot(rows, pivots, top))
    # As many rows as there are pivots and lengths of vectors.
    sizes = {(r.dim, r.pivot): (r.n, r.apart) for r in dealt.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("apart").alias("apart")).collect()}
    spark = vectors.sparkSession
    chunks = spark.createDataFrame([(d, p, -(-n // chunk_rows)) for (d, p), (n, _) in sizes.items()], "dim int, pivot int, chunks int")
    radius = {at: apart for at, (_, apart) in sizes.items()}
    blocks = max(1, -(-asking // block_rows))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(part["vec_id"].to_numpy(), part["row"].to_numpy(), _matrix(part["v"]), int(top), page)
        first = part.iloc[0]
        return pd.DataFrame({"dim": [first["dim"]], "pivot": [first["pivot"]], "sub": [first["sub"]], "tree": [tree.packed()]})

    sub = F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int").alias("sub")
    trees = dealt.join(F.broadcast(chunks), ["dim", "pivot"]).select("row", "vec_id", "dim", "v", "pivot", sub)
    trees = written(trees.groupBy("dim", "pivot", "sub").applyInPandas(build, "dim int, pivot int, sub int, tree binary"))

    block = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int").alias("block")
    queries = dealt.where("asks").select("row", "vec_id", "dim", "v")
    nearest = _routes(queries.withColumn("floor", F.lit(None).cast("long")), pivots, radius, top).where("nearest")
    before = written(_searched(nearest.select("*", F.lit(0).alias("sub"), block), trees, k))
    floors = before.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = floors.select("row", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    routed = _routes(queries.join(floors, "row", "left"), pivots, radius, top).join(F.broadcast(chunks), ["dim", "pivot"])
    # What has been searched already isn't searched again.
    routed = routed.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("NOT nearest OR sub > 0").select("*", block)
    found = before.unionAll(_searched(routed, trees, k))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
