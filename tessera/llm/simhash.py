"""SimHash near-duplicates, found with BK-trees.

Two fingerprints of 64 bits within distance r agree on at least `blocks - r` of `blocks` bit blocks
(pigeonhole), so that every link lies inside a shard: the fingerprints that share the values of so
many blocks. Each shard gets a BK-tree, children keyed by their integer Hamming distance to the
parent, and a search follows only the edges within the radius. A shard beyond `shard_rows` is dealt
again by blocks that are laid over the bits otherwise, by the same pigeonhole; what is then still too
large, a dense cluster, is cut into parts, and each part's tree is sent to every other part of its shard,
which is what broadcasting shard trees comes to when their size is to stay bounded. Trees work on distinct fingerprints: copies
never meet as pairs. A task reports a spanning forest of the links it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, keep_rows, row_keys, written

RADIUS, SHARD_ROWS, SHINGLE, SEED = 4, 4096, 4, 42
TURN = 5  # bits by which the second blocks lie off the first: about half a block
EXPECTED = 64  # fingerprints that a shard is to hold at most if they were random
SPACE = b" \t\n\v\f\r"
PIECE = 1 << 20  # bytes of a text whose words are held at once
BYTE_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)])


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded piece at a time."""
    at = 0
    while len(text) - at > PIECE:
        end = min((i for i in (text.find(c, at + PIECE) for c in (b"%c" % s for s in SPACE)) if i >= 0), default=len(text))
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if set in over half of the shingles' XXH64 sums; 0 without words."""
    ones, n, carried = np.zeros(64, np.int64), 0, []
    for piece in pieces((text or b"").lower()):
        words = carried + piece
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
            hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
            ones += ones_of(hashes)
            n += len(hashes)
            carried = words[len(words) - shingle + 1 :]
        else:
            carried = words
    if not n and carried:
        ones, n = ones_of([xxhash.xxh64_intdigest(b" ".join(carried), SEED)]), 1
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def ones_of(hashes: list[int] | np.ndarray) -> np.ndarray:
    """How many of the numbers have each bit set."""
    columns = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(columns[:, i], minlength=256) @ BYTE_BITS for i in range(8)])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, keys: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, fp) of whole documents, then key0, key1, ... (longs); fp is the fingerprint as a signed long."""
    names = [f"key{i}" for i in range(len(keys))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            columns = [batch.column("doc_id"), pa.array(fps.view(np.int64)), *map(batch.column, names)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *names])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[k.alias(n) for k, n in zip(keys, names)])
    return slim.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *names)))


class BKTree:
    """Children of a node keyed by their Hamming distance to it."""

    def __init__(self, fps: Iterable[int]):
        self.fps: list[int] = []
        self.children: list[dict[int, int]] = []
        for fp in fps:
            self._insert(fp)

    def _insert(self, fp: int) -> None:
        new, at = len(self.fps), 0
        self.fps.append(fp)
        self.children.append({})
        while new:
            at_child = self.children[at].setdefault((self.fps[at] ^ fp).bit_count(), new)
            if at_child == new:
                return
            at = at_child

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within the radius), all queries descending together."""
        stack = [(0, np.arange(len(queries)))] if self.fps else []
        while stack:
            node, who = stack.pop()
            d = np.bitwise_count(queries[who] ^ np.uint64(self.fps[node])).astype(np.int16)
            hits = who[d <= radius]
            if len(hits):
                yield node, hits
            for edge, child in self.children[node].items():
                near = who[np.abs(d - edge) <= radius]
                if len(near):
                    stack.append((child, near))

    def search_one(self, fp: int, radius: int) -> Iterator[int]:
        stack = [0] if self.fps else []
        while stack:
            node = stack.pop()
            d = (self.fps[node] ^ fp).bit_count()
            if d <= radius:
                yield node
            stack += [c for e, c in self.children[node].items() if -radius <= d - e <= radius]


def _forest(tree_fps: list[int], query_fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Links between tree and queries as (fingerprint, its local root), a spanning forest."""
    tree = BKTree(tree_fps)
    fps = tree_fps + query_fps
    label = np.arange(len(fps))
    first = len(tree_fps) if query_fps else 0  # the tree's own fingerprints are the queries if there are no others

    def link(node: int, hits: np.ndarray) -> None:
        nonlocal label
        own = label[hits]
        if (own != label[node]).any():
            labels = np.unique(np.append(own, label[node]))
            label[np.isin(label, labels)] = labels[0]

    if len(fps) - first <= 48:
        for q in range(first, len(fps)):
            for node in tree.search_one(fps[q], radius):
                if label[node] != label[q]:
                    link(node, np.array([q]))
    else:
        for node, hits in tree.search(np.array(fps[first:], np.uint64), radius):
            link(node, hits + first)
    return [(fps[i], fps[r]) for i, r in enumerate(label.tolist()) if i != r]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Number of blocks for n fingerprints: more blocks mean more but finer shards. Links are the same with any."""
    blocks = radius + 2
    while n >> (64 // blocks) * (blocks - radius) > EXPECTED and blocks < 3 * radius:
        blocks += 1
    return blocks


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """The shards of a fingerprint: one for each choice of `blocks - radius` blocks."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << b - a) - 1).cast("long")) for a, b in zip(bounds, bounds[1:])]
    return F.array(*[F.struct(F.lit(i).alias("choice"), F.array(*(parts[j] for j in c)).alias("bits")) for i, c in enumerate(combinations(range(blocks), blocks - radius))])


def _links(rows: DataFrame, radius: int) -> DataFrame:
    """rows (shard struct, lo, hi, part, fp), dealt and sorted by shard part: a spanning forest (a, b) of its links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])
        out: list[tuple[int, int]] = []

        def close() -> None:
            tree, others = held
            if len(tree) + len(others) > 1 and tree:
                out.extend(_forest(tree, others, radius))

        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64).tolist()
            keys = zip(*(batch.column(c).to_pylist() for c in ("shard", "lo", "hi")))
            for k, fp, part in zip(keys, fps, batch.column("part").to_pylist()):
                if k != key:
                    close()
                    key, held = k, ([], [])
                # Of a pair of parts the first is the tree and the second asks; a part alone asks itself.
                held[k[1] != part].append(fp)
            if len(out) > 50_000:
                yield pack(out)
                out.clear()
        close()
        yield pack(out)

    def pack(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def linked(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(node, root) of distinct fingerprints (fp) that have a partner within the radius."""
    blocks = blocks or blocks_for(fps.count(), radius)
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("k"))
    # One number for a shard: a shard is at worst larger than it need be if two share it.
    keyed = keyed.select("fp", F.xxhash64("k.choice", "k.bits").alias("shard"))
    sizes = written(keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"))
    cool = keyed.join(sizes.where(F.col("n") <= shard_rows), "shard").select("fp", "shard", F.lit(1).alias("parts"))
    again = keyed.join(sizes.where(F.col("n") > shard_rows).select("shard"), "shard")
    turned = F.shiftleft("fp", TURN).bitwiseOR(F.shiftrightunsigned("fp", 64 - TURN))
    again = again.select("fp", "shard", F.explode(block_keys(turned, radius, blocks)).alias("k"))
    again = again.select("fp", F.xxhash64("shard", "k.choice", "k.bits").alias("shard"))
    sizes = again.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    cut = cool.unionAll(again.join(sizes, "shard").select("fp", "shard", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = cut.select("shard", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "fp")
    dealt = pairs.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi")
    return components(_links(dealt, radius))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and wordless texts have fingerprint zero and are linked like any other. A null doc_id counts as
    no id: it is never a component_id (which is null where no member has an id). Repeated rows stay
    repeated. Other columns are ignored; an empty table gives an empty result.
    """
    rows = written(with_fingerprints(docs, shingle))
    reps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = linked(reps.select("fp"), radius, blocks, shard_rows)
    members = groups.union(groups.select("root", "root").distinct()).toDF("fp", "root").join(reps, "fp")
    least = members.groupBy("root").agg(F.min("rep").alias("least"))
    # A component's members in fingerprints, then all fingerprints with their component.
    of = members.select("fp", "root").join(least, "root").select("fp", "least")
    # Written, so that the last join's sides are plain shuffles and a common fingerprint's rows can be split.
    ids = written(reps.join(of, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")))
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The documents without near-duplicates: one row of each component stays; the columns are those of `docs`.

    It is the one with the least doc_id (null last); between rows with one doc_id a sum of all columns
    decides, so that reruns agree. Rows equal in every column are one row.
    """
    rows = written(with_fingerprints(docs, shingle, row_keys(docs)))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key0", "key1")
    # The first row of each fingerprint, then of each component: minima are partly taken before a shuffle.
    firsts = written(rows.groupBy("fp").agg(F.min(place).alias("first")))
    groups = linked(firsts.select("fp"), radius, blocks, shard_rows).toDF("fp", "root")
    kept = firsts.join(groups, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return keep_rows(docs, kept.select("first.key0", "first.key1"))
