"""Near-copies by SimHash and BK-trees: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity the fingerprints of two shingle sets differ in about 10 of 64 bits, in more than
`RADIUS` in less than one case of 10,000; unrelated ones differ in 32. No choice of equal bit blocks holds
such links together, so shards come from the sets themselves: each goes to the shards of its `KEYS` smallest
shingle hashes. Those of the union of two sets lie in both with chance 0.8 each, so that one link in
1 / 0.2^8 = 400,000 is in no shard. Members of a shard beyond `shard_rows` are dealt again, by pairs of its
hash with each other one of their `SKETCH` smallest; what is still too large is cut into parts that meet each other.

A shard's fingerprints go into a BK-tree, children keyed by their Hamming distance to the parent, and a
search follows only edges within the radius. A second fingerprint thins out what it finds: over both,
related sets differ in 19 of 128 bits, unrelated ones in 64. So does a parity map: 1,024 bits, each the
parity of the shingles that hash to it. Two maps differ in no more bits than the sets have members that are
in one only, so that a pair with too many is no link for certain. The rest is compared by whole sets. A first
round reports what connects all that each shard's tree found: every member with its nearest one, which for
copies of one text is that text if it is there, and so much the same in all shards, then these with each other.

The second round is for shards that the links so far leave in several components. Its shards are finer:
sets of similarity t or more share a member among the first n - ceil(t n) + 1 of each, whatever order all
shingles are put in. This order takes last what is common in a bounded sample, and thus first what sets
the members of a family apart; it decides how large shards are, not which links are found. A shard
reports pairs of different components within the radius, as far as the places of the shared member
leave room for the similarity (members before it are in one of the two only).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, drop, keep_rows, marked, row_keys, written
from tessera.llm.simhash import SEED, SHARD_ROWS, BKTree, ones_of, pieces

SHINGLE, LEAST, RADIUS, RADIUS_OF_BOTH = 5, 0.8, 24, 40
KEYS, SKETCH, PARITIES = 8, 16, 1024
SAMPLE_ROWS, COMMON = 10_000, 100_000  # rows that the second round's order is taken from (in expectation), shingles that it knows
EPS = 1e-9
MIX = np.uint64(0x9E3779B97F4A7C15)  # makes other hashes of a shingle for the second fingerprint


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 sums of a UTF-8 text's shingles, sorted; all words are one shingle if they are fewer."""
    sums, carried = [np.zeros(0, np.uint64)], []
    for piece in pieces((text or b"").lower()):
        words = carried + piece
        carried = words
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
            sums.append(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64))
            carried = words[len(words) - size + 1 :]
    if len(sums) == 1 and carried:
        sums.append(np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64))
    return np.unique(np.concatenate(sums))


def set_fingerprint(s: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if set in over half of its members."""
    return sum(1 << b for b in np.flatnonzero(2 * ones_of(s) > len(s)).tolist()) if len(s) else 0


def _sets(docs: DataFrame, size: int, name: str) -> DataFrame:
    """(name, s): a column of docs and the shingles of its text, as signed longs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size).view(np.int64) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(sets, pa.list_(pa.int64()))], names=[name, "s"])

    return docs.select(name, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{name} long, s array<long>")


def second(s: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    h = (s ^ (s >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def parities(s: np.ndarray) -> bytes:
    """Of each of the map's bits whether an odd number of the set's members hash to it."""
    return np.packbits(np.bincount((second(s) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def _common(keyed: DataFrame, size: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several rows of a sample have, sorted, and in how many."""
    span = 1 << 30
    part = keyed.where(F.pmod("key0", F.lit(span)) < min(span, -(-span * sample_rows // max(1, keyed.count()))))
    counts = _sets(part, size, "key0").select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _sketches(keyed: DataFrame, size: int, least: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, key0, key1, id, n, fp, fp2, odd, sketch, prefix): id is a sum of the set, n its size, fp and fp2 its fingerprints, odd its parities, sketch its smallest hashes, prefix its first ones in the second round's order, as signed longs."""
    kinds = {"id": pa.int64(), "n": pa.int32(), "fp": pa.int64(), "fp2": pa.int64(), "odd": pa.binary(), "sketch": pa.list_(pa.int64()), "prefix": pa.list_(pa.int64())}
    known, often = common

    def prefix(s: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(s), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            rank = np.where(known[at] == s, often[at], 0)
        return s[np.lexsort((s, rank))[: len(s) - math.ceil(least * len(s) - EPS) + 1]].view(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(a, 1024), []
                for t in part.column("text").cast(pa.binary()):
                    s = shingles(t.as_py(), size)
                    fps = np.array([xxhash.xxh3_64_intdigest(s.tobytes()), set_fingerprint(s), set_fingerprint(second(s))], np.uint64).view(np.int64).tolist()
                    rows.append((fps[0], len(s), fps[1], fps[2], parities(s), s[:SKETCH].view(np.int64), prefix(s)))
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([*map(part.column, ("doc_id", "key0", "key1")), *made], names=["doc_id", "key0", "key1", *kinds])

    return keyed.mapInArrow(run, "doc_id long, key0 long, key1 long, id long, n int, fp long, fp2 long, odd binary, sketch array<long>, prefix array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of similarity `least` or more."""
    a, b = sets.toDF("a", "s"), sets.toDF("b", "t")
    common = F.size(F.array_intersect("s", "t"))
    return pairs.join(a, "a").join(b, "b").where(common * (1 + least) >= least * (F.size("s") + F.size("t")) - EPS).select("a", "b")


def _fits(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return np.minimum(a, b) >= least * np.maximum(a, b) - EPS


class Members:
    """Fingerprints, sizes and parities of some sets, searched together."""

    def __init__(self, fps: np.ndarray, seconds: np.ndarray, sizes: np.ndarray, odd: np.ndarray, radius: int, least: float):
        self.fps, self.seconds, self.sizes, self.odd, self.radius, self.least = fps, seconds, sizes, odd, radius, least

    def near(self, tree: int, first: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(position, positions that may be similar, their distances), the one of the first `tree` members, the others from `first` on."""
        for node, hits in BKTree(self.fps[:tree].tolist()).search(self.fps[first:], self.radius):
            hits = hits + first
            both = np.bitwise_count(self.fps[hits] ^ self.fps[node]).astype(np.int16) + np.bitwise_count(self.seconds[hits] ^ self.seconds[node])
            some = (both <= RADIUS_OF_BOTH) & _fits(self.sizes[hits], self.sizes[node], self.least)
            hits, both = hits[some], both[some]
            most = (1 - self.least) / (1 + self.least) * (self.sizes[hits] + self.sizes[node])
            some = np.bitwise_count(self.odd[hits] ^ self.odd[node]).sum(1) <= most + EPS
            yield node, hits[some], both[some]

    def forest(self) -> list[tuple[int, int]]:
        """Pairs that connect all that may be similar: each with its nearest, then what links these to each other.

        The text that a family comes from is nearer to all of its copies than they are to each other.
        """
        n = len(self.fps)
        nearest, apart = np.full(n, -1), np.full(n, 2 * RADIUS_OF_BOTH)
        for node, hits, far in self.near(n, 0):
            better = (far < apart[hits]) & (hits != node)
            nearest[hits[better]], apart[hits[better]] = node, far[better]
        out = [(int(q), int(nearest[q])) for q in np.flatnonzero(nearest >= 0)]
        label = np.arange(n)
        for a, b in out:
            if label[a] != label[b]:
                label[label == label[a]] = label[b]
        for node, hits, far in self.near(n, 0) if len(set(label[nearest >= 0].tolist())) > 1 else ():
            other = label[hits] != label[node]
            hits, far = hits[other], far[other]
            if len(hits):
                order = np.lexsort((far, label[hits]))
                labels, first = np.unique(label[hits][order], return_index=True)
                out += [(node, q) for q in hits[order][first].tolist()]
                label[np.isin(label, labels)] = label[node]
        return out

    def apart(self, roots: np.ndarray, places: np.ndarray, first: int) -> list[tuple[int, int]]:
        """All pairs that may be similar and have different roots: one before `first` and one from it on, or any if `first` is 0.

        places: of the shared member in the order of each set; all that both sets have comes from there on.
        """
        out, left = [], self.sizes - places
        for node, hits, _ in self.near(first or len(self.fps), first):
            needed = self.least / (1 + self.least) * (self.sizes[hits] + self.sizes[node])
            hits = hits[(roots[hits] != roots[node]) & (np.minimum(left[hits], left[node]) >= needed - EPS)]
            out += [(node, q) for q in hits.tolist() if first or q > node]
        return out


def _pairs(rows: DataFrame, radius: int, least: float) -> DataFrame:
    """rows (h, lo, hi, part, id, n, fp, fp2, odd, root, place), dealt and sorted by (h, lo, hi): candidate pairs (a, b).

    Without roots (null) a spanning forest of each (h, lo, hi); with roots all pairs between different ones, of a pair of parts those that it has between them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], set()

        def close() -> None:
            if len(held) < 2:
                return
            # Of two parts the first one is the tree; the order is the same in all shards.
            held.sort(key=lambda m: (m[0] != key[1], m[2], m[1]))
            ids, sizes = [m[1] for m in held], np.array([m[2] for m in held])
            odd = np.frombuffer(b"".join(m[7] for m in held), np.uint64).reshape(len(held), -1)
            some = Members(*(np.array([m[i] for m in held], np.int64).view(np.uint64) for i in (3, 4)), sizes, odd, radius, least)
            if held[0][5] is None:
                found = some.forest()
            elif (first := sum(m[0] == key[1] for m in held) % len(held)) or key[1] == key[2]:
                found = some.apart(np.array([m[5] for m in held]), np.array([m[6] for m in held]), first)
            else:
                found = []
            out.update((min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in found if ids[i] != ids[j])

        def pack() -> pa.RecordBatch:
            a = np.array(sorted(out), np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("h", "lo", "hi")))
            for k, *member in zip(keys, *(batch.column(c).to_pylist() for c in ("part", "id", "n", "fp", "fp2", "root", "place", "odd"))):
                if k != key:
                    close()
                    key, held = k, []
                held.append(member)
            if len(out) > 50_000:
                yield pack()
        close()
        yield pack()

    dealt = rows.select("h", "lo", "hi", "part", *MEMBER, "root", "place").repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long")


MEMBER = ("id", "n", "fp", "fp2", "odd")


def shards(firsts: DataFrame, shard_rows: int) -> DataFrame:
    """(h, id, n, fp, fp2, odd, parts, part) of firsts (id, n, fp, fp2, odd, sketch): the members of each shard of two or more."""
    # Fingerprints and maps join only what is left in the end: until then a member is its id.
    keys = firsts.select("id", F.explode(F.slice("sketch", 1, KEYS)).alias("h"))
    counts = written(keys.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    cool = keys.join(counts.where(F.col("c") <= shard_rows), "h").select("h", "id", F.lit(1).alias("parts"))
    hot = keys.join(counts.where(F.col("c") > shard_rows), "h").select("h", "id")
    again = hot.join(firsts.select("id", "sketch"), "id").withColumn("other", F.explode("sketch")).where("other <> h")
    again = written(again.select(F.xxhash64("h", "other").alias("h"), "id"))
    counts = written(again.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    again = again.join(counts, "h").select("h", "id", F.ceil(F.col("c") / shard_rows).cast("int").alias("parts"))
    members = cool.unionAll(again).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return written(members.join(firsts.select(*MEMBER), "id").select("h", *MEMBER, "parts", "part"))


def linked(firsts: DataFrame, keyed: DataFrame, size: int, least: float, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(node, root) of the sets in firsts (id, n, fp, fp2, odd, sketch, prefix, first) that have a partner."""
    shared = shards(firsts, shard_rows)
    # The first member of a shard in several parts is in each of them.
    heads = shared.where("parts > 1").groupBy("h").agg(F.min(F.struct("n", "id", "fp", "fp2", "odd", "parts")).alias("m"))
    heads = heads.select("h", "m.id", "m.n", "m.fp", "m.fp2", "m.odd", F.explode(F.sequence(F.lit(0), F.col("m.parts") - 1)).alias("part"))
    alone = lambda rows: rows.select("h", F.col("part").alias("lo"), F.col("part").alias("hi"), "part", *MEMBER, F.lit(None).cast("long").alias("root"), F.lit(0).alias("place"))
    tried = written(_pairs(alone(shared).unionAll(alone(heads)), radius, least).distinct())
    needed = written(tried.select("a").union(tried.select("b")).distinct().toDF("id"))

    def sets_of(needed: DataFrame) -> DataFrame:
        # Written: a map of its keys goes to the texts, so that no others are shuffled.
        rows = written(firsts.join(needed, "id").select("id", F.col("first.key0").alias("key0"), F.col("first.key1").alias("key1")))
        texts = marked(keyed.select("key0", "key1", "text"), "key0", rows.select("key0")).where("maybe").drop("maybe")
        return written(_sets(texts.join(rows, ["key0", "key1"]), size, "id").dropDuplicates(["id"]))

    sets = sets_of(needed)
    links = written(_verified(tried, sets, least))
    of = components(links).toDF("id", "root")

    named = shared.join(of, "id", "left").select("h", "id", F.coalesce("root", "id").alias("root"))
    named = written(named)
    mixed = named.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("h")
    open_ = written(named.join(mixed, "h").select("id", "root").distinct())
    entries = written(firsts.select("id", "prefix").join(open_, "id").select("id", "root", F.posexplode("prefix").alias("place", "h")))
    counts = entries.groupBy("h").agg(F.count("*").alias("c"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    left = entries.join(written(counts.select("h", F.ceil(F.col("c") / shard_rows).cast("int").alias("parts"))), "h").join(firsts.select(*MEMBER), "id")
    left = left.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.select("h", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", *MEMBER, "root", "place")
    more = written(_pairs(left, radius, least).distinct().join(tried, ["a", "b"], "left_anti"))
    drop(entries, shared, named)
    # A set that only the second round asks for wasn't read in the first.
    unread = more.select("a").union(more.select("b")).distinct().toDF("id").join(needed, "id", "left_anti")
    return components(links.union(_verified(more, sets.union(sets_of(written(unread))), least)))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents without near-copies: one row of each group stays; the columns are those of `docs`.

    A group is what links of Jaccard similarity `least` or more connect. Words are as in SimHash: split at
    ASCII white space, ASCII letters lower-cased. Texts without words are copies of each other. The row
    with the least doc_id stays (null last); between rows with one doc_id a sum of all columns decides.
    Null and empty texts are texts without words; rows equal in every column are one row; an empty table
    gives an empty result. Fingerprints further apart than `radius` don't link (see above).
    """
    key0, key1 = row_keys(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key0.alias("key0"), key1.alias("key1"))
    rows = _sketches(keyed, shingle, least, _common(keyed, shingle, sample_rows))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key0", "key1")
    firsts = written(rows.groupBy("id").agg(F.min(place).alias("first"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("fp2").alias("fp2"), F.any_value("odd").alias("odd"), F.any_value("sketch").alias("sketch"), F.any_value("prefix").alias("prefix")))
    groups = linked(firsts, keyed, shingle, least, radius, shard_rows).toDF("id", "root")
    kept = firsts.select("id", "first").join(groups, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    return keep_rows(docs, kept.select("first.key0", "first.key1"))
