"""Line dedup: later copies of repeated runs of lines are deleted.

The corpus is a sequence of line IDs, a document after the other by doc_id. Its suffixes are sorted as
far as deletion needs it, and the common prefixes of neighbours show the repeated runs:

1. Lines that occur once end every repeated run; what is left are stretches of repeated lines. Only
   stretches of at least `min_words` words matter. Lines are numbered in the order of their hashes.
2. Prefix doubling ranks suffixes by their first 1, 2, 4, ... lines: order-preserving ranks of pairs of
   ranks. Two of them name a suffix's shortest beginning of `min_words` words; suffixes that share it
   form an interval of the suffix array. Doubling ends at the longest of these, `min_words` lines at most.
3. Within an interval suffixes are sorted to their whole depth: a line, then the shortest run of
   `min_words` words after it, or the end of the stretch. What a longer repeat has beyond that depth
   is found again from its next line on, so that no more is needed, however long a passage is.
4. One pass over an interval in order takes the common prefix of each two neighbours and walks the tree of
   longest-common-prefix intervals from its leaves: a suffix leaves the walk at the first interval
   in which another one comes earlier in the corpus; that interval's prefix is the longest run that the
   suffix has in common with an earlier one. Equal suffixes are one leaf, made before the shuffle, and
   the walk holds as many nodes as a suffix has lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, written

MIN_WORDS = 50
DOC = "doc_id long, doc_key long"
WORDS = r"[^\x20\x09-\x0D]+"
CELLS = 200_000  # numbers in a batch of rows that Python makes, about


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size, whatever the length of their lists."""
    held: list[tuple] = []
    cells = 0

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

    for row in rows:
        held.append(row)
        cells += sum(len(x) if hasattr(x, "__len__") else 1 for x in row)
        if cells > CELLS:
            yield pack()
            held.clear()
            cells = 0
    yield pack()


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema({"doc_id": pa.int64(), "doc_key": pa.int64()} | kinds)


INT, LONG = pa.int32(), pa.int64()
INTS, LONGS = pa.list_(INT), pa.list_(LONG)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, i, number, n, a, b): lines with a word, counted by i; number counts all lines, n words; a and b are hashes."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    line = lambda x, i: F.struct(i.alias("number"), F.regexp_count(x, F.lit(WORDS)).alias("n"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))
    lines = F.filter(F.transform(F.split("text", "\n"), line), lambda x: x["n"] > 0)
    rows = slim.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), F.posexplode(lines).alias("i", "x"))
    return rows.select("doc_id", "doc_key", "i", "x.number", "x.n", "x.a", "x.b")


def _ranked(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that occur at more than one place, with an order-preserving rank.

    Range partitions in order, rows in order within: the row's running number is the rank. It is written,
    as a recomputed row might get another. Equal documents are one place.
    """
    place = F.xxhash64("doc_key", "i")
    repeated = pairs.groupBy("a", "b").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("a", "b")
    ordered = repeated.repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    return written(ordered.withColumn("rank", F.monotonically_increasing_id()))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """One row a document: i, number, n and rank of its lines in long enough stretches of repeated lines, and of each line the `width` of the shortest long enough run from it (0: none)."""
    schema = _schema(i=INTS, number=INTS, n=INTS, rank=LONGS, width=INTS)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, key, x in zip(batch.column("doc_id").to_pylist(), batch.column("doc_key").to_pylist(), batch.column("x")):
            i, number, n, rank = (x.values.field(f).to_numpy() for f in ("i", "number", "n", "rank"))
            cut = np.concatenate(([0], np.flatnonzero(np.diff(i) != 1) + 1, [len(i)]))
            upto = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
            end = np.repeat(cut[1:], np.diff(cut))  # of each line's stretch
            long = np.repeat(upto[cut[1:]] - upto[cut[:-1]] >= min_words, np.diff(cut))
            if long.any():
                width = np.searchsorted(upto, upto[:-1] + min_words) - np.arange(len(i))
                width[np.arange(len(i)) + width > end] = 0
                yield (doc_id, key, i[long], number[long], n[long], rank[long], width[long].astype(np.int32))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((r for batch in batches for r in rows(batch)), schema)

    # A set: equal documents have the same lines at the same places.
    gathered = lines.groupBy("doc_id", "doc_key").agg(F.sort_array(F.collect_set(F.struct("i", "number", "n", "rank"))).alias("x"))
    return written(gathered.mapInArrow(run, f"{DOC}, i array<int>, number array<int>, n array<int>, rank array<long>, width array<int>"))


def _pairs(state: DataFrame, step: int) -> DataFrame:
    """(doc, i, width, a, b): the rank at a line and that `step` lines on, where both have one."""
    schema = _schema(i=INT, width=INT, a=LONG, b=LONG)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, i, rank, width in zip(batch.column("doc_id").to_pylist(), batch.column("doc_key").to_pylist(), *map(batch.column, ("i", "rank", "width"))):
                i, rank, width = (x.values.to_numpy() for x in (i, rank, width))
                other = np.searchsorted(i, i + step)
                here = np.flatnonzero(i[np.minimum(other, len(i) - 1)] == i + step)
                same = [pa.array(np.full(len(here), x or 0), mask=np.full(len(here), x is None)) for x in (doc_id, key)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(i[here]), pa.array(width[here]), pa.array(rank[here]), pa.array(rank[other[here]])], schema=schema)

    return state.select("doc_id", "doc_key", "i", "rank", "width").mapInArrow(run, f"{DOC}, i int, width int, a long, b long")


def _gathered(rows: DataFrame) -> DataFrame:
    """(doc, i, rank, width) of the lines that still have a rank: a document's own lines only."""
    rows = rows.groupBy("doc_id", "doc_key").agg(F.sort_array(F.collect_list(F.struct("i", "rank", "width"))).alias("x"))
    return written(rows.select("doc_id", "doc_key", "x.i", "x.rank", "x.width"))


def _beginnings(state: DataFrame, level: int) -> DataFrame:
    """(doc, i, width, ra, rb): shortest long enough runs of 2^level lines or more, but fewer than twice as many, by the ranks of their two halves, which may overlap."""
    least = 1 << level
    schema = _schema(i=INT, width=INT, ra=LONG, rb=LONG)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, i, rank, width in zip(batch.column("doc_id").to_pylist(), batch.column("doc_key").to_pylist(), *map(batch.column, ("i", "rank", "width"))):
                i, rank, width = (x.values.to_numpy() for x in (i, rank, width))
                some = np.flatnonzero((width >= least) & (width < 2 * least))
                at = i[some] + width[some] - least
                other = np.minimum(np.searchsorted(i, at), len(i) - 1)
                here = i[other] == at
                some, other = some[here], other[here]
                if len(some):
                    same = [pa.array(np.full(len(some), x or 0), mask=np.full(len(some), x is None)) for x in (doc_id, key)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(i[some]), pa.array(width[some]), pa.array(rank[some]), pa.array(rank[other])], schema=schema)

    return state.select("doc_id", "doc_key", "i", "rank", "width").mapInArrow(run, f"{DOC}, i int, width int, ra long, rb long")


def _suffixes(some: DataFrame, stretches: DataFrame) -> DataFrame:
    """(doc, i, width, ra, rb, from_i, lines, numbers) of suffixes (doc, i, width, ra, rb, from_i): the ranks and numbers of their lines to the whole depth."""
    schema = _schema(i=INT, width=INT, ra=LONG, rb=LONG, from_i=INT, lines=LONGS, numbers=INTS)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        names = ("x", "i", "number", "rank", "width")
        for doc_id, key, x, i, number, rank, width in zip(batch.column("doc_id").to_pylist(), batch.column("doc_key").to_pylist(), *map(batch.column, names)):
            i, number, rank, width = (c.values.to_numpy() for c in (i, number, rank, width))
            ends = np.concatenate((np.flatnonzero(np.diff(i) != 1) + 1, [len(i)]))
            for own in x.as_py():
                at = int(np.searchsorted(i, own["i"]))
                end = int(ends[np.searchsorted(ends, at, side="right")])
                if at + 1 < end and width[at + 1]:
                    end = at + 1 + int(width[at + 1])
                yield (doc_id, key, own["i"], own["width"], own["ra"], own["rb"], own["from_i"], rank[at:end], number[at:end])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((r for batch in batches for r in rows(batch)), schema)

    asked = some.groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("i", "width", "ra", "rb", "from_i")).alias("x")).alias("a")
    s = stretches.select("doc_id", "doc_key", "i", "number", "rank", "width").alias("s")
    met = asked.join(s, (F.col("a.doc_key") == F.col("s.doc_key")) & F.col("a.doc_id").eqNullSafe(F.col("s.doc_id")))
    met = met.select("a.doc_id", "a.doc_key", "a.x", "s.i", "s.number", "s.rank", "s.width")
    return written(met.mapInArrow(run, f"{DOC}, i int, width int, ra long, rb long, from_i int, lines array<long>, numbers array<int>"))


def common_prefix(a: list[int], b: list[int]) -> int:
    return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def longest_earlier(leaves: Iterable[tuple[list[int], tuple, object]]) -> Iterator[tuple[object, int]]:
    """(leaf, lines) of leaves (lines, place, leaf) sorted by their lines, all different: the longest prefix shared with a leaf of an earlier place, 0 for the first.

    The tree of common-prefix intervals is walked bottom-up; `open_` holds its nodes from the root to the
    last leaf, each with the earliest leaf below it so far.
    """
    open_: list[tuple[int, tuple]] = []
    last = None

    def met(a: tuple, b: tuple, n: int):
        first, later = (a, b) if a[0] < b[0] else (b, a)
        return first, (later[1], n)

    def close(down_to: int):
        own = last[1]
        while open_ and open_[-1][0] > down_to:
            n, earliest = open_.pop()
            own, found = met(earliest, own, n)
            yield found
        if open_ and open_[-1][0] == down_to:
            n, earliest = open_.pop()
            own, found = met(earliest, own, n)
            yield found
        open_.append((down_to, own))

    for lines, place, leaf in leaves:
        if last is not None:
            yield from close(common_prefix(last[0], lines))
        last = (lines, (place, leaf))
    if last is not None:
        yield from close(0)
        yield open_[0][1][1], 0


def _walked(suffixes: DataFrame) -> DataFrame:
    """(ca, cb, doc_id, doc_key, i, most): each distinct suffix by two hashes, its first place, and how many lines it shares with an earlier one there."""
    schema = pa.schema({"ca": LONG, "cb": LONG, "doc_id": LONG, "doc_key": LONG, "i": INT, "most": INT})

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
        for batch in batches:
            key = zip(*(batch.column(c).to_pylist() for c in ("width", "ra", "rb")))
            for k, lines, ca, cb, first in zip(key, *(batch.column(c).to_pylist() for c in ("lines", "ca", "cb", "first"))):
                place = (first["last"], first["doc_id"] or 0, first["doc_key"], first["i"])
                yield k, (lines, place, (ca, cb, first["doc_id"], first["doc_key"], first["i"]))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for _, interval in groupby(leaves(batches), lambda x: x[0]):
            for leaf, most in longest_earlier(x for _, x in interval):
                yield (*leaf, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), schema)

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_key", "i")).alias("first")
    leaf = suffixes.groupBy("width", "ra", "rb", "lines", F.xxhash64("lines").alias("ca"), F.xxhash64(F.lit(1), "lines").alias("cb")).agg(first)
    ordered = leaf.repartition("width", "ra", "rb").sortWithinPartitions("width", "ra", "rb", "lines")
    return written(ordered.mapInArrow(run, "ca long, cb long, doc_id long, doc_key long, i int, most int"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, doc_key, lines): numbers from 0 of the lines to delete, only of documents that have any.

    A line goes if it lies in a run of at least `min_words` words that also occurs earlier. Where that run
    begins in the same document, the first copy of its shortest beginning of `min_words` words stays
    whole, even if the later one overlaps it. doc_key is xxhash64(doc_id, text). Order is by doc_id
    (null last), then doc_key, then line. Equal rows (doc_id and text) count once. Lines are compared byte
    for byte (by hashes of 128 bits); those without a word are no part of the sequence. Null and empty texts
    have no lines; an empty table gives an empty result; other columns are ignored.
    """
    lines = written(_lines(docs))
    ranks = _ranked(lines)
    stretches = _stretches(lines.join(ranks, ["a", "b"]), min_words)
    drop(lines, ranks)
    longest = stretches.agg(F.max(F.array_max("width"))).first()[0] or 0
    nothing = stretches.select("doc_id", "doc_key", F.col("number").alias("lines"))
    if not longest:
        return nothing.limit(0)
    states, pieces, level = [stretches], [_beginnings(stretches, 0)], 0
    while (2 << level) <= longest:
        pairs = _pairs(states[-1], 1 << level)
        ranks = _ranked(pairs)
        states.append(_gathered(pairs.join(ranks, ["a", "b"])))
        drop(ranks)
        level += 1
        pieces.append(_beginnings(states[-1], level))
    beginnings = pieces[0]
    for p in pieces[1:]:
        beginnings = beginnings.unionAll(p)
    beginnings = written(beginnings)
    drop(*states[1:])
    key = ["width", "ra", "rb"]
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_key", "i")
    # Written: the join's sides are then plain shuffles, and a common run's rows can be split.
    first = written(beginnings.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    some = beginnings.join(first, key)
    inside = (F.col("doc_key") == F.col("first.doc_key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    some = some.withColumn("from_i", F.when(inside, F.col("first.i") + F.col("width")).otherwise(0))
    suffixes = _suffixes(some.select("doc_id", "doc_key", "i", *key, "from_i"), stretches)
    drop(beginnings, first, stretches)
    walked = _walked(suffixes).toDF("ca", "cb", "at_doc", "at_key", "at_i", "most")
    rows = suffixes.withColumns({"ca": F.xxhash64("lines"), "cb": F.xxhash64(F.lit(1), "lines")}).join(walked, ["ca", "cb"])
    leads = (F.col("doc_key") == F.col("at_key")) & F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("i") == F.col("at_i"))
    rows = rows.withColumn("most", F.when(leads, F.col("most")).otherwise(F.size("lines"))).where("most > 0")
    gone = F.filter(F.slice("numbers", F.lit(1), F.col("most")), lambda _, k: F.col("i") + k >= F.col("from_i"))
    rows = rows.select("doc_id", "doc_key", gone.alias("gone")).where(F.size("gone") > 0)
    return rows.groupBy("doc_id", "doc_key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("lines"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated runs; columns are those of `docs`, texts are shorter.

    Rows whose text is null or has nothing to delete stay as they are; a text all of whose lines go becomes empty.
    """
    gone = repeated_lines(docs, min_words).toDF("gone_id", "gone_key", "gone")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_id.alias("id"), F.xxhash64(doc_id, text).alias("key"))
    rows = rows.join(gone, (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    kept = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    shorter = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return rows.select(*[shorter.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def repeated_lines_sql(min_words: int = MIN_WORDS) -> str:
    """The same for DuckDB, over documents with distinct ids: all beginnings of suffixes are compared as text; lines as a list in a string."""
    return rf"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number
    FROM (SELECT DISTINCT doc_id, text FROM documents)),
  c AS (SELECT *, len(list_filter(string_split_regex(x, '[ \x09-\x0D]+'), lambda w: w <> '')) AS n FROM x),
  l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number) AS i, count(*) OVER (PARTITION BY doc_id) AS last,
    CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY number) AS BIGINT) AS upto FROM c WHERE n > 0),
  p AS (SELECT a.doc_id, a.i AS a, min(b.i) AS f FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {min_words}
    WHERE b.upto - a.upto + a.n >= {min_words} GROUP BY ALL),
  d AS (SELECT p.doc_id, p.a, p.f, coalesce(q.f, last) AS deepest FROM p JOIN (SELECT DISTINCT doc_id, last FROM l) USING (doc_id)
    LEFT JOIN p q ON q.doc_id = p.doc_id AND q.a = p.a + 1),
  r AS (SELECT doc_id, a, f, unnest(range(f, deepest + 1)) AS b FROM d),
  k AS (SELECT r.doc_id, a, f, b, string_agg(x, chr(10) ORDER BY i) AS run FROM r JOIN l ON r.doc_id = l.doc_id AND i BETWEEN a AND b GROUP BY ALL),
  o AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS in_doc, first_value(a) OVER w AS starts FROM k WINDOW w AS (PARTITION BY run ORDER BY doc_id, a)),
  e AS (SELECT doc_id, a, max(b) FILTER (place > 1) AS b, max(CASE WHEN b = f AND in_doc = doc_id THEN starts + f - a + 1 ELSE 0 END) AS from_i FROM o GROUP BY doc_id, a),
  g AS (SELECT DISTINCT l.doc_id, number FROM e JOIN l ON e.doc_id = l.doc_id AND l.i BETWEEN e.a AND e.b AND l.i >= from_i)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS lines FROM g GROUP BY doc_id"""
