"""Benchmark decontamination: passages within an edit distance of benchmark items.

An item of n words leaks into a document that has a passage at most k = floor(0.2 n) word edits away.
Candidates come from LSH over windows of the item's size, an exact edit distance decides:

A CGK random walk reads a string of words: at each step the word it stands on gives out bits, and a random
bit of that word says whether the walk goes on to the next. Two strings' walks run together up to an
edit and fall back into step after it with some chance, so that edit distance becomes Hamming distance.
Walks start at every eighth word and run a few words far, so that some of them meet few edits; each
table takes sampled bits of one walk. How many walks start at a place follows from n, k and the target
recall, how many bits are sampled from the number of tables: unrelated windows collide in less than
one case of `RARE`.

Windows are laid only where they can matter, which loses nothing: a passage within k edits shares with its
item a run of floor(n / (k + 1)) words unchanged (pigeonhole), so windows of the item's size are laid at
all shifts up to k around such runs. `everywhere` lays them at every word; tests measure the recall of
LSH that way.

Everything is one pass over the documents, without a shuffle. Items are read in blocks of bounded
size: another block is another pass, whatever the benchmark's size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILARITY, RECALL, SEED = 0.8, 0.999, 7
SPACING, STEPS, RARE = 8, 12, 400  # words from one start of walks to the next, steps of a walk, see above
BACK = 1 / 5  # chance that two walks run on together after an edit, their bits equal
AT_ONCE = 256  # windows embedded at once
BLOCK_ITEMS = 4096  # items sent to the executors at once
BLOCK_WORDS = 1 << 20  # and their words at most; a longer item goes alone
PIECE = 1 << 21  # characters of a text whose words are held at once
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def edits(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def passage_distance(item: list[int], window: list[int], most: int) -> tuple[int, int]:
    """(least edit distance of the item to any run of the window, end of the first such run).

    More than `most` comes back as most + 1. Insertions before and after the run are free.
    """
    w = np.asarray(window)
    row = np.zeros(len(w) + 1, np.int64)
    steps = np.arange(len(w) + 1)
    for i, x in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (w != x), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps  # insertions along the window
        if row.min() > most:
            return most + 1, -1
    end = int(row.argmin())
    return int(row[end]), end


def walks(n: int, most: int, recall: float = RECALL) -> int:
    """Walks from each start that find a string of n words after `most` edits at random places with the recall."""
    starts, inside = len(range(0, max(1, n - SPACING + 1), SPACING)), min(1.0, STEPS / 2 / n)
    chance = [math.comb(most, e) * inside**e * (1 - inside) ** (most - e) for e in range(most + 1)]
    for out in range(16, 1025, 16):
        if sum(c * (1 - BACK**e) ** out for e, c in enumerate(chance)) ** starts <= 1 - recall:
            break
    return out


class Cgk:
    """Random walks over windows of n words, and LSH tables over bits sampled from them."""

    def __init__(self, n: int, most: int, recall: float = RECALL):
        rng = np.random.default_rng([SEED, n])
        starts = range(0, max(1, n - SPACING + 1), SPACING)
        each = walks(n, most, recall)
        self.n, self.steps, self.tables = n, min(STEPS, n), each * len(starts)
        self.start = np.repeat(starts, each)
        self.bits = math.ceil(math.log2(RARE * self.tables))
        self.per_step = max(2, -(-self.bits // self.steps))
        self.flips = rng.integers(1, 2**62, (self.tables, self.steps), dtype=np.uint64) | np.uint64(1)
        self.colors = rng.integers(1, 2**62, (self.tables, self.steps * self.per_step), dtype=np.uint64) | np.uint64(1)
        self.sampled = rng.permuted(np.tile(np.arange(self.steps * self.per_step), (self.tables, 1)), axis=1)[:, : self.bits]
        self.weights = (1 << np.arange(self.bits)).astype(np.int64)
        self.table = np.arange(self.tables, dtype=np.int64) << self.bits

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """(rows, tables) LSH keys of rows of word hashes, n words each; a key tells its table."""
        padded = np.hstack([rows, np.zeros((len(rows), 1), np.uint64)])  # past its end a walk stays at a blank
        out = np.empty((len(rows), self.tables, self.steps * self.per_step), bool)
        who, top = np.arange(len(rows))[:, None], np.uint64(63)
        at = np.tile(self.start, (len(rows), 1))
        for j in range(self.steps):
            word = padded[who, np.minimum(at, self.n)]
            for c in range(j * self.per_step, (j + 1) * self.per_step):
                out[:, :, c] = (word * self.colors[:, c]) >> top
            at += ((word * self.flips[:, j]) >> top).astype(np.int64)  # the word's own random bit moves a walk on
        return np.take_along_axis(out, self.sampled[None], 2) @ self.weights + self.table


class Items:
    """A block of benchmark items, ready for search in texts."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float, everywhere: bool = False):
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.similarity, self.recall, self.everywhere = similarity, recall, everywhere
        self.vocabulary: dict[str, int] = {}
        self.coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in self.items]
        self.hash = np.array([xxhash.xxh64_intdigest(w, SEED) for w in self.vocabulary] + [0], np.uint64)
        self.base = len(self.vocabulary) + 1
        # Run length to: packed run -> offsets at which items of n words have it, as (n, offset).
        self.runs: dict[int, dict[int, set[tuple[int, int]]]] = {}
        self.of_length: dict[int, list[int]] = {}
        for i, words in enumerate(self.coded):
            run = self.run_length(len(words))
            own = self.runs.setdefault(run, {})
            for o in range(len(words) - run + 1):
                own.setdefault(self._pack(words[o : o + run]), set()).add((len(words), o))
            self.of_length.setdefault(len(words), []).append(i)
        self.sorted = {run: np.array(sorted(own), np.uint64) for run, own in self.runs.items()}
        self.tables: dict[int, tuple[Cgk, np.ndarray, np.ndarray]] = {}

    def run_length(self, n: int) -> int:
        # More than eight words make no difference to what is found, only to how often a run occurs.
        return min(8, max(1, n // (edits(n, self.similarity) + 1)))

    def _pack(self, words: list[int]) -> int:
        return reduce(lambda a, w: (a * self.base + w) % 2**64, words, 0)

    def _lsh(self, n: int) -> tuple[Cgk, np.ndarray, np.ndarray]:
        """Walks for items of n words; those items' keys in order, and the items."""
        if n not in self.tables:
            cgk, own = Cgk(n, edits(n, self.similarity), self.recall), np.array(self.of_length[n])
            rows = self.hash[np.array([self.coded[i] for i in own])]
            keys = np.concatenate([cgk.keys(rows[a : a + AT_ONCE]).ravel() for a in range(0, len(rows), AT_ONCE)])
            order = np.argsort(keys, kind="stable")
            self.tables[n] = (cgk, keys[order], np.repeat(own, cgk.tables)[order])
        return self.tables[n]

    def candidates(self, n: int, windows: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) of windows (rows of n word hashes) that share a key of a table."""
        cgk, keys, items = self._lsh(n)
        out: set[tuple[int, int]] = set()
        for a in range(0, len(windows), AT_ONCE):
            found = cgk.keys(windows[a : a + AT_ONCE])
            low = np.searchsorted(keys, found)
            for row, table in np.argwhere(keys[np.minimum(low, len(keys) - 1)] == found).tolist():
                high = np.searchsorted(keys, found[row, table], side="right")
                out.update((a + row, i) for i in items[low[row, table] : high].tolist())
        return out

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(position in `items`, word edits, word at which the passage ends) of all leaks in a text, best first by item."""
        longest = max(map(len, self.coded), default=0)
        carried: list[int] = []
        at, skipped = 0, 0
        best: dict[int, tuple[int, int]] = {}
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                m = re.compile(r"\W").search(text, end)
                end = m.start() if m else len(text)
            get = self.vocabulary.get
            codes = carried + [get(w, -1) for w in words_of(text[at:end])]
            at = end
            for item, found in self._find(np.array(codes, np.int64)).items():
                found = (found[0], found[1] + skipped)
                best[item] = min(best.get(item, found), found)
            keep = 2 * longest
            skipped += max(0, len(codes) - keep)
            carried = codes[-keep:] if keep else []
        yield from ((item, *found) for item, found in sorted(best.items()))

    def _starts(self, codes: np.ndarray) -> dict[int, set[int]]:
        """Where windows are laid: item length to the windows' first words, which may lie before the text."""
        if self.everywhere:
            return {n: set(range(-edits(n, self.similarity), len(codes))) for n in self.of_length}
        runs: dict[int, set[int]] = {}
        known = codes >= 0
        for run, own in self.runs.items():
            if len(codes) < run:
                continue
            fits = known[: len(codes) - run + 1].copy()
            for j in range(1, run):
                fits &= known[j : len(codes) - run + 1 + j]
            places = np.flatnonzero(fits)
            packed = np.zeros(len(places), np.uint64)
            for j in range(run):
                packed = packed * np.uint64(self.base) + codes[places + j].astype(np.uint64)
            keys = self.sorted[run]
            hit = keys[np.minimum(np.searchsorted(keys, packed), len(keys) - 1)] == packed
            for place, key in zip(places[hit].tolist(), packed[hit].tolist()):
                for n, offset in own[key]:
                    runs.setdefault(n, set()).add(place - offset)
        return {n: {s + d for s in starts for d in range(-edits(n, self.similarity), edits(n, self.similarity) + 1)} for n, starts in runs.items()}

    def _find(self, codes: np.ndarray) -> dict[int, tuple[int, int]]:
        best: dict[int, tuple[int, int]] = {}
        if not len(codes):
            return best
        # Words that no item has are all different: each gets bits of its own by its place.
        own = (np.arange(len(codes), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        hashes = np.where(codes >= 0, self.hash[codes], own)
        for n, starts in self._starts(codes).items():
            slack = edits(n, self.similarity)
            ordered = np.array(sorted(s for s in starts if s > -n and s < len(codes)), np.int64)
            padded = np.concatenate([np.zeros(n, np.uint64), hashes, np.zeros(n, np.uint64)])
            found: dict[int, list[int]] = {}
            for a in range(0, len(ordered), AT_ONCE):
                windows = padded[(ordered[a : a + AT_ONCE] + n)[:, None] + np.arange(n)]
                for row, item in self.candidates(n, windows):
                    found.setdefault(item, []).append(int(ordered[a + row]))
            for item, at in found.items():
                at.sort()
                # Windows near each other are verified as one.
                cut = [0, *(i for i in range(1, len(at)) if at[i] - at[i - 1] > n), len(at)]
                for a, b in zip(cut, cut[1:]):
                    low, high = max(0, at[a] - slack), min(len(codes), at[b - 1] + n + slack)
                    distance, end = passage_distance(self.coded[item], codes[low:high].tolist(), slack)
                    if distance <= slack:
                        best[item] = min(best.get(item, (distance, low + end)), (distance, low + end))
        return best


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed to the driver one partition at a time."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    block: list[tuple[int, str]] = []
    held = 0
    for r in rows.toLocalIterator():
        n = len(r.text) // 2
        if block and (len(block) >= BLOCK_ITEMS or held + n > BLOCK_WORDS):
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += n
    if block:
        yield block


def _searched(docs: DataFrame, block: list[tuple[int, str]], similarity: float, recall: float) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block, similarity, recall)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for item, distance, end in items.find(text.as_py() or ""):
                    ident, words = items.items[item]
                    out.append((doc_id, ident, distance, 1 - distance / len(words), end))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "item_id", "edits", "similarity", "end_word"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, item_id long, edits int, similarity double, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, edits, similarity, end_word): each document and item it holds, by its best passage.

    Words are runs of letters, digits and underscores, lower-cased; edits are of words, at most
    (1 - similarity) of the item's. end_word counts the words up to the end of the earliest best passage.
    Null or wordless items match nothing, nor do null or empty texts; several texts under an item_id are
    items each; repeated documents give repeated rows. Other columns are ignored.
    """
    found = [_searched(docs, block, similarity, recall) for block in blocks_of(benchmark)]
    return reduce(DataFrame.unionAll, found) if found else _searched(docs.limit(0), [], similarity, recall)


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents that hold no benchmark passage; columns are those of `docs`."""

    def clean(block: list[tuple[int, str]]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(block, similarity, recall)
            for batch in batches:
                yield batch.filter(pa.array([next(items.find(t.as_py() or ""), None) is None for t in batch.column("text")], pa.bool_()))

        return run

    for block in blocks_of(benchmark):
        docs = docs.mapInArrow(clean(block), docs.schema)
    return docs
