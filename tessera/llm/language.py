"""Language identification of whole and of mixed-language texts.

Each word's script narrows the languages it can be in; a smoothed model of hashed character trigrams
scores it under those; the best label sequence under a penalty for each switch (Viterbi) cuts the
text into spans. A document's language is the one with most letters, its score that share; letters in
scripts that no language has are part of the whole but of no share. A share says nothing about texts
in a language that wasn't learned: `keep_identified` also asks how well the trigrams fit.

The model is fitted on at most `rows_per_lang` (in expectation) labelled rows of each language, picked by
a hash of the id. Every value of lang is learned; with more than 64 languages the trigrams are hashed into
fewer buckets (1,024 at least), so that the model that is sent to the executors keeps to about two
million numbers. Predictions read nothing but the text.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First code points of script ranges; what lies between two belongs to the earlier one.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
STARTS = [a for a, _ in SCRIPT_RANGES]
SCRIPTS = list(dict.fromkeys(s for _, s in SCRIPT_RANGES))

MOST_BUCKETS, LEAST_BUCKETS, NUMBERS = 1 << 15, 1 << 10, 1 << 21
ROWS_PER_LANG, PENALTY, SCRIPT_SHARE = 2000, 8.0, 0.005
SPREADS = 2.0  # a text's mean trigram score may lie so many standard deviations of single trigrams under the language's mean, short texts' more
IMPOSSIBLE = -60.0
WORD = re.compile(r"[^\W\d_]+")
PIECE = 1 << 20  # characters of a text whose words are held at once
CACHE = 200_000  # words a worker remembers


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray  # (buckets, languages)
    scripts: np.ndarray  # (scripts, languages): whether the language is written in it
    limits: np.ndarray  # (2, languages): least mean trigram score of a long text in the language; what it falls by for one of one trigram


def script(word: str) -> int:
    return SCRIPTS.index(SCRIPT_RANGES[bisect_right(STARTS, ord(word[0])) - 1][1])


def grams(word: str) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def buckets_for(langs: int) -> int:
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, 1 << (NUMBERS // max(1, langs)).bit_length() - 1))


def bucket(gram: str, buckets: int = MOST_BUCKETS) -> int:
    return zlib.crc32(gram.encode()) % buckets


def lower(words: list[str]) -> list[str]:
    """Words are found first and lower-cased then, so that spans, which need the text as it is, see the same words."""
    return "\n".join(words).lower().split("\n") if words else []


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-case words, a bounded piece of the text at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (m := re.compile(r"\s").search(text, end)):
            end = m.start()
        elif end < len(text):
            end = len(text)
        yield lower(WORD.findall(text, at, end))
        at = end


def is_learned(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 != 1


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, smoothing: float = 0.5) -> Model:
    """A model from the labelled rows of (doc_id, text, lang) whose crc32(doc_id) mod 3 isn't 1.

    Trigram counts are summed on the executors; the driver gets as many sums as the model has numbers.
    Null texts and langs teach nothing; without labelled rows the model has no language.
    """
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & is_learned(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    langs = tuple(r.lang for r in sizes)
    buckets = buckets_for(len(langs))
    if not langs:
        return Model((), np.zeros((buckets, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool), np.zeros((2, 0)))
    span = 1 << 20
    limits = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(span, -(-span * rows_per_lang // r.n)))])
    sample = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < limits[F.col("lang")]).select("lang", F.col("text").cast("string").alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                own = sums.setdefault(lang, Counter())
                for words in words_of(text.as_py()):
                    for w, n in Counter(words).items():
                        own[buckets + script(w)] += n * len(w)
                        for g in grams(w):
                            own[bucket(g, buckets)] += n
        rows = [(lang, k, n) for lang, own in sums.items() for k, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["lang", "k", "n"])

    total = sample.mapInArrow(count, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((buckets + len(SCRIPTS), len(langs)))
    counts[total["k"], total["lang"].map({lang: i for i, lang in enumerate(langs)})] = total["n"]
    seen = counts[:buckets] + smoothing
    shares = counts[buckets:] / np.maximum(1, counts[buckets:].sum(0))
    # What the labelled rows' trigrams score, each left out of the counts that score it.
    n = np.maximum(1, counts[:buckets].sum(0))
    left_out = np.log(np.maximum(seen - 1, smoothing) / seen.sum(0))
    mean = (counts[:buckets] * left_out).sum(0) / n
    spread = np.sqrt((counts[:buckets] * (left_out - mean) ** 2).sum(0) / n)
    return Model(langs, np.log(seen / seen.sum(0)).astype(np.float32), shares >= SCRIPT_SHARE, np.stack([mean - SPREADS * spread, 2 * SPREADS * spread]))


class Scorer:
    """Scores of words under each language; remembers a bounded number of words."""

    def __init__(self, model: Model):
        self.model, self.ids, self.buckets = model, {}, {}
        self.scores = np.zeros((0, len(model.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.raw = np.zeros((0, len(model.langs)), np.float32)  # sums of trigram scores as they are
        self.grams = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)  # whether a language has the word's script

    def __call__(self, words: list[str]) -> np.ndarray:
        """Positions of the words in `scores` and `letters`."""
        if len(self.ids) > CACHE:
            self.__init__(self.model)
        get = self.ids.get
        at = [get(w, -1) for w in words]
        if -1 in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at) if i < 0))
            first = len(self.ids)
            self.ids.update(zip(new, range(first, first + len(new))))
            self._score(new)
            at = [get(w) for w in words]
        return np.array(at, np.int64)

    def _score(self, words: list[str]) -> None:
        flat, starts, known = [], [], self.buckets
        if len(known) > CACHE:
            known.clear()
        for w in words:
            starts.append(len(flat))
            for g in grams(w):
                b = known.get(g)
                if b is None:
                    b = known[g] = bucket(g, len(self.model.logp))
                flat.append(b)
        scores = np.add.reduceat(self.model.logp[flat], starts, axis=0)
        letters = np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words], np.int64)
        fits = self.model.scripts[[script(w) for w in words]]
        self.raw = np.concatenate([self.raw, scores])
        self.grams = np.concatenate([self.grams, np.diff([*starts, len(flat)])])
        self.known = np.concatenate([self.known, fits.any(1)])
        scores += np.where(fits | ~fits.any(1, keepdims=True), 0, IMPOSSIBLE)
        # A script that no language has, or no letter at all, says nothing.
        scores[~fits.any(1) | (letters == 0)] = 0
        scores -= scores.max(1, keepdims=True)
        self.scores = np.concatenate([self.scores, scores])
        self.letters = np.concatenate([self.letters, letters])


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Labels of the words of many texts, laid end to end, each text on its own.

    Texts advance together, the longest first, so that one step is a few operations on a slice.
    Ties go to the label of the word before, then to the first language.
    """
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    steps = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), side="right")
    at = np.concatenate(([0], np.cumsum(active)))
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = at[np.arange(n) - starts[doc]] + rank[doc]
    dealt = np.empty_like(scores)
    dealt[place] = scores

    before = np.zeros((n, k), np.float32)  # scores of the best paths just before a word
    best = np.zeros((len(lengths), k), np.float32)
    for t in range(steps):
        a, b = at[t], at[t + 1]
        now = best[: b - a]
        if t:
            before[a:b] = now
            np.maximum(now, now.max(1, keepdims=True) - np.float32(penalty), out=now)
        now += dealt[a:b]
    stays = before >= before.max(1, keepdims=True) - np.float32(penalty)
    came = np.where(stays, np.arange(k, dtype=np.int16), before.argmax(1).astype(np.int16)[:, None])
    labels = np.empty(n, np.int16)
    label = best.argmax(1).astype(np.int16)
    rows = np.arange(len(lengths))
    for t in range(steps - 1, -1, -1):
        a, b = at[t], at[t + 1]
        now = label[: b - a]
        labels[a:b] = now
        label[: b - a] = came[a:b][rows[: b - a], now]
    return labels[place]


class Path:
    """Viterbi over one text that comes in pieces, with the labels that the whole text would get.

    Where the best label leads every other by more than the penalty, all paths come through it: what lies
    before is settled, and only what follows is held for the next piece.
    """

    def __init__(self, penalty: float = PENALTY):
        self.penalty, self.start, self.held = np.float32(penalty), None, None

    def add(self, scores: np.ndarray, last: bool = False) -> np.ndarray:
        """The labels that are settled now, following those of the calls before; all that are left if it is the last piece."""
        scores = scores if self.held is None else np.concatenate([self.held, scores])
        n, k = scores.shape
        if not n:
            return np.zeros(0, np.int16)
        # A label's score is that of its best path less that of the best of all, before and after a word.
        now = np.zeros(k, np.float32) if self.start is None else self.start
        came, leads = np.empty((n, k), np.int16), np.full(n, -1, np.int16)
        own = np.arange(k, dtype=np.int16)
        for t in range(n):
            top = now.max()
            came[t] = np.where(now >= top - self.penalty, own, now.argmax())
            now = np.maximum(now, top - self.penalty) + scores[t]
            now -= now.max()
            if (now < -self.penalty).sum() == k - 1:
                leads[t] = now.argmax()
        ends = n - 1 if last else int(np.flatnonzero(leads >= 0)[-1]) if (leads >= 0).any() else -1
        if ends < 0:
            self.held = scores
            return np.zeros(0, np.int16)
        labels = np.empty(ends + 1, np.int16)
        labels[ends] = now.argmax() if last else leads[ends]
        for t in range(ends, 0, -1):
            labels[t - 1] = came[t][labels[t]]
        if not last:
            # The words that follow start from the label that leads.
            self.start = np.where(own == leads[ends], np.float32(0), -2 * self.penalty - 1).astype(np.float32)
            self.held = scores[ends + 1 :]
        return labels


def _votes(texts: list[str | None], scorer: Scorer, penalty: float) -> tuple[np.ndarray, ...]:
    """For each text the letters by language, the sum of word scores by language, all letters, and by language the sum and number of its own words' trigram scores."""
    k = len(scorer.model.langs)
    votes, sums, all_letters = np.zeros((len(texts), k)), np.zeros((len(texts), k)), np.zeros(len(texts))
    raw, grams = np.zeros((len(texts), k)), np.zeros((len(texts), k))
    held: list[str] = []
    lengths: list[tuple[int, int]] = []

    def count(doc: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Take in words, of a scorer's ids, of texts `doc` under their labels."""
        scores, letters = scorer.scores[ids], scorer.letters[ids]
        cell = doc * k + labels
        known = scorer.known[ids] & (letters > 0)
        all_letters[:] += np.bincount(doc, letters, len(texts))
        for to, x in ((votes, letters), (raw, scorer.raw[ids, labels]), (grams, scorer.grams[ids])):
            to += np.bincount(cell, x * known, votes.size).reshape(votes.shape)
        for j in range(k):
            sums[:, j] += np.bincount(doc, scores[:, j], len(texts))

    def close() -> None:
        if held:
            ids = scorer(held)
            doc = np.repeat([i for i, _ in lengths], [n for _, n in lengths])
            count(doc, ids, viterbi(scorer.scores[ids], np.array([n for _, n in lengths]), penalty))
        held.clear()
        lengths.clear()

    def long(i: int, text: str) -> None:
        """A text of several pieces; words whose labels aren't settled yet wait as words, for the scorer may forget."""
        path, waiting = Path(penalty), []
        for words in words_of(text):
            if words:
                waiting += words
                ids = scorer(words)
                settle(i, path.add(scorer.scores[ids]), waiting)
        settle(i, path.add(np.zeros((0, k), np.float32), last=True), waiting)

    def settle(i: int, labels: np.ndarray, waiting: list[str]) -> None:
        n = len(labels)
        if n:
            ids = scorer(waiting[:n])
            count(np.full(n, i), ids, labels)
            del waiting[:n]

    for i, text in enumerate(texts):
        if text and len(text) > PIECE:
            long(i, text)
            continue
        for words in words_of(text or ""):
            if words:
                held.extend(words)
                lengths.append((i, len(words)))
        if len(held) > 300_000:
            close()
    close()
    return votes, sums, all_letters, raw, grams


def _judged(texts: pa.Array, scorer: Scorer, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the position of its language (-1: none), that language's share of the letters, and whether its words fit the language."""
    picks, shares, fits = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for i in range(0, len(texts) if scorer.model.langs else 0, 512):
        votes, sums, letters, raw, grams = _votes(texts.slice(i, 512).to_pylist(), scorer, penalty)
        first = -np.arange(votes.shape[1]) * np.ones_like(votes)
        top = np.lexsort((first, sums, votes), axis=1)[:, -1]
        own, (limit, slack) = (np.arange(len(top)), top), scorer.model.limits
        part = slice(i, i + len(votes))
        picks[part] = np.where(letters > 0, top, -1)
        shares[part] = votes[own] / np.maximum(letters, 1)
        fits[part] = (grams[own] > 0) & (raw[own] >= limit[top] * grams[own] - slack[top] * np.sqrt(grams[own]))
    return picks, shares, fits


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of (doc_id, text).

    `und` with score 0 for a null text, one without a letter, or if nothing could be learned. Letters in
    scripts that no language has count for none, yet the best-scored (then first) language is named.
    Ties go to the larger sum of word scores, then to the language learned from more rows. Repeated
    rows are judged each; other columns are ignored.
    """
    langs = np.array([*model.langs, "und"], object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            picks, shares, _ = _judged(batch.column("text"), scorer, penalty)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs[picks], pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, start, end, lang): maximal runs of words in one language, as character offsets into the text.

    Null texts and those without letters have no spans, nor has any text under a model without languages. A
    span ends before another language's first word; digits and symbols between words belong to none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = [m for m in WORD.finditer(text.as_py() or "") if any(map(str.isalpha, m[0]))] if model.langs else []
                if not found:
                    continue
                ids = scorer(lower([m[0] for m in found]))
                labels = viterbi(scorer.scores[ids], np.array([len(found)]), penalty)
                cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(found)]
                out += [(doc_id, found[a].start(), found[b - 1].end(), model.langs[labels[a]]) for a, b in zip(cuts, cuts[1:])]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "start", "end", "lang"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, start int, end int, lang string")


def keep_identified(docs: DataFrame, model: Model, least: float = 1 / 3) -> DataFrame:
    """The documents with a language that has at least a third of their letters; columns are those of `docs`.

    Texts that mix languages stay; those without a letter (null and empty ones too), without a leading
    language, or whose words in that language score below its limit (texts in a language that wasn't
    learned), go. Repeated rows are judged each; an empty table stays empty; under a model without
    languages nothing stays.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            picks, shares, fits = _judged(batch.column("text"), scorer, PENALTY)
            yield batch.filter(pa.array((picks >= 0) & (shares >= least) & fits))

    return docs.mapInArrow(run, docs.schema)
