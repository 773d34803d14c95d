"""The pipeline against a plain version of every stage, written out in Python."""

import math
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, language, mixing
from tessera.llm.common import table, written
from tests.llm.helpers import no_docs, odd_docs
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_language import best_path
from tests.llm.test_mixing import fill
from tests.llm.test_nearcopies import kept as one_of_each

SF = "/root/testdata/sf0.001"


def spark_hash(*values):
    """XXH64 of values one after the other, each seeded by the one before."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<" + kind, v), h)
    return h


def signed(h):
    return h - 2**64 if h >> 63 else h


def uniform(h):
    return (h % 2**52 + 0.5) / 2**52


def known_language(model, text):
    words = [w for w in re.findall(r"[^\W\d_]+", text.lower()) if any(map(str.isalpha, w))]
    if not words:
        return False
    scorer = language.Scorer(model)
    ids = scorer(words)
    votes = np.bincount(best_path(scorer.scores[ids], language.PENALTY), scorer.letters[ids])
    return votes.max() >= votes.sum() / 3


def copies_of(docs, model):
    """How often the mix takes each document, drawn by the labels' model."""
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs}
    of = defaultdict(list)
    for r in docs:
        row_key = signed(spark_hash(("q", r.doc_id), ("s", r.text), ("s", r.lang), ("s", r.source), ("q", r.n_chars)))
        noise = sum(c in mixing.NOISE for c in r.text) / max(1, len(r.text))
        quality = max(0.05, 1 / (1 + math.exp(-(model.bias + model.noise * noise + model.noise2 * noise**2 + model.length * math.log1p(len(r.text))))))
        key = -math.log(uniform(spark_hash(("i", 0), ("q", row_key)))) / quality
        of[r.source].append((key, r.doc_id))
    total = {s: sum(size[i] for _, i in rows) for s, rows in of.items()}
    target, out = fill(total), {}
    for s, rows in of.items():
        epochs = int(target[s] // total[s])
        left = round(target[s]) - epochs * total[s]
        for _, i in sorted(rows):
            out[i] = epochs + (2 * left >= max(1, size[i]))
            left -= size[i]
    return out


def shard_of(doc_id, n):
    return min((-math.log(uniform(spark_hash(("q", doc_id), ("i", j)))), j) for j in range(n))[1]


def test_against_plain_python(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language.fit(docs)
    kept = [i for i in rows if known_language(model, rows[i].text)]
    kept = sorted(one_of_each([(i, rows[i].text) for i in kept]))
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    kept = sorted(set(kept) - {d for d, _ in leaks([(i, rows[i].text) for i in kept], bench)})
    model = mixing.fit_quality(docs.where(F.col("doc_id").isin(kept)), table(spark, SF, "labels"))
    copies = copies_of([rows[i] for i in kept], model)
    want = sorted((i, len(rows[i].text.encode()) + 8, zlib.crc32(rows[i].text.encode()), shard_of(i, 24), shard_of(i, 25)) for i in kept for _ in range(copies[i]))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {tuple(r) for r in docs.collect()}
        docs = written(stage(spark, docs, SF))
        assert docs.columns == names and {tuple(r) for r in docs.collect()} <= before, name


def test_odd_and_empty(spark):
    for docs in (odd_docs(spark), no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= 3 * docs.count()


def test_items_found_whole(spark):
    items = table(spark, SF, "benchmark")
    docs = items.selectExpr("item_id + 5000000000 AS doc_id", "concat('before ', text, ' after') AS text")
    assert decontaminate.keep_clean(docs, items).count() == 0
