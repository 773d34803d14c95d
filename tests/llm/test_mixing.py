import math
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import mixing as M
from tests.llm.helpers import corpus, no_docs, odd_docs


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        total, share = sum(weight[s] for s in open_), left
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s] / total
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def signed(h):
    return h - 2**64 if h >> 63 else h


def brute(docs):
    """(doc_id, taken) and (doc_id, copies) of (doc_id, text, source), by sorting each source by its keys."""
    rows = defaultdict(list)
    for i, text, source in docs:
        h = 42
        for kind, v in (("q", i), ("s", text), ("s", source)):
            if v is not None:
                h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<q", v), h)
        h = xxhash.xxh64_intdigest(struct.pack("<q", signed(h)), xxhash.xxh64_intdigest(struct.pack("<i", 0), 42))
        good = max(0.05, sum(c not in M.NOISE for c in text or "") / max(1, len(text or "")) if text is not None else 0)
        rows[source].append((-math.log((h % 2**52 + 0.5) / 2**52) / good, i, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    total = {s: sum(n for *_, n in own) for s, own in rows.items()}
    target, words, copies = fill(total), [], []
    for s, own in rows.items():
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest = round(target[s]) - epochs * total[s]
        for _, i, n in sorted(own):
            some = min(max(rest, 0), n)
            words.append((i, epochs * n + some))
            copies.append((i, epochs + (2 * rest >= n and rest > 0)))
            rest -= n
    return sorted(words), sorted(copies)


@pytest.mark.parametrize("seed", [5, 6])
def test_each_document_against_brute_force(spark, seed):
    rng, texts = corpus(seed, 300, low=1, high=70)
    docs = [(i, " ".join(t) + rng.choice(["", " 12 #!", " ;;; ;;; ;;;"]), rng.choices("abc", [8, 1, 3])[0]) for i, t in enumerate(texts)]
    docs += [docs[7], (900, docs[9][1], "a"), (901, "one", None)] + [(902, "a few equal words", "b")] * 40
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    words, copies = brute(docs)
    assert sorted((r.doc_id, r.taken) for r in M.taken(frame).collect()) == words
    got = Counter(r.doc_id for r in M.mix(frame).collect())
    want = Counter()
    for i, n in copies:
        want[i] += n
    assert got == +want


@pytest.mark.parametrize("n", [3, 10_000])
def test_equal_rows_at_the_end_of_a_budget(spark, n):
    """All rows of a source are equal: only some of them can be taken, and they are split to the word."""
    docs = spark.createDataFrame([(1, "two words", "a")] * n + [(2, "and three words", "b")] * n + [(3, "x", "c")], "doc_id long, text string, source string")
    rows = M.taken(docs).collect()
    assert len(rows) == 2 * n + 1
    for i, source in enumerate("ab", 1):
        own = [r for r in rows if r.doc_id == i]
        assert len(own) == n and sum(r.taken for r in own) == round(own[0].target) and max(r.taken for r in own) - min(r.taken for r in own) <= own[0].size
        mixed = M.mix(docs).where(F.col("source") == source).count() * own[0].size
        assert abs(mixed - own[0].target) <= own[0].size / 2 + 0.5


def check(spark, docs):
    rows = M.taken(docs).collect()
    assert len(rows) == docs.count()
    source = defaultdict(list)
    for r in docs.collect():
        source[r.doc_id].append((r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))))
    sizes, taken, seen = defaultdict(int), defaultdict(int), {}
    for s, n in (x for v in source.values() for x in v):
        sizes[s] += n
    want = fill(sizes)
    for r in rows:
        s, n = source[r.doc_id].pop()
        assert r.size == n and r.source_size == sizes[s] and 0 <= r.taken <= 3 * n
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        taken[s] += r.taken
        seen[s] = r.target
    assert all(abs(taken[s] - seen[s]) <= 0.5 + 1e-6 for s in seen)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, M.taken(docs.repartition(7)).collect()), key=repr)


def test_targets_are_met(spark):
    rng, texts = corpus(3, 400, low=0, high=90)
    names = ["b", "B", "é", "z", None, "a", "aa"]
    rows = [(i, " ".join(t), rng.choices(names, [50, 5, 2, 9, 1, 30, 3])[0]) for i, t in enumerate(texts)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_odd_and_empty(spark):
    check(spark, odd_docs(spark))
    assert M.taken(no_docs(spark)).count() == 0 and M.mix(no_docs(spark)).count() == 0
    zero = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in M.taken(zero).collect()} == {(0.0, 0)}


def test_whole_epochs_come_first_and_keys_follow_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 100 else "b") for i in range(400)], "doc_id long, text string, source string")
    assert {r.of: r.epochs for r in M.cuts(M.drawn(docs)).collect()} == {"a": 2, "b": 0}
    assert {r.taken // 10 for r in M.taken(docs).collect() if r.doc_id < 100} == {2, 3}
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    n = mixed.groupBy("source").count().collect()
    assert abs({r.source: r["count"] for r in n}["a"] - 250 - 50 / 7 * 5) < 80 and sum(r["count"] for r in n) == 400
    # Every other text is two thirds symbols: a plain one is drawn about three times as often among the first.
    noisy = F.expr("if(doc_id % 2 = 0, text, repeat('#9 ', 10))")
    first = [r.doc_id for r in M.drawn(docs.where("source = 'b'").withColumn("text", noisy)).orderBy("key").limit(50).collect()]
    assert 0.6 < sum(i % 2 == 0 for i in first) / len(first) < 0.9


def test_mix_repeats_whole_rows(spark):
    docs = odd_docs(spark)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    rows = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in rows for r in mixed.collect())


def test_odd_weights_lose_nothing(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a") for i in range(120)], "doc_id long, text string, source string")
    odd = F.expr("CASE doc_id % 6 WHEN 0 THEN null WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN double('NaN') WHEN 4 THEN double('inf') ELSE 1 END")
    assert sorted((r.doc_id, r.taken) for r in M.taken(docs, weight=odd).collect()) == [(i, 10) for i in range(120)]
    order = [r.doc_id % 6 for r in M.drawn(docs, 0, odd).orderBy("key").collect()]
    assert set(order[:40]) == {3, 4} and set(order[40:60]) == {5}


def test_buckets_stay_small_whatever_the_weights(spark):
    docs = spark.range(200_000).selectExpr("id AS doc_id", "if(id % 2 = 0, '', 'plain words') AS text", "'a' AS source")
    n = max(32, math.ceil(200_000 / (math.e * M.BUCKET_ROWS)))
    key = -F.log((F.pmod(F.xxhash64(F.lit(0), M.row_keys(docs)[0]), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / M.quality(F.col("text"))
    most = docs.groupBy(F.floor(F.log(key) * n)).count().agg(F.max("count")).first()[0]
    assert most < 200_000 / (math.e * n) * 1.2


def test_quality_is_learned_from_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = M.fit_quality(docs, labels)
    assert model == M.fit_quality(docs.repartition(3), labels.repartition(2))
    rows = docs.join(labels, "doc_id").select("quality", M.F.col("text").alias("t"), model.weight(F.col("text")).alias("w")).collect()
    good, bad = ([r.w for r in rows if r.quality == q] for q in (1, 0))
    # A text is drawn by what the labels say: a good one outweighs a bad one far more often than not.
    assert sum(g > b for g in good for b in bad) + 0.5 * sum(g == b for g in good for b in bad) > 0.7 * len(good) * len(bad)
    for r in rows[:50]:
        noise = sum(c in M.NOISE for c in r.t) / max(1, len(r.t))
        z = model.bias + model.noise * noise + model.noise2 * noise**2 + model.length * math.log1p(len(r.t))
        assert r.w == pytest.approx(max(0.05, 1 / (1 + math.exp(-z))))
    one = labels.where("quality = 1")
    assert M.fit_quality(docs, one) is None and M.fit_quality(docs, labels.limit(0)) is None and M.fit_quality(no_docs(spark), labels) is None
    assert M.taken(docs, weight=M.learned_weight(docs, one)).count() == docs.count()
    odd = odd_docs(spark)
    some = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (None, 1), (9, 1), (8, 3)], "doc_id long, quality int")
    assert M.taken(odd, weight=M.learned_weight(odd, some)).count() == odd.count()
