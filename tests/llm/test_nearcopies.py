"""Near-copies against all pairs, and the pipeline's stage against plain Python."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import nearcopies as N
from tests.llm.helpers import corpus, no_docs, odd_docs
from tests.llm.test_simhash import groups


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def kept(rows):
    sets = {r[0]: plain(r[1]) for r in rows}
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return set(groups(near, ids).values())


def test_stage_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert {r.doc_id for r in got} == kept([(r.doc_id, r.text) for r in docs.collect()]) and 177 not in {r.doc_id for r in got}


@pytest.mark.parametrize("shard_rows,sample_rows", [(4096, 10_000), (5, 1)])
def test_against_all_pairs(spark, shard_rows, sample_rows):
    rng, texts = corpus(3, 60, low=1, high=120)
    rng = random.Random(4)
    for base in texts[:12]:  # chains of copies with edits, around a passage that many share
        for _ in range(12):
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = f"new{rng.random()}"
            texts.append(base + texts[20][:8] * (rng.random() < 0.3))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in N.keep_one(docs, shard_rows=shard_rows, sample_rows=sample_rows).collect()} == kept(rows)


def test_odd_and_empty(spark):
    got = N.keep_one(odd_docs(spark))
    assert got.columns == odd_docs(spark).columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 2, 5, 6, 7, 9, 10]
    assert N.keep_one(no_docs(spark)).count() == 0


def test_pieces_cover_long_texts(monkeypatch):
    text = b"Some words of a text that goes on for a while and longer " * 3
    whole = N.shingles(text).tolist()
    monkeypatch.setattr("tessera.llm.simhash.PIECE", 7)
    assert N.shingles(text).tolist() == whole and len(whole) == len(plain(text.decode()))


def test_few_pairs_in_a_large_group(spark):
    """All shards of a group of near-copies report much the same links: far fewer than all pairs."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(400):
        text = list(base)
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key0, key1 = N.row_keys(docs)
    keyed = docs.select("doc_id", "text", key0.alias("key0"), key1.alias("key1"))
    common = N._common(keyed, 5, 1000)
    members = N.shards(N._sketches(keyed, 5, 0.8, common), 4096).withColumns({"lo": N.F.col("part"), "hi": N.F.col("part"), "root": N.F.lit(None).cast("long"), "place": N.F.lit(0)})
    pairs = N._pairs(members, N.RADIUS, N.LEAST).distinct().count()
    assert 399 <= pairs < 400 * 8
    assert [r.doc_id for r in N.keep_one(docs).collect()] == [0]


def test_a_family_just_below_the_limit_makes_few_pairs(spark, monkeypatch):
    """Hundreds of texts of one origin, each pair a little too different: they aren't compared pair by pair."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(9):
            text[rng.randrange(300)] = f"x{rng.random()}"
        rows.append((i, " ".join(text)))
    seen = []
    verified = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, sets, least: (seen.append(pairs.count()), verified(pairs, sets, least))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in N.keep_one(docs).collect()} == kept(rows)
    assert len(seen) == 2 and seen[0] < 300 * 8 and seen[1] < 300 * 10


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n in (0, 5, 150, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 3, dtype=np.uint64)]))
        x, y = (int.from_bytes(N.parities(s)) for s in (a, b))
        assert (x ^ y).bit_count() <= len(np.setxor1d(a, b))


def test_rows_that_surely_stay_are_not_shuffled(spark):
    """With tables too large to broadcast, texts leave their tasks only if they may be left out or are repeated."""
    from tessera.llm.common import keep_rows, written

    rng = random.Random(9)
    rows = [(i, rng.randbytes(1500).hex()) for i in range(600)]
    docs = written(spark.createDataFrame([*rows, rows[7], rows[8]], "doc_id long, text string").repartition(4))
    keys = written(docs.where("doc_id % 20 <> 7").select(*N.row_keys(docs)).distinct())
    context, before = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    at = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, keep_rows(docs, keys).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [r for r in rows if r[0] % 20 != 7]
    assert shuffled() - at < 0.2 * sum(len(t) for _, t in rows)


def test_marks_miss_no_number(spark):
    from tessera.llm.common import marked

    hashes = lambda n: spark.range(n).select("id", N.F.xxhash64("id").alias("k"))
    for n in (0, 1, 2000):
        got = {r.id: r.maybe for r in marked(hashes(20_000), "k", N.written(hashes(n).select("k"))).collect()}
        assert len(got) == 20_000 and all(got[i] for i in range(n)) and sum(got.values()) <= 1.1 * n + 600
