import numpy as np

from tessera.llm import decontaminate as D
from tests.llm.helpers import corpus, no_docs, odd_docs


def distance(item, text, most):
    """Least edits of the item to any run of the text's words."""
    row = np.zeros(len(text) + 1, int)
    text = np.array(text + [""])[:-1]
    for i, x in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[:-1] + (text != x), row[1:] + 1)))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def brute(docs, items):
    out = {}
    for d, t in docs:
        words = D.words_of(t or "")
        for i, x in items:
            item = D.words_of(x or "")
            if item and (n := distance(item, words, 0)) <= D.edits(len(item), 0.8):
                out[d, i] = n
    return out


def edit(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(at, "zzz"), lambda: words.insert(at, "yyy"), lambda: words.pop(at)])()  # noqa: B023
    return words


def test_finds_all_edited_passages(spark):
    rng, items = corpus(4, 60, low=3, high=50)
    docs = []
    for i in range(300):
        item = rng.choice(items)
        body = [w for _ in range(rng.randint(0, 3)) for w in rng.choice(items)[:2]]
        hit = edit(rng, item, rng.randint(0, len(item) // 4)) if rng.random() < 0.7 else []
        docs.append((i, " ".join([*body, *hit, *body[::-1]]).title()))
    bench = [(i, " ".join(x)) for i, x in enumerate(items)]
    want = brute(docs, bench)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert set(got) <= set(want) and len(got) >= 0.999 * len(want)
    assert all(want[k] == n for k, n in got.items())


def test_whole_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} == set(want)
    kept = {r.doc_id for r in D.keep_clean(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_pieces_and_blocks(spark, monkeypatch):
    rng, items = corpus(6, 9, low=12, high=30)
    text = " ".join(w for x in items for w in ["filler"] * 40 + x)
    found = D.Items([(i, " ".join(x)) for i, x in enumerate(items)], 0.8, D.RECALL)
    whole = list(found.find(text))
    assert [i for i, _, _ in whole] == list(range(9))
    assert all(D.words_of(text)[end - len(items[i]) : end] == items[i] for i, _, end in whole)
    monkeypatch.setattr(D, "PIECE", 300)
    assert list(found.find(text)) == whole
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (2, "clean words")], "doc_id long, text string")
    assert sorted(r.item_id for r in D.contaminated(docs, b).collect()) == list(range(9))
    assert [r.doc_id for r in D.keep_clean(docs, b).collect()] == [2]


def test_odd_and_empty(spark):
    docs = odd_docs(spark)
    items = [(1, "quick BROWN fox"), (1, "plage avec nous"), (2, None), (None, "a"), (3, ""), (4, "!!"), (5, "a")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, b).collect())
    assert got == [(1, 1), (1, 1), (5, 5), (8, 1), (9, 1)]
    kept = D.keep_clean(docs, b)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5
    for x, y in ((docs, b.limit(0)), (no_docs(spark), b)):
        assert D.contaminated(x, y).count() == 0 and D.keep_clean(x, y).count() == x.count()


def test_lsh_alone_reaches_the_recall():
    """Windows at every word, no runs looked up: passages at the very limit of edits, against brute force."""
    rng, items = corpus(11, 80, vocabulary=3000, low=5, high=60)
    bench = [(i, " ".join(x)) for i, x in enumerate(items)]
    found = D.Items(bench, 0.8, D.RECALL, everywhere=True)
    want, got = set(), set()
    for i, item in enumerate(items):
        hit = edit(rng, item, D.edits(len(item), 0.8))
        text = " ".join([*rng.choice(items)[:4], *hit, *rng.choice(items)[-4:]])
        want |= {(i, j) for _, j in brute([(i, text)], bench)}
        got |= {(i, j) for j, _, _ in found.find(text)}
    assert len(want) >= 75 and got <= want and len(got) >= 0.95 * len(want)


def test_unrelated_windows_rarely_collide():
    rng = np.random.default_rng(5)
    for n in (3, 8, 10, 20, 50):
        items = D.Items([(0, " ".join(f"w{i}" for i in range(n)))], 0.8, D.RECALL)
        windows = rng.integers(1, 2**63, (2000, n), dtype=np.uint64)
        assert len(items.candidates(n, windows)) < 20, n
        assert items.candidates(n, items.hash[np.array(items.coded)]) == {(0, 0)}


def test_walks_grow_with_the_recall():
    assert D.walks(50, 10, 0.9) <= D.walks(50, 10, 0.99) and D.walks(10, 0) == 16
