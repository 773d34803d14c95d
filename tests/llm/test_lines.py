import random

import pytest

from tessera.llm import lines as L
from tests.llm.helpers import no_docs, odd_docs


def brute(docs, least):
    """Lines in a run of enough words that also occurs before, but for the first copy of its shortest beginning."""
    seqs = [[(n, x) for n, x in enumerate((t or "").encode().split(b"\n")) if x.split()] for _, t in docs]
    gone = [set() for _ in docs]
    places = [(d, i) for d, s in enumerate(seqs) for i in range(len(s))]

    def common(d, i, e, j):
        n = 0
        while i + n < len(seqs[d]) and j + n < len(seqs[e]) and seqs[d][i + n][1] == seqs[e][j + n][1]:
            n += 1
        return n

    for p, (e, j) in enumerate(places):
        width = next((n for n in range(1, len(seqs[e]) - j + 1) if sum(len(x.split()) for _, x in seqs[e][j : j + n]) >= least), None)
        earlier = [(q, n) for q in places[:p] if width and (n := common(*q, e, j)) >= width]
        if earlier:
            (d, i), _ = earlier[0]
            stays = i + width if d == e else 0
            gone[e] |= {seqs[e][k][0] for k in range(j, j + max(n for _, n in earlier)) if k >= stays}
    return {docs[d][0]: sorted(g) for d, g in enumerate(gone) if g}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(12)]
    passage = [" ".join(f"p{i}{j}" for j in range(rng.randint(1, 12))) for i in range(15)]
    docs = []
    for i in range(30):
        body = [rng.choice(pool) if rng.random() < 0.5 else f"unique {i} {k}" for k in range(rng.randint(0, 12))]
        if rng.random() < 0.5:
            a = rng.randint(0, 10)
            body += passage[a : a + rng.randint(1, 10)]
        if rng.random() < 0.2:
            body += ["", "  "] + body
        docs.append((i, "\n".join(body)))
    docs.append((30, docs[3][1] + "\n" + docs[4][1]))
    for least in (1, 10, 25):
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        got = {r.doc_id: list(r.lines) for r in L.repeated_lines(frame, least).collect()}
        assert got == brute(docs, least), least


def test_texts_lose_later_copies(spark):
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(13)) for i in range(4))
    docs = spark.createDataFrame([(1, f"head\n{passage}\ntail"), (2, f"other\n{passage}"), (3, "other\nlines"), (None, passage)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(docs).collect()}
    assert got == {1: f"head\n{passage}\ntail", 2: "other", 3: "other\nlines", None: ""}


def test_odd_and_empty(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: len(r.lines) for r in L.repeated_lines(docs).collect()}
    # The 40 equal lines: a run of ten lines recurs from the second line on, overlapping itself; its first copy stays.
    assert got == {10: 30}
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert L.repeated_lines(no_docs(spark)).count() == 0 and L.dedup_lines(no_docs(spark)).count() == 0


def test_overlapping_repeats_keep_a_whole_copy(spark):
    one = "\n".join(["ten words that are in each and every equal line"] * 10)
    two = "\n".join(f"line {i % 3} of three that come again and again" for i in range(20))
    docs = [(1, one), (2, two), (3, "before\n" + one), (4, two + "\n" + two)]
    got = {r.doc_id: list(r.lines) for r in L.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs, 50)
    assert got[1] == [5, 6, 7, 8, 9] and got[3] == list(range(1, 11)) and got[4] == list(range(40))
    assert 50 <= 9 * (20 - len(got[2])) < 100


def test_walk_of_the_interval_tree():
    rng = random.Random(4)
    for _ in range(300):
        some = sorted({tuple(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 20))})
        place = rng.sample(range(100), len(some))
        want = {p: max([L.common_prefix(a, b) for b, q in zip(some, place) if q < p], default=0) for a, p in zip(some, place)}
        assert dict(L.longest_earlier((list(a), p, p) for a, p in zip(some, place))) == want


def test_sql_twin_against_brute_force():
    import duckdb

    rng = random.Random(9)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(5)]
    for least in (4, 12):
        docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in range(25)]
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
        got = {i: [int(x) for x in lines.split(",")] for i, _, lines in con.execute(L.repeated_lines_sql(least)).fetchall()}
        assert got == brute(docs, least)
