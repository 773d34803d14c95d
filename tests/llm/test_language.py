import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language as L
from tests.llm.helpers import no_docs, odd_docs

SF = "/root/testdata/sf0.01"


def best_path(scores, penalty):
    """Plain Viterbi."""
    k = scores.shape[1]
    best, back = scores[0].astype(np.float64), []
    for row in scores[1:]:
        top = int(best.argmax())
        came = [j if best[j] >= best[top] - penalty else top for j in range(k)]
        back.append(came)
        best = np.array([max(best[j], best[top] - penalty) for j in range(k)]) + row
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def test_viterbi_against_plain():
    rng = np.random.default_rng(1)
    lengths = np.array([5, 1, 30, 0, 12, 30])
    scores = (rng.integers(-20, 1, (lengths.sum(), 3)) * 1.0).astype(np.float32)
    got, at = L.viterbi(scores, lengths, 9.0), 0
    for n in lengths:
        if n:
            part = scores[at : at + n]
            want = best_path(part, 9.0)
            value = lambda p: sum(part[i, j] for i, j in enumerate(p)) - 9.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            assert value(got[at : at + n].tolist()) == value(want)
        at += n


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(docs, L.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]]
    assert len(got) == docs.count() and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_learns_only_from_the_named_rows(spark):
    rows = [(i, "abc " * 5 if zlib.crc32(str(i).encode()) % 3 == 1 else "xyz " * 5, "one" if zlib.crc32(str(i).encode()) % 3 == 1 else "two") for i in range(60)]
    assert L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ("two",)


def test_scripts_narrow_and_spans(spark):
    rows = [(i, t, g) for i in range(40) for t, g in [("съешь ещё этих мягких французских булок", "ru"), ("the quick brown fox jumps over", "en")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    mixed = spark.createDataFrame([(1, "quick brown fox! Мягких булок этих, the fox over"), (2, "日本"), (3, "²³")], "doc_id long, text string")
    text = mixed.first().text
    assert [(r.lang, text[r.start : r.end]) for r in L.spans(mixed.where("doc_id = 1"), model).orderBy("start").collect()] == [
        ("en", "quick brown fox"), ("ru", "Мягких булок этих"), ("en", "the fox over")
    ]
    got = {r.doc_id: r.lang_pred for r in L.identify(mixed, model).collect()}
    assert got[1] == "en" and got[2] in model.langs and got[3] == "und"


def test_odd_and_empty(spark):
    docs = odd_docs(spark)
    model = L.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (2, 3, 4, 7)) and got[9][0] in model.langs
    assert L.identify(docs, model).count() == docs.count()
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({2, 3, 4, 7})
    none = L.fit(no_docs(spark))
    assert none.langs == () and L.identify(no_docs(spark), none).count() == 0
    assert {r.lang_pred for r in L.identify(docs.limit(3), none).collect()} == {"und"}


def test_pieces_cover_long_texts(monkeypatch):
    text = "Alpha beta  gamma\n" * 50
    whole = [w for p in L.words_of(text) for w in p]
    monkeypatch.setattr(L, "PIECE", 7)
    assert [w for p in L.words_of(text) for w in p] == whole


def test_paths_in_pieces_are_those_of_the_whole():
    rng = np.random.default_rng(3)
    for n, spread in ((1, 5), (40, 3), (200, 12), (300, 30)):
        scores = (rng.integers(-spread, 1, (n, 4)) * 1.0).astype(np.float32)
        want = L.viterbi(scores, np.array([n]), 9.0).tolist()
        path, got = L.Path(9.0), []
        for part in np.array_split(scores, rng.integers(1, 12)):
            got += path.add(part).tolist()
        assert got == want[: len(got)]
        assert got + path.add(scores[:0], last=True).tolist() == want


def test_predictions_and_scores_against_plain_python(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").select("doc_id", "text")
    model = L.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    texts[-1], texts[-2] = "".join(texts[i][:400] + " 这是中文 " for i in range(40)), "İstanbul ΟΔΟΣ " * 30
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    scorer, want = L.Scorer(model), {}
    for i, text in texts.items():
        words = [m[0].lower() for m in L.WORD.finditer(text)]
        ids = scorer(words)
        letters, known = scorer.letters[ids], scorer.known[ids]
        votes = np.zeros(len(model.langs))
        for label, n, k in zip(best_path(scorer.scores[ids], L.PENALTY) if words else [], letters, known):
            votes[label] += n * k
        best = max(range(len(votes)), key=lambda j: (votes[j], scorer.scores[ids][:, j].sum(), -j)) if letters.sum() else -1
        want[i] = (model.langs[best], votes[best] / letters.sum()) if best >= 0 else ("und", 0.0)
    # Predicted here, as workers don't see another size of pieces.
    judged = lambda: {i: (p, round(s, 9)) for i, p, s in zip(texts, *L._judged(pa.array(texts.values()), L.Scorer(model), L.PENALTY)[:2])}
    whole = judged()
    assert {i: (model.langs[p] if p >= 0 else "und", s) for i, (p, s) in whole.items()} == {i: (p, round(float(s), 9)) for i, (p, s) in want.items()}
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.identify(frame, model).collect()} == {i: (p, round(float(s), 9)) for i, (p, s) in want.items()}
    monkeypatch.setattr(L, "PIECE", 300)
    assert judged() == whole
    # Spans are the same paths.
    letters = {}
    for r in L.spans(frame, model).collect():
        letters.setdefault(r.doc_id, {}).setdefault(r.lang, []).append(texts[r.doc_id][r.start : r.end])
    for i in (*range(20), -1):
        by = {g: sum(sum(map(str.isalpha, w)) for t in parts for w in L.WORD.findall(t) if L.script(w.lower()) != L.SCRIPTS.index("Han")) for g, parts in letters.get(i, {}).items()}
        assert not by or by[want[i][0]] / sum(sum(map(str.isalpha, w)) for w in L.WORD.findall(texts[i])) == pytest.approx(want[i][1])


def test_every_language_is_learned(spark):
    rng = random.Random(2)
    made = {f"l{n:03d}": ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(8)] for n in range(90)}
    rows = [(i, " ".join(rng.choices(words, k=20)), g) for i, (g, words) in enumerate(x for x in made.items() for _ in range(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert set(model.langs) == set(made) and model.logp.shape == (L.buckets_for(90), 90) and L.buckets_for(90) < L.MOST_BUCKETS == L.buckets_for(64)
    got = L.identify(docs, model).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got) >= 0.98 * len(rows)
    assert L.spans(odd_docs(spark), model).count() > 0 and L.spans(no_docs(spark), model).count() == 0
    assert L.keep_identified(docs, L.fit(no_docs(spark))).count() == 0


def test_held_out_column(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).withColumn("l", L.is_learned(F.col("doc_id"))).collect()
    assert all(r.l == (zlib.crc32(str(r.doc_id).encode()) % 3 != 1) for r in rows)


FOREIGN = [
    "这是一篇完全用中文写的文章，没有任何模型学过的语言", "Это русский текст без единой латинской буквы", "Ez egy magyar szöveg, amelyet a modell soha nem látott és nem tanult meg",
    "Tämä on suomenkielinen teksti, jota malli ei ole koskaan nähnyt eikä oppinut", "Zażółć gęślą jaźń i wszystkie inne polskie litery w tym zdaniu",
    "Questo testo italiano non è mai stato visto dal modello e dovrebbe essere respinto",
]


def test_unlearned_languages_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = L.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    strange = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(FOREIGN)], "doc_id long, text string")
    assert L.keep_identified(strange, model).count() == 0
    score = {r.doc_id: r.score for r in L.identify(strange, model).collect()}
    assert score[-1] == score[-2] == 0
    kept = {r.doc_id for r in L.keep_identified(docs, model).collect()}
    assert len(kept) >= 0.999 * docs.count()
    mixed = docs.where("length(text) > 200").limit(1).select("doc_id", F.concat(F.substring("text", 1, 200), F.lit(" 这是中文" * 20)).alias("text"))
    assert L.keep_identified(mixed, model).count() == 1 and L.identify(mixed, model).first().score < 0.75
