"""Fixed cases: normalisation, query outcomes, stores, merges, sketches."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.bitmap import to_bitmaps, to_ids
from tessera.functions.bloom import Bloom, dimensions
from tessera.operators import postings as P
from tessera.operators import versioned as kv
from tessera.plans.query import QueryError, parse
from tessera.plans.search import search
from tessera.schema import MAX_DOC_ID, UNION, StoreOptions
from tessera.sources.index import Index
from tessera.sources import store
from tessera.sources.store import CommitConflict, Store
from tests.sentences import QUERIES, found, sentences

# Words, their language and what normalisation makes of them.
NORMAL = [
    ("running", "en", "run"), ("ran", "en", "ran"), ("the", "en", ""), ("dogs", "en", "dog"), ("бежать", "ru", "бежа"), ("бег", "ru", "бег"),
    ("и", "ru", ""), ("лиса", "ru", "лис"), ("собака", "ru", "собак"), ("", "en", ""), ("123", "en", "123"), ("!@#", "en", ""),
    ("running", "fr", "running"), ("the", "fr", "the"), ("fox,", "en", "fox"), ("İΣ", "fr", "iσ"),
]
# Published Porter2 stems.
STEMS = {
    "caresses": "caress", "flies": "fli", "dies": "die", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop",
    "hoping": "hope", "falling": "fall", "happy": "happi", "sky": "sky", "relational": "relat", "generously": "generous", "communism": "communism",
    "adjustment": "adjust", "electrical": "electr", "hopefulness": "hope", "skies": "sky", "consign": "consign", "consistency": "consist", "knightly": "knight",
}


@pytest.mark.parametrize("word,lang,want", NORMAL)
def test_normalize(word, lang, want):
    assert text.normalize_word(word, lang) == want


@pytest.mark.parametrize("word", STEMS)
def test_porter2(word):
    assert text.normalize_word(word, "en") == STEMS[word]


def test_tokenize(spark):
    df = spark.createDataFrame([("Hello, world! This is a test.",), ("don't a_b foo-bar 12½",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(text.tokenize(F.col("t"))).collect()]
    assert got == [["Hello", "world", "This", "is", "a", "test"], ["don", "t", "a", "b", "foo", "bar", "12½"], [], []]


def test_detect_language(spark):
    df = spark.createDataFrame([("123 привет hi",), ("hi привет",), ("",)], "t string")
    assert [r[0] for r in df.select(text.detect_language(F.col("t"))).collect()] == ["ru", "en", "en"]


# Queries over the four sentences and the ids they find.
OUTCOMES = {
    "quick": [1, 2, 4], "quick AND fox": [1, 2, 4], "quick OR lazy": [1, 2, 3, 4], "quick AND NOT dog": [4], "fox AND dog": [1, 2], "the": [],
    "NOT the": [1, 2, 3, 4], "quick AND the": [], "quick OR the": [1, 2, 4], "quick and not dog": [4], "NOT (NOT quick)": [1, 2, 4],
    "lazy OR quick AND NOT dog": [1, 3, 4], "(lazy OR quick) AND NOT dog": [4], "NOT lazy AND dog": [2], "NOT quick OR lazy": [1, 3],
    "quick OR NOT dog AND lazy": [1, 2, 4], "quick AND NOT (dog OR lazy)": [4], "()quick": [1, 2, 4], "quick AND NOT NOT dog": [],
    "quick dog AND": [1, 2], "AND quick dog": [1, 2], "quick NOT": [3], "foo-bar": [],
}
# Queries that fail, and their messages.
ERRORS = {
    "": "invalid query evaluation", "quick AND": "AND requires two operands", "(quick fox": "mismatched parentheses", "quick)": "mismatched parentheses",
    "quick fox": "invalid query evaluation", "quick NOT dog": "invalid query evaluation", "()": "invalid query evaluation", "NOT": "NOT requires one operand",
    "NOT AND quick dog": "NOT requires one operand", "NOT NOT quick": "NOT requires one operand",
}


@pytest.fixture(scope="module")
def english(spark):
    docs = sentences(spark, "en")
    return P.postings(docs, "en").cache(), docs.cache()


@pytest.mark.parametrize("query", OUTCOMES)
def test_outcomes(english, query):
    assert [r[0] for r in search(*english, query).collect()] == OUTCOMES[query]


@pytest.mark.parametrize("query", ERRORS)
def test_errors(english, query):
    with pytest.raises(QueryError, match=ERRORS[query]):
        search(*english, query)


@pytest.mark.parametrize("backend", ["sets", "bitmaps"])
@pytest.mark.parametrize("query", ["quick AND NOT dog", "NOT lazy AND dog", "NOT (quick AND dog) OR fox", "the", "NOT the"])
def test_backends_agree(english, query, backend):
    want = [r[0] for r in search(*english, query).collect()]
    assert [r[0] for r in search(*english, query, backend=backend).collect()] == want


def test_strict(english):
    assert [r[0] for r in search(*english, "NOT NOT quick", strict=True).collect()] == [1, 2, 4]
    assert [r[0] for r in search(*english, "quick AND NOT NOT dog", strict=True).collect()] == [1, 2]
    for bad in ("quick dog AND", "quick NOT", "()", "quick fox", "NOT", ")"):
        with pytest.raises(QueryError):
            parse(bad, strict=True)


@pytest.mark.parametrize("lang", ["en", "ru"])
def test_stemmed_suites(spark, lang):
    for q, ids in QUERIES[lang].items():
        assert found(spark, lang, q) == ids, q


def kv_rows(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, seq long, tombstone boolean").withColumn("value", F.col("value").cast("binary"))


def shown(df):
    return {r.key: bytes(r.value).decode() if r.value is not None else None for r in df.collect()}


def test_merge_latest(spark):
    one = kv.put(kv_rows(spark, [("a", "1", 1, False), ("b", "2", 2, False), ("c", "3", 3, False)]))
    two = kv.put(kv_rows(spark, [("b", "20", 5, False), ("d", "4", 6, False), ("c", None, 7, True)]), run_id=1)
    assert shown(kv.merge_latest(one, two)) == {"a": "1", "b": "20", "d": "4"}
    assert shown(kv.range_scan(one.union(two), "b", "c")) == {"b": "20"}
    assert shown(kv.range_scan(one.union(two), "c", "b")) == {}


def test_all_values(spark):
    rows = kv_rows(spark, [("a", "1", 1, False), ("a", "", 2, False), ("a", None, 3, True), ("a", "4", 4, False)])
    v = kv.put(rows).withColumn("run_id", F.col("seq"))
    assert [bytes(b) for b in kv.all_values(v, "a").first().chunks] == [b"4", b"1"]


@pytest.mark.parametrize("flush,most", [(1, 2), (2, 4), (1000, 4)])
def test_store(spark, tmp_path, flush, most):
    path = f"file://{tmp_path}/kv"
    s = Store(spark, path, StoreOptions(flush_keys=flush, max_runs=most))
    s.write(kv_rows(spark, [("a", "1", 1, False), ("b", "2", 2, False)]))
    s.delete(spark.createDataFrame([("a", 3)], "key string, seq long"))
    s.write(kv_rows(spark, [("c", "3", 4, False)]))
    assert shown(s.latest()) == {"b": "2", "c": "3"}
    s.close()
    s = Store(spark, path, StoreOptions(flush_keys=flush, max_runs=most))  # seq restarts, the later opening wins
    s.write(kv_rows(spark, [("b", "9", 1, False)]))
    assert shown(s.get("b")) == {"b": "9"} and shown(s.range("b", "b")) == {"b": "9"}
    s.close()
    s.compact()
    assert shown(s.latest()) == {"b": "9", "c": "3"} and len(s.state["runs"]) == 1
    s.delete(spark.createDataFrame([("b", 5), ("c", 6)], "key string, seq long"))
    s.close()
    s.compact()
    assert shown(s.latest()) == {} and shown(Store(spark, path).latest()) == {}


def test_store_refuses(spark, tmp_path):
    path = f"file://{tmp_path}/kv"
    a = Store(spark, path, StoreOptions())
    with pytest.raises(Exception, match="empty key"):
        a.write(kv_rows(spark, [("", "1", 1, False)]))
    b = Store(spark, path)
    b.write(kv_rows(spark, [("k", "winner", 1, False)]))
    b.flush()
    a.write(kv_rows(spark, [("k", "stale", 1, False)]))
    with pytest.raises(CommitConflict):
        a.flush()
    # The loser has touched nothing: the winner's rows are there, its own run is gone.
    assert shown(Store(spark, path).latest()) == {"k": "winner"}
    assert b.files.names("runs") == b.state["runs"] and len(b.file_names()) == len(set(b.file_names())) > 0


def test_readers_disturb_nobody(spark, tmp_path):
    path = f"file://{tmp_path}/kv"
    a = Store(spark, path, StoreOptions(max_runs=2))
    a.write(kv_rows(spark, [("a", "1", 1, False)]))
    a.flush()
    reader = Store(spark, path)
    held = reader.latest()
    for i in range(4):
        a.write(kv_rows(spark, [("a", str(i), i, False), (f"b{i}", "x", i, False)]))
        a.flush()
    a.compact()
    # Runs that were merged away are still there for a reader that is under way.
    assert shown(held) == {"a": "1"} and shown(Store(spark, path).get("a")) == {"a": "3"}
    for i in range(store.KEPT + 2):
        a.write(kv_rows(spark, [("a", "z", 10 + i, False)]))
        a.flush()
    assert len(a.files.names("manifest")) == len([n for n in a.files.names("manifest") if n.endswith(".json")]) == store.KEPT
    assert set(a.files.names("runs")) >= set(a.state["runs"]) and shown(Store(spark, path).get("a")) == {"a": "z"}


def test_a_broken_manifest_is_passed_over(spark, tmp_path):
    path = f"file://{tmp_path}/kv"
    a = Store(spark, path)
    a.write(kv_rows(spark, [("a", "1", 1, False)]))
    a.flush()
    a.files.create("manifest/000000000002.json", '{"number"')
    b = Store(spark, path)
    assert shown(b.latest()) == {"a": "1"}
    b.write(kv_rows(spark, [("a", "2", 1, False)]))
    b.flush()
    assert b.state["number"] == 3 and shown(Store(spark, path).latest()) == {"a": "2"}


def test_tiers_keep_tombstones_until_nothing_is_older(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/kv", StoreOptions(flush_keys=1, max_runs=2))
    s.write(kv_rows(spark, [(f"k{i:03d}", "old", i, False) for i in range(200)]))
    s.delete(spark.createDataFrame([("k000", 300)], "key string, seq long"))
    s.write(kv_rows(spark, [("k001", "new", 301, False)]))
    assert len(s.state["runs"]) == 2 and sorted(s.state["rows"].values()) == [2, 200]
    got = shown(s.latest())
    assert "k000" not in got and got["k001"] == "new" and len(got) == 199
    s.compact()
    assert shown(s.latest()) == got and list(s.state["rows"].values()) == [199]


def test_pending_dump(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/kv")
    assert s.pending_dump().count() == 0
    s.write(kv_rows(spark, [("b", "1", 1, False), ("a", "2", 2, False), ("b", None, 3, True)]))
    assert [(r.key, r.tombstone, r.seq) for r in s.pending_dump().collect()] == [("a", False, 2), ("b", True, 3)]


def test_a_thousand_documents_before_and_after_reopening(spark, tmp_path):
    """Terms drawn from 50 words, 1 to 5 a document, small runs, checked against a dictionary."""
    rng, path = random.Random(7), f"file://{tmp_path}/ix"
    docs = [(i, " ".join(rng.choices([f"term{j}" for j in range(50)], k=rng.randint(1, 5)))) for i in range(1000)]
    ix = Index(spark, path, "en", StoreOptions(flush_keys=5, max_runs=3))
    for a in range(0, 1000, 250):
        ix.add(spark.createDataFrame(docs[a : a + 250], "doc_id long, text string"))
    ix.flush()
    has = {f"term{j}": {i for i, t in docs if f"term{j}" in t.split()} for j in range(50)}
    cases = {"term1": has["term1"], "term2 AND term3": has["term2"] & has["term3"], "term4 OR term5": has["term4"] | has["term5"], "NOT term6": set(range(1000)) - has["term6"]}
    for opened in (ix, Index(spark, path)):
        for q, want in cases.items():
            assert [r[0] for r in opened.search(q).collect()] == sorted(want), q


def test_stemmer_fallback(monkeypatch):
    from tessera.functions import stem

    def broken(word):
        raise IndexError(word)

    monkeypatch.setitem(stem.STEMMERS, "en", broken)
    assert stem.stemmed("running", "en") == "running"


def test_index(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    ix = Index(spark, path, "en", StoreOptions(flush_keys=1, max_runs=1))
    docs = [(1, "alpha beta"), (2, "alpha"), (3, "beta"), (0, "the"), (MAX_DOC_ID, "gamma")]
    for d in docs:
        ix.add(spark.createDataFrame([d], "doc_id long, text string"))
    ix.add(spark.createDataFrame([(2, "delta")], "doc_id long, text string"))
    ids = lambda q: [r[0] for r in Index(spark, path).search(q).collect()]
    assert ids("alpha AND NOT beta") == [2] and ids("delta AND alpha") == [2]
    assert ids("NOT alpha") == [0, 3, MAX_DOC_ID] and ids("zebra") == []
    assert len(ix.store.state["runs"]) == 1


def test_index_ids_checked(spark, tmp_path):
    ix = Index(spark, f"file://{tmp_path}/ix", "en")
    with pytest.raises(Exception, match="4294967295"):
        ix.add(spark.createDataFrame([(MAX_DOC_ID + 1, "x")], "doc_id long, text string"))
        ix.flush()


def test_index_mode_is_union_and_stream(spark, tmp_path):
    from tessera.streaming.ingest import into_index

    spark.createDataFrame([(1, "Foxes run"), (2, "dog")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    ix = Index(spark, f"file://{tmp_path}/ix", "en")
    assert ix.store.options.mode == UNION
    for _ in range(2):
        q = into_index(spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in"), ix, f"{tmp_path}/cp")
        q.awaitTermination(120)
    assert [r[0] for r in ix.search("fox AND running").collect()] == [1]


def test_bitmaps(spark):
    ids = [0, 1, 32768, 32769, MAX_DOC_ID]
    rows = spark.createDataFrame([("t", i) for i in ids], "term string, doc_id long")
    assert sorted(r.doc_id for r in to_ids(to_bitmaps(rows)).collect()) == ids


def test_bloom():
    sizes = {(1, 0.01): (10, 7), (10, 0.01): (96, 7), (100, 0.01): (959, 7), (1000, 0.01): (9586, 7), (1024, 0.01): (9816, 7), (0, 5): (10, 7)}
    assert all(dimensions(*k) == v for k, v in sizes.items())
    b = Bloom(100)
    for w in ("hello", "world"):
        b.add(w)
    c = Bloom.from_bytes(b.to_bytes())
    assert c.might_contain("hello") and c.might_contain("world") and not c.might_contain("absent")
    with pytest.raises(ValueError):
        Bloom.from_bytes(b"x")
