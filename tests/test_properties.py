"""Seeded random cases: stores against a dictionary, queries against sets, whatever the layout."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import postings as P
from tessera.operators import versioned as kv
from tessera.plans.query import Node, parse, to_postfix
from tessera.plans.search import search
from tessera.schema import StoreOptions
from tessera.sources.store import Store


@pytest.mark.parametrize("seed", [1, 2])
def test_random_traces(spark, tmp_path, seed):
    rng = random.Random(seed)
    path, model, seq = f"file://{tmp_path}/kv", {}, 0
    options = StoreOptions(flush_keys=rng.choice([1, 4, 1000]), max_runs=rng.choice([1, 3]))
    store = Store(spark, path, options)
    for _ in range(6):
        rows = []
        for _ in range(rng.randint(1, 8)):
            seq += 1
            key, dead = f"k{rng.randint(0, 9)}", rng.random() < 0.3
            rows.append((key, None if dead else f"v{seq}".encode(), seq, dead))
            model.pop(key, None) if dead else model.__setitem__(key, f"v{seq}")
        store.write(spark.createDataFrame(rows, "key string, value binary, seq long, tombstone boolean"))
        if rng.random() < 0.4:
            store.close()
            store, seq = Store(spark, path, options), 0
    a, b = sorted((f"k{rng.randint(0, 9)}", f"k{rng.randint(0, 9)}"))
    assert {r.key: bytes(r.value).decode() for r in store.latest().collect()} == model
    assert [r.key for r in store.range(a, b).collect()] == sorted(k for k in model if a <= k <= b)


def test_window_form_agrees(spark):
    rows = spark.range(400).selectExpr("cast(id % 37 as string) AS key", "cast(id as string) AS value", "(id * 7919) % 401 AS seq", "id % 5 = 0 AS tombstone")
    v = kv.put(rows.withColumn("value", F.col("value").cast("binary"))).withColumn("epoch", F.col("seq") % 3)
    v.createOrReplaceTempView("versions")
    want = spark.sql("SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY epoch DESC, seq DESC) AS n FROM versions) WHERE n = 1 AND NOT tombstone")
    assert sorted((r.key, bytes(r.value)) for r in kv.latest(v).collect()) == sorted((r.key, bytes(r.value)) for r in want.collect())


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return Node("", f"t{rng.randint(0, 7)}")
    op = rng.choice(["AND", "OR", "NOT"])
    return Node(op, args=tuple(tree(rng, depth - 1) for _ in range(1 if op == "NOT" else 2)))


def text(node):
    if not node.op:
        return node.word
    inner = [text(a) for a in node.args]
    return f"(NOT ({inner[0]}))" if node.op == "NOT" else f"({inner[0]} {node.op} {inner[1]})"


def test_random_queries(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.sample([f"t{j}" for j in range(8)], rng.randint(0, 5)))) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows, ids = P.postings(frame, "fr").cache(), {i for i, _ in docs}
    has = {f"t{j}": {i for i, t in docs if f"t{j}" in t.split()} for j in range(8)}
    for n in range(12):
        node = tree(rng, 4)
        want = node.fold(lambda w: has[w], {"NOT": lambda a: ids - a, "AND": lambda a, b: a & b, "OR": lambda a, b: a | b})
        assert parse(text(node)) == parse(text(node), strict=True) == node
        for backend in ("predicate", "sets") if n % 4 else ("predicate", "bitmaps"):
            assert [r[0] for r in search(rows, frame, text(node), "fr", backend=backend).collect()] == sorted(want), text(node)


def test_precedence():
    order = lambda q: [t.strip("\0") for t in to_postfix(["\0" + w if w in ("AND", "OR", "NOT", "(", ")") else w for w in q.split()])]
    assert order("a OR b AND NOT c") == ["a", "b", "c", "NOT", "AND", "OR"]
    assert order("( a OR b ) AND c") == ["a", "b", "OR", "c", "AND"]
