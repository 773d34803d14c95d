"""Boolean search plans over postings (term, doc_id) and a universe (doc_id).

The default plan reads the postings of the query's words once, gathers each document's matched words
(at most as many as the query has) in one shuffle and tests one predicate. The set and bitmap plans
are alternatives with the same answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.bitmap import intersect_bitmaps, to_bitmaps, to_ids, union_bitmaps
from tessera.functions.text import normalize_word
from tessera.plans.query import Node, matches_nothing, parse, predicate


def search(postings: DataFrame, docs: DataFrame, query: str, lang: str = "en", strict: bool = False, backend: str = "predicate") -> DataFrame:
    """Ids of the documents that fit the query, ascending."""
    node = parse(query, lambda w: normalize_word(w, lang), strict)
    return BACKENDS[backend](postings, docs, node).orderBy("doc_id")


def _by_predicate(postings: DataFrame, docs: DataFrame, node: Node) -> DataFrame:
    words = sorted(node.words())
    hits = postings.where(F.col("term").isin(words)).groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    if matches_nothing(node):
        # The universe is needed only if a document without any word can fit; NOT over a null needs the coalesce.
        hits = docs.select("doc_id").distinct().join(hits, "doc_id", "left")
        hits = hits.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return hits.where(predicate(node, F.col("terms"))).select("doc_id")


def _by_sets(postings: DataFrame, docs: DataFrame, node: Node) -> DataFrame:
    everything = docs.select("doc_id").distinct()
    leaf: Callable = lambda w: postings.where(F.col("term") == w).select("doc_id")
    return node.fold(
        leaf,
        {
            "NOT": lambda a: everything.join(a, "doc_id", "left_anti"),
            "AND": lambda a, b: a.intersect(b),
            "OR": lambda a, b: a.union(b).distinct(),
        },
    ).distinct()


def _by_bitmaps(postings: DataFrame, docs: DataFrame, node: Node) -> DataFrame:
    """AND and OR on bitmaps; a complement has no built-in function, so NOT goes by way of ids."""
    tagged = lambda bits, name: bits.select(F.lit(name).alias("term"), "bucket", "bits")
    everything = docs.select("doc_id").distinct()
    ids = lambda rows: rows.select(F.lit("").alias("term"), "doc_id")
    bits = node.fold(
        lambda w: tagged(to_bitmaps(postings.where(F.col("term") == w)), w),
        {
            "NOT": lambda a: to_bitmaps(ids(everything.join(to_ids(a).select("doc_id"), "doc_id", "left_anti"))),
            "AND": lambda a, b: tagged(intersect_bitmaps(tagged(a, "a").union(tagged(b, "b")), 2), ""),
            "OR": lambda a, b: tagged(union_bitmaps(a.unionByName(b)), ""),
        },
    )
    return to_ids(bits).select("doc_id").distinct()


BACKENDS = {"predicate": _by_predicate, "sets": _by_sets, "bitmaps": _by_bitmaps}
