"""A persistent text index with one language: postings and the ids of all documents under one manifest."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.postings import checked, postings, universe
from tessera.plans.search import search
from tessera.schema import UNION, StoreOptions
from tessera.sources.store import Files, Store

#: Term under which the store keeps all ids: no text has an empty term. One batch is thus one commit.
ALL = ""


class Index:
    def __init__(self, spark: SparkSession, path: str, lang: str | None = None, options: StoreOptions | None = None):
        chosen = options or StoreOptions()
        chosen = replace(chosen, mode=UNION, lang=lang or chosen.lang)
        # Without a language or options, an existing index keeps what its manifest says.
        stored = Files(spark, path).names("manifest") and not (lang or options)
        self.store = Store(spark, path, None if stored else chosen)
        self.lang = self.store.options.lang

    @property
    def terms(self) -> DataFrame:
        return self.store.runs().where(F.col("term") != ALL)

    @property
    def docs(self) -> DataFrame:
        return self.store.runs().where(F.col("term") == ALL).select("doc_id").distinct()

    def add(self, docs: DataFrame) -> None:
        """Index a batch (doc_id, text). Adding an id again adds to its terms; an id without terms is a document too."""
        docs = checked(docs)
        self.store.write(postings(docs, self.lang).unionByName(universe(docs).select(F.lit(ALL).alias("term"), "doc_id")))

    def flush(self) -> None:
        self.store.flush()

    def search(self, query: str, strict: bool = False, backend: str = "predicate") -> DataFrame:
        return search(self.terms, self.docs, query, self.lang, strict, backend)
