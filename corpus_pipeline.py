"""A corpus pipeline of five stages, each on the documents that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and reread as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language, mixing, nearcopies, sharding
from tessera.llm.common import table, written

#: Learned predictions, fingerprints and draws have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned stay, those that mix languages too; see keep_identified for nulls and empty texts."""
    return language.keep_identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group with five-word Jaccard similarity of 0.8 or more stays; all null and empty texts are one group."""
    return nearcopies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages stay, null and empty texts too."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them, good ones by the labels first."""
    return mixing.mix(docs, weight=mixing.learned_weight(docs, table(spark, sf_dir, "labels")))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and slot; nulls and repeated rows have theirs."""
    return sharding.assign(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
