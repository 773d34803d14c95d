"""Building an inverted index: documents to (term, doc_id) rows and the universe of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stem import STEMMERS, stem_udf
from tessera.functions.text import surface_terms
from tessera.schema import MAX_DOC_ID


def checked(docs: DataFrame) -> DataFrame:
    """Documents whose ids are proven to fit 32 unsigned bits; others raise as they are read."""
    fits = F.col("doc_id").between(0, MAX_DOC_ID)
    return docs.withColumn("doc_id", F.when(fits, F.col("doc_id").cast("long")).otherwise(F.raise_error(F.lit("doc_id must be in 0..4294967295")).cast("long")))


def universe(docs: DataFrame) -> DataFrame:
    """Every document id, also of texts without terms."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def postings(docs: DataFrame, lang: str) -> DataFrame:
    """Distinct (term, doc_id) rows of documents (doc_id, text).

    Terms are distinct within a row before the explode; only a stemmed language needs the vocabulary
    join, and only distinct words reach Python.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(surface_terms(F.col("text"), lang)).alias("word"))
    if lang in STEMMERS:
        vocabulary = rows.select("word").distinct().withColumn("term", stem_udf(lang)("word"))
        rows = rows.join(vocabulary, "word")
    else:
        rows = rows.withColumnRenamed("word", "term")
    return rows.select("term", "doc_id").distinct()


def doc_freq(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("*").alias("df"))
