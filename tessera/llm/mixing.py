"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight; within a source, documents in
key order fill the source's word budget. Whole epochs come first: each document is taken as often as
the source fits into its target, and only the rest is a selection.

In key order a selection is all that lies before one cut. So the prefix sums are two-level: sums of key
buckets by source find the bucket that a budget ends in, and only the rows of that bucket are sorted to
find the document. What is taken of a document then follows from its own key and its source's cut:
texts are never shuffled. Buckets are even steps of the key's logarithm: a weight only shifts that, and
its density is 1 / e at most, so that no bucket is large whatever the weights are. Rows equal in every
column share a key; they count as one group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import numbered, row_keys, written

WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3
LEAST_WEIGHT, MOST_WEIGHT = 1e-6, 1e6  # of a document's draw
LEAST_QUALITY, LABELLED_ROWS = 0.05, 20_000
BUCKET_ROWS = 8192  # rows of a source's key bucket at most, about
WORDS = r"[^\x20\x09-\x0D]+"
# Characters that count against a text's quality.
NOISE = "!\"#$%&'()*+-/0123456789<=>?@[\\]^_`{|}~"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Share of characters that are no digits or symbols, 0.05 at least: the weight of a document's draw."""
    plain = F.length(F.translate(text, NOISE, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.coalesce(plain, F.lit(0.0)), F.lit(LEAST_QUALITY))


@dataclass(frozen=True)
class Quality:
    """A logistic model of a text's quality over the share of its characters that are digits or symbols, that squared, and the logarithm of its length."""

    bias: float
    noise: float
    noise2: float
    length: float

    def weight(self, text: Column) -> Column:
        """The model's chance that the text is good, 0.05 at least; null texts count as empty."""
        x, n = _features(text)
        z = self.bias + self.noise * x + self.noise2 * x * x + self.length * n
        return F.greatest(1 / (1 + F.exp(-z)), F.lit(LEAST_QUALITY))


def _features(text: Column) -> tuple[Column, Column]:
    n = F.length(F.coalesce(text, F.lit("")))
    plain = F.length(F.translate(F.coalesce(text, F.lit("")), NOISE, ""))
    return 1 - plain / F.greatest(n, F.lit(1)), F.log1p(n.cast("double"))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, ridge: float = 1.0) -> Quality | None:
    """The model that labels (doc_id, quality 0 or 1) of docs teach, from at most about `rows` of them picked by a hash of the id.

    None without labelled texts of both kinds; other labels, null ids and ids without a document teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("good")).where("of IS NOT NULL AND good IN (0, 1)")
    span = 1 << 30
    known = known.where(F.pmod(F.xxhash64("of"), F.lit(span)) < min(span, -(-span * rows // max(1, known.count()))))
    noise, length = _features(F.col("text"))
    # The sample's size is bounded, so it may go to all; the limit is for ids that many documents share.
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("of"))
    seen = met.select("good", noise.alias("noise"), length.alias("length")).orderBy(F.xxhash64("doc_id"), "noise", "length", "good").limit(2 * rows).toPandas()
    if seen["good"].nunique() < 2:
        return None
    x = np.column_stack([np.ones(len(seen)), seen["noise"], seen["noise"] ** 2, seen["length"]])
    y, w = seen["good"].to_numpy(float), np.zeros(4)
    penalty = ridge * np.diag([0.0, 1.0, 1.0, 1.0])
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(4), x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return Quality(*np.round(w, 9).tolist())


def learned_weight(docs: DataFrame, labels: DataFrame) -> Column:
    """The weight of a document's draw: what labels teach, else the plain share of `quality`."""
    model = fit_quality(docs, labels)
    return model.weight(F.col("text")) if model else quality(F.col("text"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to those and `target`: shares by weight of all words, none above `most` epochs.

    Sources in code point order, null last, take the weights in turn. One row a source: the windows over
    all sources sort as many rows as there are sources.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") - 1) % len(weights) + 1).cast("double")
    rows = ranked.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    rows = rows.withColumn("full_at", F.col("cap") / F.col("weight"))
    # Filling all sources at equal speed by weight, the ones that are full soonest come first.
    order = Window.orderBy("full_at", "at")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "at", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def drawn(docs: DataFrame, seed: int = 0, weight: Column | None = None, *more: Column) -> DataFrame:
    """One row a document: doc_id, source, size, row_key, row_key2, key, all from the row itself; then `more`.

    row_key and row_key2 sum up all columns. Weights are clipped to 1e-6 and 1e6; a null counts as the
    least, a NaN as the most.
    """
    row_key, row_key2 = row_keys(docs)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), row_key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    draw = F.coalesce((quality(F.col("text")) if weight is None else weight).cast("double"), F.lit(LEAST_WEIGHT))
    draw = F.least(F.greatest(draw, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        n_words(F.col("text")).alias("size"),
        row_key.alias("row_key"),
        row_key2.alias("row_key2"),
        (-F.log(uniform) / draw).alias("key"),
        *more,
    )


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row a source of `rows`, a table of what `drawn` gives: its size, target, whole epochs, and where the rest of its budget ends in key order.

    of, source_size, target, epochs, whole (whether the rest takes every document); cut: the key, row_key
    and row_key2 of the document that the budget ends in, null where there is none; left: the words that
    are left for it; cut_size: its own; copies: the rows equal to it, itself included; cut_doc: its doc_id.
    A table as long as there are sources.
    """
    # Buckets to one unit of the logarithm.
    n = max(32, math.ceil(rows.count() / (math.e * BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.floor(F.log("key") * n))
    sums = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    by_source = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    by_source = by_source.withColumnRenamed("source", "of").withColumn("epochs", epochs)
    by_source = by_source.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.withColumn("upto", F.sum("words").over(upto))
    here = running.join(by_source.select("of", "rest"), F.col("source").eqNullSafe(F.col("of"))).where("rest > 0 AND upto > rest")
    first = F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "rest"), "bucket").alias("b")
    here = here.groupBy("of").agg(first).select("of", F.col("b.bucket").alias("in_bucket"), F.col("b.before").alias("before"), F.col("b.rest").alias("rest"))
    # Written: the few rows of these buckets are then found by a join whose side has a known size.
    here = written(here.coalesce(1))
    near = rows.join(here, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in_bucket")))
    groups = near.groupBy("of", "key", "row_key", "row_key2", "doc_id", "size", "before", "rest").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("of").orderBy("key", "row_key", "row_key2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("copies")).over(order)).where("upto > rest")
    left = (F.col("rest") - F.col("upto") + F.col("size") * F.col("copies")).alias("left")
    ends = F.min_by(F.struct(F.struct("key", "row_key", "row_key2").alias("cut"), left, F.col("size").alias("cut_size"), "copies", F.col("doc_id").alias("cut_doc")), F.struct("key", "row_key", "row_key2"))
    ends = groups.groupBy("of").agg(ends.alias("e")).select(F.col("of").alias("ends_of"), "e.*")
    out = by_source.join(ends, F.col("of").eqNullSafe(F.col("ends_of")), "left")
    whole = F.col("cut").isNull() & (F.col("rest") > 0)
    return written(out.select("of", "source_size", "target", "epochs", whole.alias("whole"), "cut", "left", "cut_size", "copies", "cut_doc").coalesce(1))


def _placed(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows of `drawn` with their source's cut; `before`: whether they lie before it; `ends`: whether it is theirs."""
    rows = rows.join(cut, F.col("source").eqNullSafe(F.col("of")))
    place = F.struct("key", "row_key", "row_key2")
    return rows.withColumns({"before": F.col("whole") | F.coalesce(place < F.col("cut"), F.lit(False)), "ends": F.coalesce(place == F.col("cut"), F.lit(False))})


def taken(docs: DataFrame, seed: int = 0, weight: Column | None = None, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document.

    The document that the budget ends in gives just the words that are left, so that a source's words
    meet its target to the word; of equal rows there, the first ones give all. Null texts have size 0; null
    doc_ids and repeated rows take part like others; a source without words has target 0.
    """
    # Written: texts are read once, what a document weighs is a small row.
    slim = written(drawn(docs, seed, weight))
    cut = cuts(slim, **how)
    rows = _placed(slim, cut).where("NOT (ends AND copies > 1)")
    some = F.when(F.col("before"), F.col("size")).when(F.col("ends"), F.col("left")).otherwise(0)
    rows = rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + some).cast("long").alias("taken"))
    some = F.least(F.greatest(F.col("left") - F.col("i") * F.col("cut_size"), F.lit(0)), F.col("cut_size"))
    equal = numbered(cut.where("copies > 1"), "copies", "of").select(
        F.col("cut_doc").alias("doc_id"), F.col("cut_size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("cut_size") + some).cast("long").alias("taken")
    )
    return rows.unionAll(equal)


def mix(docs: DataFrame, seed: int = 0, weight: Column | None = None, **how) -> DataFrame:
    """The mix itself: whole documents, each as often as it is taken; the columns are those of `docs`.

    The document that the budget ends in is in if at least half of it fits; of rows equal to it, as many
    as fit so. Documents without words go by the place of their key. Other cases as in `taken`.
    """
    cut = cuts(written(drawn(docs, seed, weight)), **how)
    rows = _placed(drawn(docs, seed, weight, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), cut)
    alone = F.col("before") | (F.col("ends") & (F.col("copies") == 1) & (2 * F.col("left") >= F.col("cut_size")))
    often = F.col("epochs").cast("int") + F.when(alone, 1).otherwise(0)
    out = rows.select("row", often.alias("often")).where("often > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("often")))).select("row.*")
    fit = F.least(F.col("copies"), F.floor((2 * F.col("left") + F.col("cut_size")) / (2 * F.col("cut_size"))).cast("long"))
    equal = rows.where("ends AND copies > 1").groupBy("of").agg(F.any_value("row").alias("row"), F.any_value(fit).alias("fit"))
    return out.unionAll(numbered(equal, "fit", "of").select("row.*"))
