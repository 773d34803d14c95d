"""What physical plans must show: pushed-down keys, pruned columns, partial aggregation."""

from pyspark.sql import functions as F

from tessera import queries as base
from tessera.operators import versioned as kv
from tessera.schema import UNION, StoreOptions
from tessera.sources.store import Store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_key_filters_reach_the_scan(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/kv", StoreOptions())
    s.write(spark.createDataFrame([("a", b"1", 1), ("b", b"2", 2)], "key string, value binary, seq long"))
    s.close()
    assert "EqualTo(key,a)" in plan(s.get("a"))
    ranged = plan(s.range("a", "b"))
    assert "GreaterThanOrEqual(key,a)" in ranged and "LessThanOrEqual(key,b)" in ranged
    assert "partial_max_by" in ranged


def test_search_reads_only_its_words(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/terms", StoreOptions(mode=UNION))
    s.write(spark.createDataFrame([("a", 1), ("b", 2)], "term string, doc_id long"))
    s.flush()
    from tessera.plans.search import search

    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    found = search(s.runs(), docs, "a AND NOT b", "fr")
    text = plan(found)
    assert "In(term, [a,b])" in text and "Join" not in text  # the universe isn't needed
    assert "Join" in plan(search(s.runs(), docs, "NOT b", "fr"))
    assert [r[0] for r in found.collect()] == [1]


def test_columns_are_pruned(spark):
    text = plan(base.queries()["universe"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_no_python_outside_stemming_and_sketches(spark):
    for name, query in base.queries().items():
        if "stem" not in name and "sorted_file" not in name and name not in ("bloom_no_false_negative", "bitmap_or_merge"):
            assert not any(x in plan(query(spark, SF)) for x in ("ArrowEvalPython", "MapInPandas", "BatchEvalPython", "CartesianProduct")), name


def test_tombstones_are_filtered_after_the_newest_is_known(spark):
    rows = kv.put(spark.createDataFrame([("a", b"1", 1, False), ("a", None, 2, True)], "key string, value binary, seq long, tombstone boolean"))
    assert kv.latest(rows).count() == 0 and kv.newest(rows).where(F.col("tombstone")).count() == 1
