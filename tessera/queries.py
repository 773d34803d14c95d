"""The catalogue of registered queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bloom, text
from tessera.functions.bitmap import to_bitmaps, to_ids, union_bitmaps
from tessera.functions.stem import stem_udf
from tessera.operators import postings as index_ops
from tessera.operators import versioned as kv
from tessera.plans.search import search
from tessera.schema import StoreOptions
from tessera.sources import sorted_files
from tessera.sources.index import Index
from tessera.sources.scratch import scratch
from tessera.sources.store import Store

#: An index language without stop words or stemming, which SQL can check over all documents.
PLAIN = "fr"
SEARCHES = {
    "search_term": "de",
    "search_and": "de AND la",
    "search_or": "de OR la",
    "search_not": "NOT de",
    "search_and_not": "de AND NOT la",
    "search_nested": "(de AND NOT la) OR NOT un",
    "search_precedence": "un OR de AND NOT la",
    "search_case_insensitive_ops": "de and not la",
    "search_missing_term": "zzzzqq",
    "search_not_missing": "NOT zzzzqq",
}
SEARCH_SQL = {
    "search_term": "de",
    "search_and": "de AND la",
    "search_or": "de OR la",
    "search_not": "NOT de",
    "search_and_not": "de AND NOT la",
    "search_nested": "(de AND NOT la) OR NOT un",
    "search_precedence": "un OR (de AND NOT la)",
    "search_case_insensitive_ops": "de AND NOT la",
    "search_missing_term": "missing",
    "search_not_missing": "NOT missing",
}
TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}]+')"
P = f"""WITH p AS (SELECT doc_id, unnest(list_distinct(list_transform({TOKENS}, lambda w: lower(w)))) AS term
  FROM documents), d AS (SELECT DISTINCT doc_id FROM documents) """


def _terms_sql(**words: list[str]) -> str:
    """One row a document: whether it has one of the words, by name."""
    has = ", ".join(f"coalesce(bool_or(list_has_any(terms, {w!r})), false) AS {name}" for name, w in words.items())
    return f"WITH h AS (SELECT doc_id, {has} FROM (SELECT doc_id, list_transform({TOKENS}, lambda w: lower(w)) AS terms FROM documents) GROUP BY doc_id) "


H = _terms_sql(de=["de"], la=["la"], un=["un"], missing=["zzzzqq"])
EN_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS["en"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _search(query: str, backend: str = "predicate", lang: str = PLAIN):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _docs(spark, d)
        if lang == "en":  # stop words without stemming, which SQL can check
            rows = docs.select("doc_id", F.explode(text.surface_terms(F.col("text"), "en")).alias("term")).distinct()
        else:
            rows = index_ops.postings(docs, lang)
        return search(rows, docs, query, lang, backend=backend)

    return run


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Events as a history of versions: one key a user, errors as deletions."""
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("key"),
        F.col("value").cast("string").cast("binary").alias("value"),
        (F.col("event_type") == "error").alias("tombstone"),
        F.col("event_id").alias("seq"),
    )
    return kv.put(rows).withColumn("run_id", F.col("seq") % 4)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.col("value").cast("string").cast("double").alias("value"))


VERSIONS_SQL = """WITH v AS (SELECT CAST(user_id AS VARCHAR) AS key, value, event_type = 'error' AS tombstone, event_id AS seq,
  event_id % 4 AS run_id FROM events), top AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) """
LATEST_SQL = VERSIONS_SQL + "SELECT key, value FROM top WHERE NOT tombstone"
KEYS_A_FILTER = 1 << 16
PARTS = ("part-00000100", "part-00000120")
PART_KEYS = [f"part-{i:08d}" for i in (*range(1, 2000, 97), 0, 99999999)]
MULTI = [str(i) for i in range(0, 60, 3)]


def _all_values(spark: SparkSession, d: str) -> DataFrame:
    rows = kv.all_values(_versions(spark, d)).select("key", F.posexplode("chunks").alias("at", "value"))
    return _shown(rows.withColumn("key", F.concat("key", F.lit("/"), "at")))


def _compact_latest(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    runs = [kv.newest(v.where(F.col("run_id") == i)).withColumn("run_id", F.lit(i)) for i in range(4)]
    return _shown(kv.merge_latest(*runs))


def _compact_union(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    parts = [index_ops.postings(docs.where(F.col("doc_id") % 4 == i), PLAIN) for i in range(4)]
    return kv.merge_union(*parts)


def _bitmap_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return to_ids(union_bitmaps(to_bitmaps(index_ops.postings(_docs(spark, d), PLAIN)), "term"))


def _part_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.format_string("part-%08d", "p_partkey")
    return table(spark, d, "part").select(key.alias("key"), F.col("p_name").cast("binary").alias("value"), F.lit(False).alias("tombstone"), F.lit(1).alias("seq"))


def _bloom(spark: SparkSession, d: str) -> DataFrame:
    rows = _part_keys(spark, d).select("key")
    shards = max(1, -(-rows.count() // KEYS_A_FILTER))
    keys = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key")
    return bloom.probe(keys, bloom.build(keys, 0.01, shards, KEYS_A_FILTER))


def _writes(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).select("key", "value", "seq", "tombstone")


def _filled(spark: SparkSession, d: str) -> Store:
    """A new store that took the events in four batches, a run each."""
    store = Store(spark, scratch(spark), StoreOptions(max_runs=8))
    rows = _writes(spark, d)
    for i in range(4):
        store.write(rows.where(F.col("seq") % 4 == i))
        store.flush()
    return store


def _store_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Six batches one after the other in time, with merges on the way: a merge may drop a deletion only because later writes are newer."""
    store = Store(spark, scratch(spark), StoreOptions(max_runs=2))
    rows = _writes(spark, d)
    last = rows.agg(F.max("seq")).first()[0] or 0
    for i in range(6):
        store.write(rows.where(F.floor(F.col("seq") * 6 / (last + 1)) == i))
        store.flush()
    return _shown(_reopened(store).latest())


def _reopened(store: Store) -> Store:
    return Store(store.spark, store.path)


def _store_compact(spark: SparkSession, d: str) -> DataFrame:
    store = _filled(spark, d)
    store.compact()
    return _shown(_reopened(store).latest())


def _store_pending(spark: SparkSession, d: str) -> Store:
    """Three of four batches in one run, the rest pending."""
    store = Store(spark, scratch(spark))
    store.write(_writes(spark, d).where(F.col("seq") % 4 != 3))
    store.flush()
    store.write(_writes(spark, d).where(F.col("seq") % 4 == 3))
    return store


def _store_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Odd events first; even ones after a reopening, with sequence numbers below all others."""
    first = Store(spark, scratch(spark))
    first.write(_writes(spark, d).where(F.col("seq") % 2 == 1))
    first.close()
    again = _reopened(first)
    again.write(_writes(spark, d).where(F.col("seq") % 2 == 0).withColumn("seq", F.col("seq") - (1 << 40)))
    again.close()
    return _shown(_reopened(again).latest())


def _store_all_values(spark: SparkSession, d: str) -> DataFrame:
    rows = kv.all_values(_reopened(_filled(spark, d)).runs()).select("key", F.posexplode("chunks").alias("at", "value"))
    return _shown(rows.withColumn("key", F.concat("key", F.lit("/"), "at")))


def _index(spark: SparkSession, d: str, compact: bool = False) -> Index:
    """The index of all documents, built in two batches and opened again."""
    index = Index(spark, scratch(spark), PLAIN)
    for i in range(2):
        index.add(_docs(spark, d).where(F.col("doc_id") % 2 == i))
        index.flush()
    if compact:
        index.store.compact()
    return Index(spark, index.store.path)


def _part_files(spark: SparkSession, d: str) -> DataFrame:
    """All parts as single-file tables (content, age)."""
    return sorted_files.pack_files(kv.put(_part_keys(spark, d)), 4).select("content", F.col("file").cast("long").alias("age"))


def _part_shown(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.col("value").cast("string").alias("value"))


def _sets_merge(spark: SparkSession, d: str) -> DataFrame:
    """Postings of two halves of the documents that overlap, as serialised sets, united."""
    one, two = (sorted_files.pack_sets(index_ops.postings(_docs(spark, d).where(part), PLAIN)) for part in (F.col("doc_id") % 3 < 2, F.col("doc_id") % 3 > 0))
    return sorted_files.unpack_sets(sorted_files.merge_packed(one, two))


#: Searches of whole tables under a stemmed index; SQL has no such stemmer, tests hold them against plain Python.
TABLE_QUERIES = {
    "en": ["licensed", "licensing AND NOT works", "(rights OR foxes) AND NOT reserving", "NOT licenses", "the"],
    "ru": ["license", "de AND NOT лисы", "быстрая OR la", "NOT быстрый", "и"],
}


def _search_stemmed_table(lang: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _docs(spark, d)
        rows = index_ops.postings(docs, lang)
        out = None
        for q in TABLE_QUERIES[lang]:
            found = search(rows, docs, q, lang).select(F.lit(q).alias("query"), "doc_id")
            out = found if out is None else out.union(found)
        return out

    return run


#: The words of TABLE_QUERIES under their stems: SQL has no stemmer, so its twin names the inflected forms.
FORMS = {
    "licens": ["license", "licenses", "licensed", "licensing", "licens"],
    "work": ["work", "works", "worked", "working"],
    "right": ["right", "rights", "righted", "righting"],
    "fox": ["fox", "foxes", "foxed"],
    "reserv": ["reserve", "reserves", "reserved", "reserving", "reserv"],
    "лис": ["лиса", "лисы", "лису", "лисой", "лисе", "лис"],
    "быстр": ["быстрый", "быстрая", "быструю", "быстры", "быстро", "быстр"],
    "license": ["license"],
}
STEMMED_SQL = {
    "en": ["licens", "licens AND NOT work", '("right" OR fox) AND NOT reserv', "NOT licens", "false"],
    "ru": ["license", "de AND NOT лис", "быстр OR la", "NOT быстр", "false"],
}


def _stemmed_sql(lang: str) -> str:
    names = {f'"{k}"': v for k, v in FORMS.items()} | {"de": ["de"], "la": ["la"]}
    cases = " UNION ALL ".join(f"SELECT '{q}' AS query, doc_id FROM h WHERE {where}" for q, where in zip(TABLE_QUERIES[lang], STEMMED_SQL[lang]))
    return _terms_sql(**names) + cases


def _stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select(F.explode(text.surface_terms(F.col("text"), "en")).alias("word")).distinct()
    return words.select("word", stem_udf("en")("word").alias("term"))


def _postings_of(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(index_ops.postings(_docs(spark, d), PLAIN))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _search(q) for name, q in SEARCHES.items()}
    out |= {
        "search_stopword": _search("the", lang="en"),
        "search_not_stopword": _search("NOT the", lang="en"),
        "search_set_backend": _search(SEARCHES["search_nested"], "sets"),
        "search_bitmap_backend": _search(SEARCHES["search_nested"], "bitmaps"),
        "search_stemmed_table_en": _search_stemmed_table("en"),
        "search_stemmed_table_ru": _search_stemmed_table("ru"),
        "stem_vocab": _stem_vocab,
        "tokenize_docs": lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(text.tokenize(F.col("text"))).alias("pos", "token")),
        "normalize_terms": lambda s, d: _docs(s, d).select("doc_id", F.explode(text.surface_terms(F.col("text"), "en")).alias("term")),
        "postings": _postings_of(lambda p: p),
        "doc_freq": _postings_of(index_ops.doc_freq),
        "universe": lambda s, d: index_ops.universe(table(s, d, "documents")),
        "detect_language": lambda s, d: table(s, d, "documents").select("doc_id", text.detect_language(F.col("text")).alias("guess")),
        "bitmap_round_trip": _bitmap_round_trip,
        "kv_latest": lambda s, d: _shown(kv.latest(_versions(s, d))),
        "kv_get": lambda s, d: _shown(kv.get(_versions(s, d), "7")),
        "kv_multi_get": lambda s, d: _shown(kv.multi_get(_versions(s, d), MULTI)),
        "kv_range": lambda s, d: _shown(kv.range_scan(_versions(s, d), "10", "13")),
        "kv_delete": lambda s, d: kv.newest(_versions(s, d)).where("tombstone").select("key", "seq"),
        "kv_all_values": _all_values,
        "kv_history_order": lambda s, d: kv.history(_versions(s, d)).select("key", "seq", "tombstone"),
        "compact_latest": _compact_latest,
        "compact_union": _compact_union,
        "range_scan_keys": lambda s, d: kv.range_scan(kv.put(_part_keys(s, d)), "part-00000100", "part-00000120").select("key", F.col("value").cast("string").alias("value")),
        "seek_ge": lambda s, d: kv.seek(kv.put(_part_keys(s, d)), "part-00000150").select("key", F.col("value").cast("string").alias("value")),
        "bloom_no_false_negative": _bloom,
        "store_get": lambda s, d: _shown(_reopened(_filled(s, d)).get("7")),
        "store_range": lambda s, d: _shown(_reopened(_filled(s, d)).range("10", "13")),
        "store_all_values": _store_all_values,
        "store_compact": _store_compact,
        "store_tiered_merges": _store_tiers,
        "store_pending_over_runs": lambda s, d: _shown(_store_pending(s, d).latest()),
        "store_pending_dump": lambda s, d: _store_pending(s, d).pending_dump().select("key", "seq", "tombstone"),
        "store_reopened_epochs": _store_epochs,
        "index_search": lambda s, d: _index(s, d).search(SEARCHES["search_nested"]),
        "index_search_and": lambda s, d: _index(s, d, compact=True).search(SEARCHES["search_and"], backend="sets"),
        "index_universe": lambda s, d: _index(s, d).docs,
        "index_postings": lambda s, d: _index(s, d).terms.distinct(),
        "index_doc_freq_compacted": lambda s, d: index_ops.doc_freq(_index(s, d, compact=True).terms),
        "sorted_file_read": lambda s, d: _part_shown(kv.latest(sorted_files.unpack_files(_part_files(s, d)))),
        "sorted_file_range": lambda s, d: _part_shown(kv.range_scan(sorted_files.unpack_files(_part_files(s, d), *PARTS), *PARTS)),
        "sorted_file_get": lambda s, d: _part_shown(kv.latest(sorted_files.lookup(_part_files(s, d), PART_KEYS))),
        "bitmap_or_merge": _sets_merge,
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: f"{H}SELECT doc_id FROM h WHERE {where}" for name, where in SEARCH_SQL.items()}
    out["search_set_backend"] = out["search_bitmap_backend"] = out["search_nested"]
    part = "SELECT 'part-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS key, p_name AS value FROM part"
    out |= {
        "search_stopword": "SELECT doc_id FROM documents WHERE false",
        "search_not_stopword": "SELECT DISTINCT doc_id FROM documents",
        "search_stemmed_table_en": _stemmed_sql("en"),
        "search_stemmed_table_ru": _stemmed_sql("ru"),
        "tokenize_docs": f"SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, token FROM (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS pos FROM documents)",
        "normalize_terms": f"SELECT doc_id, term FROM (SELECT doc_id, unnest(list_distinct(list_transform({TOKENS}, lambda w: lower(w)))) AS term FROM documents) WHERE term NOT IN ({EN_STOP})",
        "postings": f"{P}SELECT DISTINCT term, doc_id FROM p",
        "doc_freq": f"{P}SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term",
        "universe": "SELECT DISTINCT doc_id FROM documents",
        "detect_language": r"SELECT doc_id, CASE WHEN regexp_matches(text, '^[^\p{L}]*\p{Cyrillic}') THEN 'ru' ELSE 'en' END AS guess FROM documents",
        "bitmap_round_trip": f"{P}SELECT DISTINCT term, doc_id FROM p",
        "kv_latest": LATEST_SQL,
        "kv_get": f"{LATEST_SQL} AND key = '7'",
        "kv_multi_get": f"{LATEST_SQL} AND key IN ({', '.join(f"'{k}'" for k in MULTI)})",
        "kv_range": f"{LATEST_SQL} AND key BETWEEN '10' AND '13'",
        "kv_delete": f"{VERSIONS_SQL}SELECT key, seq FROM top WHERE tombstone",
        "kv_all_values": VERSIONS_SQL
        + """, t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key, run_id ORDER BY seq DESC) = 1)
  SELECT key || '/' || CAST(row_number() OVER (PARTITION BY key ORDER BY run_id DESC) - 1 AS VARCHAR) AS key, value FROM t WHERE NOT tombstone AND value IS NOT NULL""",
        "kv_history_order": f"{VERSIONS_SQL}SELECT key, seq, tombstone FROM v",
        "compact_latest": LATEST_SQL,
        "compact_union": f"{P}SELECT DISTINCT term, doc_id FROM p",
        "range_scan_keys": f"SELECT * FROM ({part}) WHERE key BETWEEN 'part-00000100' AND 'part-00000120'",
        "seek_ge": f"SELECT * FROM ({part}) WHERE key >= 'part-00000150'",
        "bloom_no_false_negative": f"SELECT key, true AS found FROM ({part})",
        "store_tiered_merges": LATEST_SQL,
        "store_pending_dump": f"{VERSIONS_SQL}SELECT key, seq, tombstone FROM v WHERE seq % 4 = 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1",
        "store_reopened_epochs": f"{VERSIONS_SQL}SELECT key, value FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq % 2, seq DESC) = 1) WHERE NOT tombstone",
        "sorted_file_read": part,
        "sorted_file_range": f"SELECT * FROM ({part}) WHERE key BETWEEN '{PARTS[0]}' AND '{PARTS[1]}'",
        "sorted_file_get": f"SELECT * FROM ({part}) WHERE key IN ({', '.join(f"'{k}'" for k in PART_KEYS)})",
    }
    same = {
        "store_get": "kv_get", "store_range": "kv_range", "store_all_values": "kv_all_values", "store_compact": "kv_latest", "store_pending_over_runs": "kv_latest",
        "index_search": "search_nested", "index_search_and": "search_and", "index_universe": "universe", "index_postings": "postings",
        "index_doc_freq_compacted": "doc_freq", "bitmap_or_merge": "postings",
    }
    out |= {name: out[of] for name, of in same.items()}
    return out


__all__ = ["oracle_sql", "queries", "table"]
