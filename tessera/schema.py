"""Fixed schemas and options shared by every table of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

KV = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("epoch", T.LongType(), False),
        T.StructField("run_id", T.LongType(), False),
    ]
)
POSTINGS = T.StructType([T.StructField("term", T.StringType(), False), T.StructField("doc_id", T.LongType(), False)])
DOCS = T.StructType([T.StructField("doc_id", T.LongType(), False)])

MAX_DOC_ID = 2**32 - 1

#: Merge policies: newest value per key, or union of all postings of a term.
KV_LATEST, UNION = "kv_latest", "union"


@dataclass(frozen=True)
class StoreOptions:
    """Settings of one store; none of them changes an answer, only the layout.

    flush_keys: pending distinct keys that trigger a new run (values below 1 flush each batch).
    row_group_bytes, row_group_rows: size of a Parquet row group at most (0 rows: no such limit).
    bloom_fp: rate asked of the Bloom filters.  max_runs: more live runs than this trigger a merge of the
    newest ones, tier by tier.  mode: merge policy.
    """

    flush_keys: int = 1 << 20
    row_group_bytes: int = 128 << 20
    row_group_rows: int = 0
    bloom_fp: float = 0.01
    max_runs: int = 4
    mode: str = KV_LATEST
    lang: str = "en"
