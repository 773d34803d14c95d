"""Chat formatting by rotating the perspective: each participant in turn is the assistant.

Spark functions alone. A rendering is a sequence of pages of `PAGE` turns, counted from the first turn of
the conversation, so that a row stays bounded however long the conversation is; all but very long ones are
one page. Turns are put in order by one distributed sort, which splits a conversation that holds a large
part of all turns; a page is then a range of running numbers.

Texts and names can't forge the template's marks: a `<` or `|` that would begin or end one gets a backslash
after it, and backslashes already there one more, so that `unescaped` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

PAGE = 1024
SYSTEM = "system"
END = "<|end|>\n"


# What escaping finds and puts in its place, for Java's and RE2's replacements.
ESCAPES = ((r"<(\\*)\|", r"<\\$1|", r"<\\\1|"), (r"\|(\\*)>", r"|\\$1>", r"|\\\1>"))


def escaped(text: Column) -> Column:
    for pattern, java, _ in ESCAPES:
        text = F.regexp_replace(text, pattern, java)
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\|\\(\\*)>", "|$1>"), r"<\\(\\*)\|", "<$1|")


def head(role: Column, speaker: Column) -> Column:
    """How a turn begins: the speaker's own as assistant, system turns as such, others as named users."""
    named = F.concat(F.lit("<|user name="), escaped(role), F.lit("|>\n"))
    return F.when(role == speaker, "<|assistant|>\n").when(role == SYSTEM, "<|system|>\n").otherwise(named)


def _paged(rows: DataFrame, page: int) -> DataFrame:
    """rows (conv_id, turn, role, text), all different, to those and `at`, their running number, `page` and `pages`, those of the conversation."""
    order = ["conv_id", "turn", "role", "text"]
    # Written: a row keeps its number. Its upper bits are the partition's, the lower ones count within it.
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    rows = rows.withColumns({"part": F.shiftright("id", 33), "i": F.col("id").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = rows.join(parts, "part").withColumn("at", F.col("offset") + F.col("i"))
    whole = written(rows.groupBy(F.col("conv_id").alias("of")).agg(F.min("at").alias("first"), F.count("*").alias("n")))
    rows = rows.join(whole, F.col("conv_id").eqNullSafe(F.col("of")))
    return rows.select(*order, "at", F.floor((F.col("at") - F.col("first")) / page).alias("page"), F.ceil(F.col("n") / page).alias("pages"))


def rotate(turns: DataFrame, page: int = PAGE) -> DataFrame:
    """One row for each (conv_id, speaker, page): pages, rendered, mask, loss_spans, loss_chars.

    turns: (conv_id, turn, role, text). Speakers are the roles of a conversation but `system`. A dialogue of up
    to `page` turns is one row with page 0; `pages` says how many rows a longer one has, each a sample of its
    own. mask has a digit for each turn, 1 where it is the speaker's; loss_spans gives the characters of
    `rendered` that the speaker says, end marks included, as start:end pairs counted from 0, end excluded.
    Turns sort by number (null first), then role, then text; exact repeats count once; a null text is
    empty, a null role is a user without name who is no speaker; null conv_ids form one conversation.
    Conversations with system turns only give no row. Texts and names are escaped. Other columns are
    ignored; an empty table gives an empty result.
    """
    at = F.col("turn").cast("long")
    rows = turns.select("conv_id", at.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    rows = _paged(rows, page)
    said = F.transform(F.sort_array(F.collect_list(F.struct("at", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    pages = rows.groupBy("conv_id", "page", "pages").agg(said.alias("said"))
    speakers = rows.where((F.col("role") != SYSTEM) & (F.col("role") != "")).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    out = pages.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    speaker = F.col("speaker")
    parts = F.transform("said", lambda x: F.struct(head(x["role"], speaker).alias("head"), F.concat(escaped(x["text"]), F.lit(END)).alias("body"), (x["role"] == speaker).alias("own")))
    out = out.withColumn("parts", parts)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        span = F.array(F.concat(a.cast("string"), F.lit(":"), b.cast("string")))
        return F.struct(b.alias("at"), F.when(x["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return out.select(
        "conv_id",
        "speaker",
        "page",
        "pages",
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        F.array_join(F.transform("parts", lambda x: F.when(x["own"], "1").otherwise("0")), "").alias("mask"),
        F.array_join(F.aggregate("parts", start, step)["spans"], ",").alias("loss_spans"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.when(x["own"], F.length(x["body"])).otherwise(0)).alias("loss_chars"),
    )


def rotate_sql(page: int = PAGE) -> str:
    """The same for DuckDB, over conversations."""
    end, order = "'<|end|>' || chr(10)", "turn NULLS FIRST, role, text"

    def marked(column: str) -> str:
        for pattern, _, re2 in ESCAPES:
            column = f"regexp_replace({column}, '{pattern}', '{re2}', 'g')"
        return column

    return f"""WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
  r AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY {order}) - 1) // {page} AS BIGINT) AS page,
    CAST(ceil(count(*) OVER (PARTITION BY conv_id) / {page}) AS BIGINT) AS pages FROM t),
  s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role NOT IN ('', '{SYSTEM}')),
  x AS (SELECT r.*, speaker, role = speaker AS own, {marked("text")} || {end} AS body, CASE WHEN role = speaker THEN '<|assistant|>' || chr(10)
    WHEN role = '{SYSTEM}' THEN '<|system|>' || chr(10) ELSE '<|user name=' || {marked("role")} || '|>' || chr(10) END AS head
    FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
  y AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, page ORDER BY {order}) AS e FROM x)
SELECT conv_id, speaker, page, pages, string_agg(head || body, '' ORDER BY {order}) AS rendered,
  string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY {order}) AS mask,
  coalesce(string_agg(CASE WHEN own THEN CAST(e - length(body) AS BIGINT) || ':' || CAST(e AS BIGINT) END, ',' ORDER BY {order}), '') AS loss_spans,
  CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS loss_chars
FROM y GROUP BY conv_id, speaker, page, pages"""
