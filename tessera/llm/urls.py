"""URL filters: host reputation by empirical Bayes, under explicit rules. Spark functions alone.

Outcomes of pages are counted by host, registered domain and suffix; `page_outcomes` labels a page by its
own text, any other labels by page will do. Each level's counts are
shrunk to the level above through a beta prior whose strength is estimated from the spread between
groups (beta-binomial moments). A host is blocked if the posterior of its bad rate lies above a limit
by a margin of standard deviations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

LIMIT, MARGIN, STRENGTHS = 0.5, 1.28, (1.0, 1000.0)
# Suffixes of two labels under which domains are registered; all others are the last label. A parameter where more are needed.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.tr", "gov.uk", "ne.jp", "org.uk")
ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$"  # an IPv4 address, or IPv6 in brackets: a domain of its own, without a suffix
# What a page's text is read from, and what makes it junk.
UNSEEN, SYMBOLS, JUNK = r"(?is)<(?:script.*?</script>|style.*?</style>|!--.*?-->|[^>]*>)", r"[!#$%&*+=?@^_~]{3}", 0.2
WORDS = r"[^\x20\x09-\x0D]+"
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        of, _, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, says).otherwise(verdict)
    return found, verdict


def page_outcomes(pages: DataFrame) -> DataFrame:
    """(page_id, bad) of (page_id, html): 1 if the visible text is empty or there are three symbols in a row as often as a fifth of its words or more.

    Null html has no outcome; repeated rows have one each.
    """
    seen = F.replace(F.regexp_replace(F.col("html").cast("string"), UNSEEN, " "), F.lit("&amp;"), F.lit("&"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), seen.alias("seen")).where("seen IS NOT NULL")
    bad = F.regexp_count("seen", F.lit(SYMBOLS)) >= JUNK * F.regexp_count("seen", F.lit(WORDS))
    return rows.select("page_id", bad.cast("int").alias("bad"))


def levels(host: Column, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, a port left aside. An address is a domain under the empty suffix."""
    name = F.regexp_replace(host, r":\d*$", "")
    last = F.substring_index(name, ".", -1)
    suffix = F.when(F.substring_index(name, ".", -2).isin(*suffixes), F.substring_index(name, ".", -2)).otherwise(last)
    domain = F.when(F.length(suffix) > F.length(last), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    address = name.rlike(ADDRESS)
    return F.when(address, name).otherwise(domain), F.when(address, "").otherwise(suffix)


def _strength() -> Column:
    """Prior strength of a level from its groups' n and bad: the inverse of the intraclass correlation, less 1."""
    none = F.lit(0.0)
    n, groups = F.nullif(F.sum("n").cast("double"), none), F.count("*")
    mean = F.sum("bad") / n
    spread = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - F.sum("bad") * F.sum("bad") / n
    inner = F.nullif(mean * (1 - mean), none)
    rho = (spread / inner - (groups - 1)) / F.nullif(n - F.sum(F.col("n") * F.col("n")) / n - (groups - 1), none)
    kappa = F.when(rho > 0, 1 / rho - 1).otherwise(STRENGTHS[1])
    return F.least(F.greatest(kappa, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1]))


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """(host, domain, suffix, n, bad) sums of labelled pages by host to posterior parameters.

    Returns hosts (host, a, b), domains (domain, m2), suffixes (suffix, m1), and the numbers m0 and k2: the
    overall rate and the strength of a host's prior. Sums by level are made from the sums by host; four
    numbers go to the driver.
    """
    hosts = written(outcomes.groupBy("host", "domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k0, k1, k2 = (rows.agg(_strength()).first()[0] for rows in (suffixes, domains, hosts))
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    m0 = ((bad or 0) + 1) / ((n or 0) + 2)

    def shrunk(rows: DataFrame, prior: Column, strength: float) -> DataFrame:
        b = strength * (1 - prior) + F.col("n") - F.col("bad")
        return rows.withColumn("a", strength * prior + F.col("bad")).withColumn("b", b)

    mean = F.col("a") / (F.col("a") + F.col("b"))
    suffixes = shrunk(suffixes, F.lit(m0), k0).select("suffix", mean.alias("m1"))
    domains = shrunk(domains.join(suffixes, "suffix"), F.col("m1"), k1).select("domain", mean.alias("m2"))
    hosts = shrunk(hosts.join(domains, "domain"), F.col("m2"), k2).select("host", "a", "b")
    return hosts, domains, suffixes, m0, k2


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, margin: float = MARGIN) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict.

    outcomes: (page_id, bad 0 or 1) of labelled pages; several rows of a page count as bad if one is, a null
    as none. Hosts without labels take their domain's prior, else their suffix's, else that of all pages; an empty
    host has levels of its own. Repeated rows are judged each, and count each. A null page_id has no label.
    An empty table gives an empty result; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    domain, suffix = levels(F.col("host"))
    rows = rows.withColumn("domain", domain).withColumn("suffix", suffix)
    labels = outcomes.select(F.col("page_id").cast("long").alias("page_id"), "bad").where("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = rows.join(labels, "page_id").select("host", "domain", "suffix", F.lit(1).alias("n"), F.col("bad").cast("long").alias("bad"))
    hosts, domains, suffixes, m0, k2 = reputation(labelled)
    # Verdicts by host first: as many rows as there are hosts.
    all_hosts = rows.select("host", "domain", "suffix").distinct()
    known = all_hosts.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    mean = F.coalesce("m2", "m1", F.lit(m0))
    known = known.select("host", F.coalesce("a", k2 * mean).alias("a"), F.coalesce("b", k2 * (1 - mean)).alias("b"))
    s = F.col("a") + F.col("b")
    bound = F.col("a") / s - margin * F.sqrt(F.col("a") * F.col("b") / (s * s * (s + 1)))
    known = known.select("host", F.when(bound > limit, "block").otherwise("allow").alias("says"))
    found, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(written(known), "host").select("page_id", "host", "path", found.alias("rule"), F.coalesce(verdict, F.col("says")).alias("verdict"))


def judge_sql(rules=RULES, limit: float = LIMIT, margin: float = MARGIN) -> str:
    """The same for DuckDB, over pages and their outcomes by `page_outcomes`."""
    fits = [(r, says, r.partition("/")) for r, says in sorted(rules, key=lambda r: -len(r[0]))]
    test = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')"
    rule = " ".join(f"WHEN {test.format(p[0], p[2])} THEN '{r}'" for r, _, p in fits)
    verdict = " ".join(f"WHEN {test.format(p[0], p[2])} THEN '{says}'" for _, says, p in fits)
    long = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
    inner = "nullif(sum(bad) / nullif(sum(n), 0) * (1 - sum(bad) / nullif(sum(n), 0)), 0)"
    spread = "(sum(bad * bad / n) - sum(bad) * sum(bad) / nullif(sum(n), 0))"
    rho = f"(({spread} / {inner} - (count(*) - 1)) / nullif(sum(n) - sum(n * n) / nullif(sum(n), 0) - (count(*) - 1), 0))"
    strength = f"least(greatest(CASE WHEN {rho} > 0 THEN 1 / {rho} - 1 ELSE {STRENGTHS[1]} END, {STRENGTHS[0]}), {STRENGTHS[1]})"
    return f"""WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
  v AS (SELECT *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS parts FROM u),
  w AS (SELECT page_id, host, path, CASE WHEN array_to_string(parts[-2:], '.') IN ({long}) THEN 2 ELSE 1 END AS k, parts,
    regexp_matches(array_to_string(parts, '.'), '{ADDRESS}') AS address FROM v),
  p AS (SELECT page_id, host, path, CASE WHEN address THEN array_to_string(parts, '.') ELSE array_to_string(parts[-k - 1:], '.') END AS domain,
    CASE WHEN address THEN '' ELSE array_to_string(parts[-k:], '.') END AS suffix FROM w),
  q AS (SELECT page_id, replace(regexp_replace(html, '{UNSEEN}', ' ', 'g'), '&amp;', '&') AS seen FROM pages),
  l AS (SELECT page_id, max(CASE WHEN len(regexp_extract_all(seen, '{SYMBOLS}')) >= {JUNK} * len(regexp_extract_all(seen, '{WORDS}')) THEN 1 ELSE 0 END) AS bad
    FROM q WHERE seen IS NOT NULL GROUP BY page_id),
  h AS (SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM p JOIN l USING (page_id) GROUP BY ALL),
  d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
  s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
  k AS (SELECT (SELECT {strength} FROM s) AS k0, (SELECT {strength} FROM d) AS k1, (SELECT {strength} FROM h) AS k2,
    (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM s) AS m0),
  s2 AS (SELECT suffix, (k0 * m0 + bad) / (k0 + n) AS m1 FROM s, k),
  d2 AS (SELECT domain, (k1 * m1 + bad) / (k1 + n) AS m2 FROM d JOIN s2 USING (suffix), k),
  h2 AS (SELECT host, k2 * m2 + bad AS a, k2 * (1 - m2) + n - bad AS b FROM h JOIN d2 USING (domain), k),
  x AS (SELECT p.*, coalesce(a, k2 * coalesce(m2, m1, m0)) AS a, coalesce(b, k2 * (1 - coalesce(m2, m1, m0))) AS b
    FROM p LEFT JOIN h2 USING (host) LEFT JOIN d2 USING (domain) LEFT JOIN s2 USING (suffix), k)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict}
  WHEN a / (a + b) - {margin} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {limit} THEN 'block' ELSE 'allow' END AS verdict FROM x"""
