"""URL filters by a temporal list join, in DataFrame functions only.

A filter list is a log of dated entries: a domain is added or removed on a date.
Each domain's entries become validity intervals (an addition holds until the
domain's next entry), and every capture is judged by the entries that were active
when it was fetched: its host and all parent domains are looked up as of the
fetch time, and the most specific active entry decides.

The join is on the domain, with the interval as a further condition, so a host
with a third of all captures needs no window over them; the intervals are
written out, and both sides of the join have exchanges that Spark may split.

Defined results: a capture with a null or unreadable URL or a null fetch time is
not blocked (host null where there is none). Entries with a null domain, action
or date are ignored; of entries of one domain and date, a removal wins. Interval
ends are exclusive. Repeated captures are judged each by itself. Further columns
of the captures stay, but for ``host``, ``blocked``, ``rule`` and ``rule_since``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

ADDED = ("host", "blocked", "rule", "rule_since")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more (a host of one label: itself)."""
    labels = F.split(host, r"\.")
    depth = F.greatest(F.size(labels) - 2, F.lit(0))
    return F.transform(F.sequence(F.lit(0), depth), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, since, until) from entries (domain, action 'add' or 'remove', since)."""
    dated = entries.where("domain is not null and action in ('add', 'remove') and since is not null")
    # one state for each domain and date; a removal wins
    dated = dated.groupBy(F.lower("domain").alias("domain"), "since").agg(F.max("action").alias("action"))
    by_domain = Window.partitionBy("domain").orderBy("since")  # one domain's entries: dates bound them
    return dated.withColumn("until", F.lead("since").over(by_domain)).where("action = 'add'").drop("action")


def temporal_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with host, blocked, rule (the domain) and rule_since. ``captures``
    must be a stable scan."""
    keyed = shared.boxed(captures).withColumn("_host", host_of(shared.field(url_col).cast("string")))
    asked = keyed.where(F.col("_host").isNotNull() & shared.field(time_col).isNotNull())
    asked = asked.select("_row", shared.field(time_col).alias("_at"), F.explode(domains_of(F.col("_host"))).alias("domain"))
    active = shared.cut(intervals(entries), "intervals")
    hits = asked.join(active, "domain").where("since <= _at and (until is null or _at < until)")
    best = hits.groupBy("_row").agg(F.max(F.struct(F.length("domain").alias("n"), F.col("domain"), F.col("since"))).alias("_best"))
    return keyed.join(best, "_row", "left").select(
        *shared.unboxed(captures.columns, ADDED),
        F.col("_host").alias("host"),
        F.col("_best").isNotNull().alias("blocked"),
        F.col("_best.domain").alias("rule"),
        F.col("_best.since").alias("rule_since"),
    )


#: The tables hold neither fetch times nor a list; the query derives both from
#: page ids and from the hosts' MD5, in terms that DuckDB shares.
FETCHED = "timestamp_seconds(1704067200 + (page_id * 7919) % 31536000)"


def sample_entries(captures: DataFrame) -> DataFrame:
    """A dated list over the domains of ``captures``: about a third are listed, some removed, some listed again."""
    domains = captures.select(F.explode(domains_of(host_of(F.col("url")))).alias("domain")).distinct()
    keyed = domains.withColumn("k", F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("long")).where("k % 3 = 0")
    day = lambda n: F.timestamp_seconds(1704067200 + 86400 * n)
    entry = lambda action, since: F.struct(F.lit(action).alias("action"), day(since).alias("since"))
    k = F.col("k")
    dated = F.array(entry("add", k % 200), F.when(k % 2 == 0, entry("remove", k % 200 + 30 + k % 61)), F.when(k % 4 == 0, entry("add", k % 200 + 120)))
    return keyed.select("domain", F.explode(F.filter(dated, lambda e: e.isNotNull())).alias("e")).select("domain", "e.action", "e.since")


def op8_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr(FETCHED).alias("fetched"))
    return temporal_filter(pages, sample_entries(pages)).select("page_id", "host", "fetched", "blocked", "rule", "rule_since")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '') AS host,
         make_timestamp((1704067200 + (page_id * 7919) % 31536000) * 1000000) AS fetched FROM pages
), h AS (
  SELECT DISTINCT host, string_split(host, '.') AS x FROM p WHERE host IS NOT NULL
), d AS (
  SELECT DISTINCT array_to_string(x[i:], '.') AS domain FROM (SELECT x, unnest(range(1, greatest(len(x) - 1, 1) + 1)) AS i FROM h)
), k AS (
  SELECT domain, ('0x' || substr(md5(domain), 1, 6))::BIGINT AS k FROM d
), l AS (
  SELECT domain, 'add' AS action, k % 200 AS day FROM k WHERE k % 3 = 0
  UNION ALL SELECT domain, 'remove', k % 200 + 30 + k % 61 FROM k WHERE k % 6 = 0
  UNION ALL SELECT domain, 'add', k % 200 + 120 FROM k WHERE k % 12 = 0
), v AS (
  SELECT domain, action, make_timestamp((1704067200 + 86400 * day) * 1000000) AS since,
         lead(make_timestamp((1704067200 + 86400 * day) * 1000000)) OVER (PARTITION BY domain ORDER BY day) AS until FROM l
), m AS (
  SELECT page_id, domain, since, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS n
  FROM p JOIN v ON (host = domain OR ends_with(host, '.' || domain)) AND action = 'add' AND since <= fetched AND (until IS NULL OR fetched < until)
)
SELECT p.page_id, host, fetched, m.page_id IS NOT NULL AS blocked, domain AS rule, since AS rule_since
FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1
"""
