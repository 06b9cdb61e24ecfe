"""URL filtering against dated lists, in DataFrame operations alone.

A list is a history: dated entries put a key (a whole URL, a host, or a domain with all its hosts) on a list or take it off.
``validity`` turns the entries of each key into the intervals in which they hold. ``apply`` joins every capture, as of its
fetch time, with the intervals of its own keys: its URL, its host and each parent domain of the host.

The as-of join is an equi-join. Time is cut into periods of several levels, each four times as long as those of the level below.
An interval belongs to the least level at which it touches five periods at most, and is dealt out to those; a capture falls into one
period of each level that the list has. Both meet on ``(key, level, period)`` with the exact times as a residual condition, so
neither an interval without end nor a stray fetch time makes many rows. Of one key's intervals at most one holds
at a time, so a capture gets one row a key at most. Periods also spread the captures of a hot host, and adaptive
execution splits what remains of one; captures whose keys are nowhere on the list leave with the join.

Defined results: a null, empty or unparsable URL has no host and matches nothing but an equal whole-URL entry; a null fetch time
matches nothing; entries with a null key or time are void; of one key's entries at the same time a removal goes first, so
the key is listed; repeated captures are each judged; an empty list lists nothing; input columns named like the added
ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIOD_DAYS = 30
#: Levels of periods; one of the highest is longer than all times that Spark can hold.
LEVELS = 14
OPEN_END = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user, port and closing dot; null if it has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def keys_of(url: Column, host: Column) -> Column:
    """All keys under which a URL may be listed: ``url:``, ``host:`` and, for the host and each of its parents, ``domain:``."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    own = F.array(F.concat(F.lit("url:"), url))
    return F.when(url.isNull(), F.array().cast("array<string>")).when(host.isNull(), own).otherwise(F.array_distinct(F.concat(own, F.array(F.concat(F.lit("host:"), host)), parents)))


def validity(entries: DataFrame) -> DataFrame:
    """``(key, valid_from, valid_to)`` of entries ``(key, at, listed)``: from each listing to the next entry of its key, neighbours joined.

    The window needs a key's own entries together; a list has few a key."""
    rows = entries.select("key", F.col("at").cast("timestamp").alias("at"), F.coalesce("listed", F.lit(False)).alias("listed")).where("key IS NOT NULL AND at IS NOT NULL")
    # One state for each key and time: listed if any entry there says so.
    rows = rows.groupBy("key", "at").agg(F.max("listed").alias("listed"))
    order = Window.partitionBy("key").orderBy("at")
    changes = rows.withColumn("_before", F.lag("listed", 1, False).over(order)).where("listed <> _before")
    return changes.withColumn("valid_to", F.coalesce(F.lead("at").over(order), F.to_timestamp(F.lit(OPEN_END)))).where("listed").select("key", F.col("at").alias("valid_from"), "valid_to")


def _period(time: Column, level: Column | int = 0) -> Column:
    """The period that a time falls into: the one of the lowest level, with two bits less for each level above."""
    lowest = F.floor(F.unix_seconds(time) / (86_400 * PERIOD_DAYS))
    return F.floor(lowest / F.pow(F.lit(4.0), F.lit(level) if isinstance(level, int) else level)).cast("long")


def _dealt(intervals: DataFrame) -> DataFrame:
    """``intervals`` with ``_level`` and ``_period``, a row for each of at most five periods."""
    spans = F.array(*(_period(F.col("valid_to"), n) - _period(F.col("valid_from"), n) for n in range(LEVELS)))
    rows = intervals.withColumn("_level", F.array_position(F.transform(spans, lambda x: x < 5), F.lit(True)).cast("int") - 1)
    first, last = (_period(F.col(x), F.col("_level")) for x in ("valid_from", "valid_to"))
    return rows.withColumn("_period", F.explode(F.sequence(first, last)))


def apply(captures: DataFrame, intervals: DataFrame, url: str = "url", fetched: str = "fetch_ts", capture_id: str = "page_id") -> DataFrame:
    """``captures`` with ``host, blocked, listed_key, listed_from`` after their own columns: the most specific key that held at the
    fetch time, and since when. ``capture_id`` names the rows; those that repeat it are judged alike if their URL and time are."""
    names = ["host", "blocked", "listed_key", "listed_from"]
    rows = captures.drop(*names).withColumn("host", host_of(F.col(url)))
    dealt = _dealt(intervals)
    # Of the few levels, those that the list has.
    levels = sorted(x[0] for x in dealt.select("_level").distinct().collect()) or [0]
    times = F.array(*(F.struct(F.lit(n).alias("_level"), _period(F.col("_at"), n).alias("_period")) for n in levels))
    probes = (
        rows.where(F.col(fetched).isNotNull())
        .select(F.col(capture_id).alias("_id"), F.col(url).alias("_url"), F.col(fetched).alias("_at"), "host")
        .distinct()
        .withColumn("key", F.explode(keys_of(F.col("_url"), F.col("host"))))
        .withColumn("_time", F.explode(times))
        .select("*", "_time.*")
    )
    hits = probes.join(dealt, ["key", "_level", "_period"]).where("valid_from <= _at AND _at < valid_to")
    # A capture has few keys: a URL, a host and its parents.
    rank = F.struct((-F.when(F.col("key").startswith("url:"), 1 << 20).when(F.col("key").startswith("host:"), 1 << 19).otherwise(F.length("key"))).alias("order"), F.col("key").alias("key"), F.col("valid_from").alias("valid_from"))
    best = hits.groupBy("_id", "_url", "_at").agg(F.min(rank).alias("_best"))
    return (
        rows.join(best, F.col(capture_id).eqNullSafe(F.col("_id")) & F.col(url).eqNullSafe(F.col("_url")) & (F.col(fetched) == F.col("_at")), "left")
        .withColumn("blocked", F.col("_best").isNotNull())
        .withColumn("listed_key", F.col("_best.key"))
        .withColumn("listed_from", F.col("_best.valid_from"))
        .drop("_id", "_url", "_at", "_best")
    )


# The tables have no fetch times and no list, so the query derives both from what they have, by rules that SQL can repeat: a
# page is fetched on day page_id mod 365 of 2024; a host's MD5 says when it, or its domain, goes on the list and off again.
_LISTED = "(conv(substr(md5(host), 1, 4), 16, 10) % 3)"
_DAY = "(conv(substr(md5(host), 5, 4), 16, 10) % 250)"


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages: a third of the hosts are listed for 60 days and again after 120; of a further third, the
    registrable domain is listed for 45 days."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    host = "concat('host:', host)"
    domain = "concat('domain:', substring_index(host, '.', -3))"
    return hosts.selectExpr(
        f"""explode(CASE {_LISTED} WHEN 0 THEN array(
          struct({host} AS key, {_DAY} AS day, true AS listed), struct({host} AS key, {_DAY} + 60 AS day, false AS listed), struct({host} AS key, {_DAY} + 120 AS day, true AS listed))
        WHEN 1 THEN array(struct({domain} AS key, {_DAY} AS day, true AS listed), struct({domain} AS key, {_DAY} + 45 AS day, false AS listed))
        ELSE array() END) AS e"""
    ).selectExpr("e.key AS key", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(e.day AS int)) AS at", "e.listed AS listed")


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetch_ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id % 365 AS int))"))
    rows = apply(captures, validity(sample_entries(pages)))
    return rows.select("page_id", "host", F.date_format("fetch_ts", "yyyy-MM-dd").alias("fetched"), "blocked", "listed_key", F.date_format("listed_from", "yyyy-MM-dd").alias("listed_from"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\.$', ''), '') AS host,
    DATE '2024-01-01' + (page_id % 365)::INTEGER AS ts FROM pages
), h AS (
  SELECT host, ('0x' || md5(host)[1:4])::INTEGER % 3 AS kind, ('0x' || md5(host)[5:8])::INTEGER % 250 AS day,
    'domain:' || array_to_string(string_split(host, '.')[-3:], '.') AS domain FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)
), raw AS (
  SELECT 'host:' || host AS key, day, true AS listed FROM h WHERE kind = 0
  UNION ALL SELECT 'host:' || host, day + 60, false FROM h WHERE kind = 0
  UNION ALL SELECT 'host:' || host, day + 120, true FROM h WHERE kind = 0
  UNION ALL SELECT domain, day, true FROM h WHERE kind = 1
  UNION ALL SELECT domain, day + 45, false FROM h WHERE kind = 1
), e AS (
  SELECT key, DATE '2024-01-01' + day::INTEGER AS ts, bool_or(listed) AS listed FROM raw GROUP BY 1, 2
), c AS (
  SELECT * FROM (SELECT *, lag(listed, 1, false) OVER (PARTITION BY key ORDER BY ts) AS prev FROM e) WHERE listed <> prev
), k AS (
  SELECT page_id, ts, key, CASE WHEN key LIKE 'url:%' THEN -1048576 WHEN key LIKE 'host:%' THEN -524288 ELSE -length(key) END AS pref
  FROM (SELECT page_id, ts, unnest(['url:' || url, 'host:' || host] || list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'domain:' || array_to_string(string_split(host, '.')[i:], '.'))) AS key FROM p WHERE host IS NOT NULL)
), m AS (
  SELECT k.page_id, k.key, k.pref, c.ts AS valid_from FROM k ASOF JOIN c ON k.key = c.key AND k.ts >= c.ts WHERE c.listed
), b AS (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pref, key) = 1
)
SELECT p.page_id, p.host, strftime(p.ts, '%Y-%m-%d') AS fetched, b.key IS NOT NULL AS blocked, b.key AS listed_key, strftime(b.valid_from, '%Y-%m-%d') AS listed_from
FROM p LEFT JOIN b ON p.page_id = b.page_id
"""
