"""URL filters over time: dated list entries as validity intervals, joined as of the fetch.

A list says at some times that a domain, a host or a path prefix is added, at others that it is
removed. The events of a pattern become intervals in which it is listed, and a capture is
blocked if an interval of one of its patterns holds its fetch time. Both sides are cut into
buckets of time, so the captures of a hot host are spread over many join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from baitwatch.llm.common import table, written

BUCKET_DAYS = 28
_KEYS = ["list_name", "kind", "pattern"]


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and the dot of the root; empty if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.rtrim(F.lower(host), F.lit("."))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def url_patterns(url: Column) -> Column:
    """All patterns that would match: the host, its domains of two labels or more, and the
    host with each prefix of the path that ends between two slashes."""
    labels = F.split(url_host(url), r"\.")
    count = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda i: F.struct(
        F.lit("domain").alias("kind"),
        F.array_join(F.slice(labels, i, count), ".").alias("pattern")))
    domains = F.when(count >= 2, domains).otherwise(F.slice(domains, 1, 0))
    steps = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(steps)), lambda i: i > 0), lambda i: F.struct(
            F.lit("prefix").alias("kind"),
            F.concat(url_host(url), F.lit("/"),
                     F.array_join(F.slice(steps, 1, i), "/")).alias("pattern")))
    host = F.array(F.struct(F.lit("host").alias("kind"), url_host(url).alias("pattern")))
    return F.filter(F.concat(host, domains, prefixes), lambda p: p["pattern"] != "")


def _bucket(at: Column, days: int) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(days * 86_400_000_000)).cast("long")


def validity_intervals(entries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``list_name, kind, pattern, valid_from, valid_to`` from ``action`` and ``at`` of entries.

    The latest event decides; of events at one time a removal does. An interval ends at the
    next event of its pattern and has a null end without one. Entries with a null in any of
    these columns or another action are ignored. The next event is looked up inside a bucket
    of time first, and only the first event of each bucket is compared across buckets.
    """
    events = entries.select(*_KEYS, "action", F.col("at").cast("timestamp").alias("at")).filter(
        F.col("action").isin("add", "remove")).dropna()
    events = events.groupBy(*_KEYS, "at").agg(F.max("action").alias("action"))
    events = events.withColumn("bucket", _bucket(F.col("at"), bucket_days))
    firsts = events.groupBy(*_KEYS, "bucket").agg(F.min("at").alias("first"))
    later = F.lead("first").over(W.partitionBy(*_KEYS).orderBy("bucket"))
    firsts = firsts.select(*_KEYS, "bucket", later.alias("later"))
    inside = F.lead("at").over(W.partitionBy(*_KEYS, "bucket").orderBy("at"))
    dated = events.withColumn("next", inside).join(firsts, [*_KEYS, "bucket"])
    return dated.filter("action = 'add'").select(
        *_KEYS, F.col("at").alias("valid_from"), F.coalesce("next", "later").alias("valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url",
                    fetched: str = "fetched_at", bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """The captures with ``blocked``, ``n_matches``, ``first_list`` and ``listed_since``.

    A capture is blocked by entries active at its fetch time: added at that moment or before
    and not removed until then. Without a URL, a host or a fetch time none matches. Equal
    captures get equal answers; no row is lost or repeated. Columns of these names are
    replaced. Without entries nothing is blocked.
    """
    added = ("blocked", "n_matches", "first_list", "listed_since")
    names = [c for c in captures.columns if c not in added]
    captures = captures.select(*names)
    asked = captures.select(F.col(url).alias("_url"), F.col(fetched).cast("timestamp").alias("_at"))
    asked = asked.dropna().distinct()
    candidates = asked.select(
        "_url", "_at", F.inline(url_patterns(F.col("_url"))),
    ).withColumn("bucket", _bucket(F.col("_at"), bucket_days))

    intervals = written(validity_intervals(entries, bucket_days), "intervals")
    last = asked.agg(F.max("_at")).first()[0]
    until = F.least(F.coalesce(F.col("valid_to"), F.lit(last)), F.lit(last))
    spans = intervals.filter(F.col("valid_from") <= F.lit(last)).withColumn("bucket", F.explode(
        F.sequence(_bucket(F.col("valid_from"), bucket_days), _bucket(until, bucket_days))))
    active = (F.col("valid_from") <= F.col("_at")) & (
        F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    # Spark can't tell the size of what an explode returns, so it must not broadcast it.
    hits = candidates.join(spans.hint("merge"), ["kind", "pattern", "bucket"]).filter(active)
    hits = hits.groupBy("_url", "_at").agg(
        F.count("*").alias("n_matches"), F.min("list_name").alias("first_list"),
        F.min("valid_from").alias("listed_since"))
    same = (captures[url] == hits["_url"]) & (captures[fetched].cast("timestamp") == hits["_at"])
    return captures.join(hits, same, "left").select(
        *(captures[c] for c in names), F.col("n_matches").isNotNull().alias("blocked"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), "first_list",
        "listed_since")


# The tables have no fetch times and no lists. Both are derived from the pages: a page is
# fetched at a time that its id decides, and hosts, domains and path prefixes are added to
# lists, removed and added again on days that the MD5 of the pattern decides.

_START = "2024-01-01 00:00:00"
_SECONDS = 63_072_000
_EVENTS = (
    # list, kind, modulus and remainder that choose patterns, action, days: base, factor, modulus
    ("ads", "host", 3, 0, "add", 0, 1, 500),
    ("ads", "host", 6, 0, "remove", 520, 1, 90),
    ("ads", "host", 12, 0, "add", 640, 1, 30),
    ("malware", "domain", 4, 1, "add", 30, 1, 600),
    ("malware", "domain", 8, 1, "remove", 650, 1, 20),
    ("adult", "prefix", 5, 2, "add", 10, 1, 700),
    ("adult", "prefix", 10, 2, "remove", 400, 1, 300),
)


def page_captures(pages: DataFrame) -> DataFrame:
    seconds = F.pmod(F.col("page_id") * 7_919_333, F.lit(_SECONDS))
    return pages.select("page_id", "url", F.timestamp_seconds(
        F.unix_timestamp(F.lit(_START)) + seconds).alias("fetched_at"))


def page_entries(pages: DataFrame) -> DataFrame:
    patterns = pages.select(F.inline(url_patterns(F.col("url")))).distinct()
    number = F.conv(F.substring(F.md5("pattern"), 1, 8), 16, 10).cast("long")
    patterns = patterns.withColumn("number", number)

    def event(name, kind, modulus, rest, action, base, factor, days):
        day = F.lit(base) + F.floor(F.col("number") / 64) * factor % days
        chosen = (F.col("kind") == kind) & (F.col("number") % modulus == rest)
        return F.when(chosen, F.struct(
            F.lit(name).alias("list_name"), F.lit(action).alias("action"),
            F.timestamp_seconds(F.unix_timestamp(F.lit(_START)) + day * 86_400).alias("at")))

    events = F.array_compact(F.array(*[event(*e) for e in _EVENTS]))
    return patterns.select("kind", "pattern", F.inline(events)).select(
        "list_name", "kind", "pattern", "action", "at")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return _plain_times(filter_captures(page_captures(pages), page_entries(pages)))


def _plain_times(df: DataFrame) -> DataFrame:
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("fetched_at", "listed_since")}
    return df.withColumns(times)


_SQL_EVENTS = "\n  UNION ALL ".join(
    f"SELECT '{name}' AS list_name, kind, pattern, '{action}' AS action, "
    f"TIMESTAMP '{_START}' + to_days(CAST({base} + (number // 64) * {factor} % {days} AS INTEGER)) AS moment "
    f"FROM patterns WHERE kind = '{kind}' AND number % {modulus} = {rest}"
    for name, kind, modulus, rest, action, base, factor, days in _EVENTS
)
ORACLE_SQL = f"""
WITH captures AS (
  SELECT page_id, url,
         TIMESTAMP '{_START}' + to_seconds(CAST(page_id * 7919333 % {_SECONDS} AS INTEGER))
           AS fetched_at,
         rtrim(lower(regexp_extract(
           url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '.') AS host,
         [s FOR s IN string_split(regexp_extract(
           url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') IF s <> ''] AS steps
  FROM pages),
labels AS (SELECT *, string_split(host, '.') AS parts FROM captures),
candidates AS (
  SELECT page_id, url, fetched_at, 'host' AS kind, host AS pattern FROM labels
  UNION ALL
  SELECT page_id, url, fetched_at, 'domain', array_to_string(parts[i:], '.')
  FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM labels)
  UNION ALL
  SELECT page_id, url, fetched_at, 'prefix', host || '/' || array_to_string(steps[1:i], '/')
  FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM labels)),
patterns AS (
  SELECT DISTINCT kind, pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS number
  FROM candidates WHERE pattern <> ''),
entries AS (
  {_SQL_EVENTS}),
state AS (
  SELECT list_name, kind, pattern, moment, max(action) AS action FROM entries GROUP BY ALL),
latest AS (
  SELECT c.page_id, c.kind, c.pattern, s.list_name, max(s.moment) AS moment
  FROM candidates c JOIN state s
    ON s.kind = c.kind AND s.pattern = c.pattern AND s.moment <= c.fetched_at
  GROUP BY ALL),
hits AS (
  SELECT l.page_id, count(*) AS n_matches, min(l.list_name) AS first_list, min(l.moment) AS since
  FROM latest l JOIN state s USING (list_name, kind, pattern, moment)
  WHERE s.action = 'add' GROUP BY l.page_id)
SELECT c.page_id, c.url, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at,
       h.page_id IS NOT NULL AS blocked, coalesce(h.n_matches, 0)::BIGINT AS n_matches,
       h.first_list, strftime(h.since, '%Y-%m-%d %H:%M:%S') AS listed_since
FROM captures c LEFT JOIN hits h USING (page_id)
"""
