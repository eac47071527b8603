"""A reverse index of links, so that late threat entries find old scans without their texts.

The index has a row for each scan and distinct link, in buckets of the link. A batch of scans
adds its rows; a batch of threat entries is joined with the index alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitwatch.functions.findings import FINDINGS, finding, risk_level
from baitwatch.operators.enrich import distinct_urls, first_threats, threat_message
from baitwatch.plans.lookup import side_lookup
from baitwatch.registry import THREAT_POINTS

BUCKETS = 16


def add_links(
    scans: DataFrame, name: str, path: str, key: str = "id", text: str = "email_text",
    buckets: int = BUCKETS,
) -> None:
    """Adds the links of a batch of scans that are not indexed yet to the table ``name``."""
    rows = distinct_urls(scans, key, text).repartition(buckets, "url")
    rows.write.bucketBy(buckets, "url").sortBy("url").option("path", path).mode(
        "append").saveAsTable(name)


def indexed_hits(index: DataFrame, threat_list: DataFrame, key: str = "id") -> DataFrame:
    """What ``threat_hits`` finds in the texts, from the index: ``key, url, threat, ord, message``."""
    hits = side_lookup(index, first_threats(threat_list), ["url"])
    return hits.select(key, "url", "threat", "ord", threat_message().alias("message"))


def late_hits(
    index: DataFrame, known: DataFrame, late: DataFrame, key: str = "id"
) -> DataFrame:
    """Hits of the links that late entries name, over both lists; ``before`` is the message a
    hit had with the known entries alone, null where the link was not listed.

    Of the known list only entries of those links are used, and hits the late entries leave as
    they were are left out.
    """
    named = late.select("url").distinct()
    again = known.join(named, "url", "left_semi")
    old = first_threats(again).select(
        "url", F.col("ord").alias("_ord"), threat_message().alias("before"))
    new = first_threats(again.unionByName(late)).select(
        "url", "threat", "ord", threat_message().alias("message"))
    same = F.col("message").eqNullSafe(F.col("before")) & (F.col("ord") == F.col("_ord"))
    changed = new.join(old, "url", "left").filter(~same)
    return side_lookup(index, changed, ["url"]).select(
        key, "url", "threat", "ord", "message", "before")


def merged_hits(hits: DataFrame, late: DataFrame) -> DataFrame:
    """Earlier hits with those of ``late_hits`` in place of the ones of the same link."""
    links = late.select("url").distinct()
    return hits.join(links, "url", "left_anti").select(*hits.columns).unionByName(
        late.select(*hits.columns))


def merge_late_findings(scans: DataFrame, late: DataFrame) -> DataFrame:
    """Adds late hits to scans that were checked before, by ``id``.

    A link that was not listed adds a finding and points; a listed one has its message
    replaced where it stands. Scans that were not checked are left to the check that is due.
    """
    fresh = F.col("before").isNull()
    changes = late.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(fresh, F.struct("ord", "url", "message")))).alias("new"),
        F.map_from_entries(F.collect_set(F.when(
            ~fresh, F.struct("before", "message")))).alias("changed"))
    df = scans.join(changes, "id", "left")
    due = F.col("network_checked") & F.col("new").isNotNull()
    added = F.transform("new", lambda h: finding("safe_browsing", "link_manipulation", h["message"]))

    def now(message):
        return F.coalesce(F.try_element_at("changed", message), message)

    flags = F.concat(F.transform("flags", now), F.col("new.message"))
    found = F.concat(F.transform("findings", lambda f: f.withField("message", now(f["message"]))),
                     added.cast(FINDINGS))
    score = F.col("score") + THREAT_POINTS * F.size("new")
    df = df.withColumns({
        "flags": F.when(due, flags).otherwise(F.col("flags")),
        "findings": F.when(due, found).otherwise(F.col("findings")),
        "risk_level": F.when(due, risk_level(score)).otherwise(F.col("risk_level")),
        "score": F.when(due, score).otherwise(F.col("score")),
    })
    return df.select(*scans.columns)
