"""Reading the scan table: search, pages, totals and views of the findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitwatch.functions.findings import weight_of
from baitwatch.plans.once import exploded
from baitwatch.registry import CATEGORIES, HISTORY_PAGE, METER_SEGMENTS, RISK_LEVELS


def _like(query: str, literal: bool) -> str:
    """Regex for ``LIKE '%query%'`` that ignores the case of ASCII letters only."""
    if literal:
        return "(?is)" + re.escape(query)
    parts = [{"%": ".*", "_": "."}.get(c) or re.escape(c) for c in query]
    return "(?is)" + "".join(parts)


def search_scans(scans: DataFrame, query: str | None, literal: bool = False) -> DataFrame:
    """Scans whose text, note or flags contain ``query``.

    ``%`` and ``_`` in the query are wildcards unless ``literal`` is set.
    """
    query = (query or "").strip()
    if not query:
        return scans
    pattern = _like(query, literal)
    flags = F.array_join("flags", "\n")
    return scans.filter(
        F.col("email_text").rlike(pattern) | F.col("note").rlike(pattern) | flags.rlike(pattern)
    )


def filter_risk(scans: DataFrame, level: str | None) -> DataFrame:
    """Scans of one level; an unknown level filters nothing."""
    return scans.filter(F.col("risk_level") == level) if level in RISK_LEVELS else scans


def scan_by_id(scans: DataFrame, scan_id: int) -> DataFrame:
    return scans.filter(F.col("id") == scan_id)


def newest(scans: DataFrame, n: int = HISTORY_PAGE) -> DataFrame:
    """The ``n`` rows with the highest id.

    For a stored table the cut is found on the id column alone; the wide rows are read for
    ids from there on, which Parquet prunes by row group.
    """
    top = scans.select("id").orderBy(F.desc("id")).limit(n)
    cut = top.select(F.min("id")).scalar()
    return scans.filter(F.col("id") >= cut).orderBy(F.desc("id")).limit(n)


def history_page(
    scans: DataFrame, query: str | None = None, level: str | None = None, n: int = HISTORY_PAGE,
    literal: bool = False,
) -> DataFrame:
    """The newest scans that match. A search reads the text anyway, so with one the rows
    are found in a single pass that keeps ``n`` of them per task."""
    found = filter_risk(search_scans(scans, query, literal), level)
    if (query or "").strip():
        return found.orderBy(F.desc("id")).limit(n)
    return newest(found, n)


def risk_totals(scans: DataFrame) -> DataFrame:
    """Scans per risk level and over all levels (``all``), whatever is searched for."""
    return scans.rollup("risk_level").agg(F.count("*").alias("scans")).select(
        F.coalesce("risk_level", F.lit("all")).alias("risk_level"), "scans"
    )


def _shorten(text: Column, length: int) -> Column:
    """Cut to ``length`` with an ellipsis; up to five characters more stay as they are."""
    return F.when(F.length(text) <= length + 5, text).otherwise(
        F.concat(F.substring(text, 1, length - 1), F.lit("…"))
    )


def history_preview(scans: DataFrame) -> DataFrame:
    """What a history list shows of each scan."""
    text, note = F.col("email_text"), F.coalesce("note", F.lit(""))
    return scans.select(
        "id",
        _shorten(F.replace(text, F.lit("\n"), F.lit(" ")), 90).alias("preview"),
        F.substring(text, 1, 300).alias("title"),
        F.when(note == "", "No note").otherwise(_shorten(note, 60)).alias("note"),
        "risk_level", "score",
        F.greatest(F.lit(0), F.least("score", F.lit(METER_SEGMENTS))).alias("meter"),
    )


def scored_categories(scans: DataFrame, key: str = "mail_id") -> DataFrame:
    """Scoring categories of each row, highest weight first, then by name."""
    found = F.array_distinct(F.col("findings.category"))
    ranked = F.array_sort(F.transform(
        found, lambda c: F.struct((-weight_of(c)).alias("w"), c.alias("key"))
    ))
    scoring = F.filter(ranked, lambda c: c["w"] < 0)
    return scans.select(key, scoring["key"].alias("categories"))


def grouped_findings(scans: DataFrame, key: str = "mail_id") -> DataFrame:
    """One row per scan and category with its messages; ``place`` orders the groups."""
    found = F.array_distinct(F.col("findings.category"))
    ranked = F.array_sort(F.transform(
        found, lambda c: F.struct((-weight_of(c)).alias("w"), c.alias("key"))
    ))
    rows = exploded(scans, [key, "findings"], ranked, "c", "place")
    messages = F.filter("findings", lambda f: f["category"] == F.col("c.key"))["message"]
    return rows.select(
        key, (F.col("place") + 1).alias("place"), F.col("c.key").alias("category"),
        (-F.col("c.w")).alias("weight"), messages.alias("messages"),
    )


def category_listing(scored: DataFrame) -> DataFrame:
    """Scoring categories by weight and label, with the rows each one fired on."""
    rows = F.array(*[
        F.struct(F.lit(c.key).alias("category"), F.lit(c.label).alias("label"),
                 F.lit(c.weight).alias("weight"), F.lit(c.advice).alias("advice"),
                 F.col(f"n_{c.key}").alias("mails"))
        for c in CATEGORIES if c.weight
    ])
    counts = scored.select(F.col("findings.category").alias("found")).agg(*[
        F.count_if(F.array_contains("found", c.key)).alias(f"n_{c.key}")
        for c in CATEGORIES if c.weight
    ])
    return counts.select(F.explode(rows).alias("r")).select("r.*").orderBy(
        F.desc("weight"), "label"
    )
