"""Changes to the scan table.

Each function takes the table and a set of changes and returns the new table, to be
written as a new snapshot. Ids are unique, so the joins on them are even; several
changes to one id are reduced to one row before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitwatch.functions.findings import FINDINGS, finding, known_categories, risk_level
from baitwatch.functions.text import strip
from baitwatch.operators.detect import analyse_mail
from baitwatch.operators.validate import valid_mail
from baitwatch.registry import LONG_NOTE, MAX_NOTE_CHARS

SCAN_COLUMNS = (
    "id", "email_text", "flags", "findings", "score", "risk_level", "note", "created_at",
    "network_checked",
)


FEED_SPAN = 1 << 40


def scan_id(mail_id: str, feed: int) -> Column:
    """Id of a scan from its feed and its mail's number there, which is below ``FEED_SPAN``.

    Batch and stream use the same rule, so the order and number of runs never change an
    id, and feeds with numbers of their own never collide.
    """
    return F.col(mail_id) + F.lit(1 + feed * FEED_SPAN)


def new_scans(
    mail: DataFrame, received_at, feed: int = 1, max_chars: int | None = None
) -> DataFrame:
    """Valid mail of a feed scored as scan rows. ``quarantined_mail`` has the rest."""
    scored = analyse_mail(valid_mail(mail, max_chars))
    return scored.select(
        scan_id("mail_id", feed).alias("id"), "email_text", "flags", "findings", "score", "risk_level",
        F.lit("").alias("note"),
        F.date_trunc("minute", received_at).cast("timestamp_ntz").alias("created_at"),
        F.lit(False).alias("network_checked"),
    )


def append_scans(
    scans: DataFrame, mail: DataFrame, received_at, feed: int = 1, max_chars: int | None = None
) -> DataFrame:
    """The table with new mail of a feed appended; blank mail is never stored, and longer
    mail than ``max_chars`` only if no limit is set."""
    return scans.select(*SCAN_COLUMNS).unionByName(new_scans(mail, received_at, feed, max_chars))


def merge_link_findings(scans: DataFrame, checks: DataFrame) -> DataFrame:
    """Adds link findings and points to scans that were not checked before.

    ``checks(id, link_findings, points)`` only needs rows for scans with a hit. Every
    unchecked scan counts as checked afterwards, so a second merge changes nothing. Flags
    of a row that an older release stored without findings are kept, as findings too.
    """
    df = scans.join(checks.select("id", "link_findings", "points"), "id", "left")
    fresh = ~F.col("network_checked")
    hit = fresh & F.col("points").isNotNull()
    legacy = F.transform("flags", lambda s: finding("legacy", "informational", s))
    known = F.when(F.size("findings") > 0, F.col("findings")).otherwise(legacy.cast(FINDINGS))
    messages = F.col("link_findings.message")
    df = df.withColumns({
        "flags": F.when(hit, F.concat("flags", messages)).otherwise(F.col("flags")),
        "findings": F.when(hit, F.concat(known, "link_findings")).otherwise(F.col("findings")),
        "score": F.when(hit, F.col("score") + F.col("points")).otherwise(F.col("score")),
    })
    return df.withColumns({
        "risk_level": F.when(fresh, risk_level(F.col("score"))).otherwise(F.col("risk_level")),
        "network_checked": F.lit(True),
    }).select(*SCAN_COLUMNS)


def check_notes(edits: DataFrame) -> DataFrame:
    """Edits with stripped notes and an ``error``, NULL when the note is fine."""
    df = edits.withColumn("note", F.coalesce(strip(F.col("note")), F.lit("")))
    return df.withColumn("error", F.when(F.length("note") > MAX_NOTE_CHARS, LONG_NOTE))


def update_notes(scans: DataFrame, edits: DataFrame) -> DataFrame:
    """Replaces notes by the last valid edit of each id, in order of ``seq``."""
    last = check_notes(edits).filter(F.col("error").isNull()).groupBy("id").agg(
        F.max_by("note", "seq").alias("_note")
    )
    df = scans.join(last, "id", "left")
    return df.withColumn("note", F.coalesce("_note", "note")).select(*scans.columns)


def rejected_notes(scans: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that were not applied: unknown id, or a note that is too long."""
    known = scans.select("id", F.lit(True).alias("_known"))
    df = check_notes(edits).join(known, "id", "left")
    error = F.when(F.col("_known").isNull(), "Scan not found").otherwise(F.col("error"))
    return df.select("id", "seq", error.alias("error")).filter(F.col("error").isNotNull())


def delete_scans(scans: DataFrame, requests: DataFrame) -> DataFrame:
    return scans.join(requests.select("id"), "id", "left_anti")


def missing_deletes(scans: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested ids that no scan has."""
    return requests.select("id").distinct().join(scans.select("id"), "id", "left_anti")


def evolve_schema(old: DataFrame) -> DataFrame:
    """Adds the columns an older table lacks; its rows stay as they are."""
    added = {
        "findings": F.lit("[]"), "network_checked": F.lit(0),
    }
    return old.withColumns({k: v for k, v in added.items() if k not in old.columns})


def restore_findings(old: DataFrame) -> DataFrame:
    """Text ``flags`` and JSON ``findings`` of a stored row as arrays.

    Broken or missing JSON counts as no findings and unknown categories are left
    out. When nothing remains, every stored flag line becomes an informational
    finding.
    """
    read = F.coalesce(F.from_json("findings", FINDINGS), F.array().cast(FINDINGS))
    known = F.filter(read, lambda f: F.array_contains(known_categories(), f["category"]))
    parsed = F.transform(known, lambda f: finding(
        F.coalesce(f["rule"], F.lit("")), f["category"], f["message"],
        F.coalesce(f["match"], F.lit("")),
    ))
    lines = F.filter(F.split(F.coalesce("flags", F.lit("")), "\n"), lambda s: s != "")
    legacy = F.transform(lines, lambda s: finding("legacy", "informational", s))
    df = old.withColumn("_parsed", parsed)
    df = df.withColumn("findings", F.when(F.size("_parsed") > 0, F.col("_parsed"))
                       .otherwise(legacy).cast(FINDINGS))
    return df.withColumns({
        "flags": lines, "network_checked": F.col("network_checked").cast("boolean"),
    }).drop("_parsed")
