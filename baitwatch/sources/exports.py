"""Scan history as CSV and JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitwatch.functions.findings import label_of
from baitwatch.functions.text import minute


def flat_export(scans: DataFrame) -> DataFrame:
    """All scans, newest first, with flags on one line."""
    return scans.select(
        "id", minute(F.col("created_at")).alias("created_at"), "risk_level", "score",
        F.coalesce("note", F.lit("")).alias("note"),
        F.array_join("flags", " | ").alias("flags"), "email_text",
    ).orderBy(F.desc("id"))


def nested_export(scans: DataFrame) -> DataFrame:
    """All scans, newest first, with category, label and message of every finding."""
    findings = F.transform("findings", lambda f: F.struct(
        f["category"].alias("category"), label_of(f["category"]).alias("category_label"),
        f["message"].alias("message"),
    ))
    return scans.select(
        "id", minute(F.col("created_at")).alias("created_at"), "risk_level", "score",
        F.coalesce("note", F.lit("")).alias("note"), "email_text", findings.alias("findings"),
    ).orderBy(F.desc("id"))


def export_csv(scans: DataFrame, path: str) -> None:
    flat_export(scans).write.options(header=True, quote='"', escape='"').csv(path)


def export_json(scans: DataFrame, path: str) -> None:
    """One JSON object a line instead of one array, so the file can be split."""
    nested_export(scans).write.json(path)
