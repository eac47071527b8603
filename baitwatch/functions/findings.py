"""The finding record and small helpers around arrays of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from baitwatch.functions.text import sql_array, sql_text
from baitwatch.registry import (
    CATEGORIES,
    DANGEROUS,
    DANGEROUS_FROM,
    LABELS,
    SAFE,
    SUSPICIOUS,
    SUSPICIOUS_FROM,
    WEIGHTS,
)

FINDING = "struct<rule:string,category:string,message:string,match:string>"
FINDINGS = f"array<{FINDING}>"


def finding(rule, category, message: Column, match=None) -> Column:
    def col(value):
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        col(rule).alias("rule"),
        col(category).alias("category"),
        message.alias("message"),
        (F.lit("") if match is None else match).alias("match"),
    )


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def present(*candidates: Column) -> Column:
    """Those of the candidate findings that are not NULL, in order."""
    return F.filter(F.array(*candidates), lambda f: f.isNotNull())


def score(fired: Callable[[str], str]) -> Column:
    """Sum of the weights of the categories for which the SQL of ``fired`` holds."""
    return F.expr(" + ".join(
        f"CASE WHEN {fired(key)} THEN {weight} ELSE 0 END"
        for key, weight in WEIGHTS.items() if weight
    ))


def score_of(findings: str) -> Column:
    """Score of an array of findings: each distinct category counts once."""
    return score(lambda key: f"array_contains({findings}.category, '{key}')")


def risk_level(points: Column) -> Column:
    return (
        F.when(points < SUSPICIOUS_FROM, SAFE)
        .when(points < DANGEROUS_FROM, SUSPICIOUS)
        .otherwise(DANGEROUS)
    )


def weight_of(category: Column) -> Column:
    return _lookup(category, WEIGHTS)


def label_of(category: Column) -> Column:
    return _lookup(category, LABELS)


def _lookup(key: Column, values: dict) -> Column:
    pairs = ", ".join(
        f"{sql_text(k)}, {sql_text(v) if isinstance(v, str) else v}" for k, v in values.items()
    )
    return F.element_at(F.expr(f"map({pairs})"), key)


def known_categories() -> Column:
    return F.expr(sql_array(c.key for c in CATEGORIES))
