"""Keeping an expensive column from being computed more than once per row.

Spark moves a filter below the projection that computes its column and repeats the
whole expression there; an ``explode`` adds such a filter by itself. For columns that
hold dozens of patterns that doubles the work at best. A generator with one output row
is a place no filter on its output moves past.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, keep=None, **columns: Column) -> DataFrame:
    """``df`` with more columns, each of them evaluated one time per row."""
    record = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in (df.columns if keep is None else keep) if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(record)))


def exploded(df: DataFrame, keep, items: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array item, none for an empty array, without the added filter."""
    if pos is None:
        rows = df.select(*keep, F.explode_outer(items).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(items).alias(pos, name))
    return rows.filter(F.col(name).isNotNull())
