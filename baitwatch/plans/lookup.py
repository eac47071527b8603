"""Lookup of side facts for a column whose values may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame


def side_lookup(facts: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of many ``facts`` with a side table that is unique by ``keys``.

    One link can appear in a third of all mail. Adaptive execution sees the size of each
    shuffled partition and splits one that a hot key makes large over several tasks, which
    read the one matching row of the side table each; the cut follows from the size, so no
    number of splits has to be chosen. The side table is joined as it is: Spark broadcasts
    it only when its own size allows that, and no hint forces it to.
    """
    return facts.join(side, keys)
