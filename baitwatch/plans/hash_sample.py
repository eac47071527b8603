"""Seeded samples as a distributed top-k over a hash.

A plain ``orderBy(hash).limit(n)`` passes ``n`` rows through one task, which is the table itself
where a sample is a share of it. Here counts by the first digits of the hash tell where the
last row of a sample is; the rows before it are then read where they are. The result is exactly
that of the plain form.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a hash, and those that are counted at a time.
HASH_DIGITS, DIGITS = 32, 3
#: Rows that are put in order to find the last one of a sample.
FEW = 10_000


def seeded_hash(seed, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def depth(digest: Column) -> Column:
    """Leading zero bits among the first 32, at most 31."""
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.lit(32) - F.length(F.bin(head))


def deepest(levels: DataFrame, n: int, groups: list[str]) -> DataFrame:
    """``_cut`` of each group: the greatest depth with ``n`` rows at it and beyond it together.

    ``levels`` holds ``depth, n`` for each group; one with fewer rows has no cut.
    """
    at_least = (
        levels.select(*groups, F.explode(F.sequence(F.lit(0), "depth")).alias("depth"), "n")
        .groupBy(*groups, "depth").agg(F.sum("n").alias("n"))
    )
    return at_least.filter(F.col("n") >= n).groupBy(*groups).agg(F.max("depth").alias("_cut"))


def cuts_of(keys: DataFrame, key: str, ranks: dict) -> dict:
    """``(hash, key)`` of the row at a rank, from one, in the order of ``_hash`` and key.

    ``ranks`` names ranks and their group, or null where there is one group only; ``keys`` holds
    ``_hash``, the key and the group as ``_group``. A rank beyond the rows has no entry. Rows are
    counted by the first digits of their hash, then by more digits where a rank falls, until few
    rows share them; only those are put in order, so the driver sees counts and no task all rows.
    """
    found = {}
    left = {name: (group, "", rank) for name, (group, rank) in ranks.items()}
    while left:
        length = len(next(iter(left.values()))[1]) + DIGITS
        within = reduce(or_, [
            F.col("_group").eqNullSafe(F.lit(g)) & F.col("_hash").startswith(head) for g, head, _ in left.values()])
        counts = keys.filter(within).groupBy("_group", F.substring("_hash", 1, length).alias("head")).count()
        counts = sorted(((r["_group"], r["head"], r["count"]) for r in counts.collect()), key=lambda r: r[1])
        for name, (group, head, rank) in list(left.items()):
            del left[name]
            for _, longer, n in (c for c in counts if c[0] == group and c[1].startswith(head)):
                if rank > n:
                    rank -= n
                    continue
                if n > FEW and length < HASH_DIGITS:
                    left[name] = group, longer, rank
                else:
                    own = F.col("_group").eqNullSafe(F.lit(group)) & F.col("_hash").startswith(longer)
                    last = keys.filter(own).orderBy("_hash", key).limit(rank).collect()[-1]
                    found[name] = last["_hash"], last[key]
                break
    return found


def up_to(key: str, cut: tuple) -> Column:
    """Whether a row is at a cut of ``cuts_of`` or before it."""
    digest, last = cut
    return (F.col("_hash") < digest) | ((F.col("_hash") == digest) & (F.col(key) <= F.lit(last)))


def ranked(hashed: DataFrame, key: str, ranks: list[int], group: str | None = None) -> DataFrame:
    """The rows up to the last of the ranks, by ``_hash`` and key, within their group if there is
    one; ``_part`` is the place of the first rank that is not before the row, from 0.

    One pass keeps hashes and keys, which find the cuts; a second one reads the rows up to
    them. No row is moved, so a sample may be any share of the table.
    """
    own = F.col(group) if group else F.lit(None).cast("string")
    keys = hashed.select("_hash", key, own.alias("_group")).filter(
        F.col("_hash").isNotNull()).persist(StorageLevel.DISK_ONLY)
    try:
        groups = [r["_group"] for r in keys.select("_group").distinct().collect()] if group else [None]
        cuts = cuts_of(keys, key, {
            (g, i): (g, n) for g in groups for i, n in enumerate(ranks) if n > 0})
    finally:
        keys.unpersist()
    part = F.lit(None).cast("int")
    for g in groups:
        of_group = F.when(F.lit(False), F.lit(0))
        for i, n in enumerate(ranks):
            inside = up_to(key, cuts[g, i]) if (g, i) in cuts else F.lit(n > 0)
            of_group = of_group.when(inside & F.col("_hash").isNotNull(), F.lit(i))
        part = F.when(own.eqNullSafe(F.lit(g)), of_group).otherwise(part)
    return hashed.withColumn("_part", part).filter(F.col("_part").isNotNull())


def smallest_by_hash(
    rows: DataFrame, n: int, seed, key: str, group: str | None = None
) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash of a unique key, hash in ``_hash``.

    With ``group``, which has few values, so many of each of them. The rows come in no order.
    """
    return ranked(rows.withColumn("_hash", seeded_hash(seed, key)), key, [n], group).drop("_part")
