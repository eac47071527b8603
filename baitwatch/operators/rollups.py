"""Totals that follow the scan table without counting it again.

A change is kept as a small histogram of signed counts: what it adds, and with a minus what it
takes back. Each batch of changes is a folder of its own that a repeated run replaces, so
none counts twice; the totals are the sums over all folders. Changes carry ids and numbers
only, so no text is read for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.functions.findings import risk_level

SCAN_KEYS = ("risk_level", "score")
LABELLED_KEYS = ("actual", "risk_level", "score")


def counted(rows: DataFrame, keys: tuple[str, ...] = SCAN_KEYS, sign: int = 1) -> DataFrame:
    """Histogram of some rows, to be added (1) or taken back (-1)."""
    return rows.groupBy(*keys).agg((F.count("*") * sign).alias("n"))


def summed(*deltas: DataFrame) -> DataFrame:
    """Several deltas as one; what they add and take back cancels out."""
    keys = [c for c in deltas[0].columns if c != "n"]
    both = reduce(DataFrame.unionByName, deltas)
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def append_delta(new: DataFrame, keys: tuple[str, ...] = SCAN_KEYS) -> DataFrame:
    return counted(new, keys)


def delete_delta(
    rows: DataFrame, requests: DataFrame, keys: tuple[str, ...] = SCAN_KEYS, key: str = "id"
) -> DataFrame:
    """Takes back the rows a deletion removes; ids asked for twice or unknown do no harm."""
    gone = rows.select(key, *keys).join(requests.select(key), key, "left_semi")
    return counted(gone, keys, -1)


def change_delta(
    rows: DataFrame, changes: DataFrame, after: dict[str, Column],
    keys: tuple[str, ...] = SCAN_KEYS, key: str = "id",
) -> DataFrame:
    """Takes back rows as they were and adds them as they become.

    ``changes`` is unique by ``key``; ``after`` computes what changes from the columns of both.
    Both counts come from one pass over the rows that change.
    """
    new = [after.get(k, F.col(k)).alias(k) for k in keys]
    ends = F.array(F.struct(*new, F.lit(1).alias("sign")),
                   F.struct(*[F.col(k) for k in keys], F.lit(-1).alias("sign")))
    signed = rows.join(changes, key).select(F.inline(ends))
    return signed.groupBy(*keys).agg(F.sum("sign").alias("n")).filter(F.col("n") != 0)


def link_delta(scans: DataFrame, checks: DataFrame) -> DataFrame:
    """What ``merge_link_findings`` changes: points for scans that were not checked before."""
    rows = scans.filter(~F.col("network_checked")).select("id", *SCAN_KEYS)
    points = checks.filter(F.col("points").isNotNull()).select("id", "points")
    score = F.col("score") + F.col("points")
    return change_delta(rows, points, {"score": score, "risk_level": risk_level(score)})


def store_delta(delta: DataFrame, path: str, batch: int) -> None:
    """Stores a batch; one that runs again replaces what it stored before."""
    delta.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def standing(spark: SparkSession, path: str) -> DataFrame:
    """The histogram as it stands after all batches."""
    return summed(spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch"))


def compacted(spark: SparkSession, path: str, to: str, last: int) -> None:
    """All batches as one below another path, numbered like the last of them."""
    store_delta(standing(spark, path), to, last)


def risk_totals_of(histogram: DataFrame) -> DataFrame:
    """``risk_totals`` from a histogram."""
    return histogram.rollup("risk_level").agg(F.sum("n").alias("scans")).select(
        F.coalesce("risk_level", F.lit("all")).alias("risk_level"),
        F.coalesce("scans", F.lit(0)).alias("scans"))
