"""Snapshots of the scan table of which a change rewrites only the buckets it touches.

Rows lie in buckets of their id, a folder each. A snapshot is a small table, written last,
that names the folder of every bucket; a change writes new folders for the buckets it touches
and a snapshot that names those and, for all others, the folders there are. A run that fails
leaves the snapshot before it as the latest one, and readers of an older one see it unchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a bucket is meant to hold.
BUCKET_BYTES = 256 << 20
_MANIFEST = "bucket int, folder string, buckets int"


def buckets_for(rows: DataFrame, text: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """So many buckets that each holds about ``bucket_bytes`` of text."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-size // bucket_bytes))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, buckets: int, key: str = "id") -> None:
    """The first snapshot of a table below ``path``."""
    folder = _write(rows, path, buckets, key)
    _commit(rows.sparkSession, path, 0, buckets, _found(rows.sparkSession, folder))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The snapshots there are; one that was not finished is not among them."""
    rows = spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{path}/snapshots")
    return sorted(r.version for r in rows.select("version").distinct().collect())


def _entries(spark: SparkSession, path: str, version: int) -> list:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/snapshots/version={version}").collect()


def read(
    spark: SparkSession, path: str, version: int | None = None, buckets: set[int] | None = None
) -> DataFrame:
    """The rows of a snapshot, the latest one by default, or of some of its buckets."""
    version = versions(spark, path)[-1] if version is None else version
    found = _entries(spark, path, version)
    folders = [r.folder for r in found if r.bucket >= 0 and (buckets is None or r.bucket in buckets)]
    schema = spark.read.parquet(next(r.folder for r in found if r.bucket < 0)).schema
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def rewrite(
    spark: SparkSession, path: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame],
    key: str = "id",
) -> int:
    """Applies ``change`` to the buckets of ``ids`` and returns the new snapshot's number.

    ``change`` gets the rows of those buckets and may replace, drop or add rows whose ids are
    among ``ids``. The driver learns which buckets are touched, never ids. Where two
    changes start from one snapshot, the second to finish fails.
    """
    version = versions(spark, path)[-1]
    found = _entries(spark, path, version)
    buckets = found[0].buckets
    touched = {r.bucket for r in ids.select(
        bucket_of(F.col(key), buckets).alias("bucket")).distinct().collect()}
    rows = read(spark, path, version, touched)
    folder = _write(change(rows).select(*rows.columns), path, buckets, key)
    new = _found(spark, folder)
    kept = [(r.bucket, r.folder) for r in found if r.bucket >= 0 and r.bucket not in touched]
    _commit(spark, path, version + 1, buckets, kept + new)
    return version + 1


def _write(rows: DataFrame, path: str, buckets: int, key: str) -> str:
    """Rows in a folder per bucket, sorted by key, and an empty table that keeps their schema."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    placed = rows.withColumn("bucket", bucket_of(F.col(key), buckets))
    parts = max(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed.repartition(parts, "bucket").sortWithinPartitions("bucket", key).write.partitionBy(
        "bucket").parquet(f"{folder}/rows")
    rows.limit(0).write.parquet(f"{folder}/schema")
    return folder


def _found(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """The buckets a write filled; -1 stands for the schema."""
    rows = spark.read.schema("bucket int").parquet(f"{folder}/rows")
    filled = [r.bucket for r in rows.select("bucket").distinct().collect()]
    return [(-1, f"{folder}/schema"), *((b, f"{folder}/rows/bucket={b}") for b in sorted(filled))]


def _commit(spark: SparkSession, path: str, version: int, buckets: int, entries: list) -> None:
    rows = spark.createDataFrame([(b, f, buckets) for b, f in entries], _MANIFEST)
    rows.coalesce(1).write.parquet(f"{path}/snapshots/version={version}")
