"""The stored scan table, laid out so that changes by id need not move its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Buckets of a small table; a large one has as many as its bytes ask for.
BUCKETS = 8


def store_scans(scans: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes ``scans`` as a table in buckets of its id, one sorted file each.

    Edits, deletions and link findings are joined by id. Only they are shuffled then, to
    the buckets; the scan rows with their texts are read where they are. ``buckets_for`` says
    how many buckets keep a file at a few hundred megabytes.
    """
    scans.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option(
        "path", path).saveAsTable(name)
    return scans.sparkSession.table(name)
