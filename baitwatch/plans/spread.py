"""Parallelism for compute-heavy work on few input files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task is meant to get.
PART_BYTES = 8 << 20


def spread(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` over as many partitions as its text asks for, and at least over as many as
    ``spark.sql.shuffle.partitions`` says.

    Detection costs far more than moving a row, and a Parquet file with one row group
    is read by a single task. With more text there are more tasks, none is larger. A stream
    spreads its micro-batches itself.
    """
    if df.isStreaming:
        return df
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-size // PART_BYTES)), key)
