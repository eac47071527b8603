"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from baitwatch.plans.session import work_folder

#: Characters of text that an operator looks at together inside a task.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> str:
    """``df`` computed once, as a table in the shared folder that every executor sees; where
    it is."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as it was ``stored``.

    A lost executor loses nothing of it, and everything behind it has a short lineage.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def map_batches(
    df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str
) -> DataFrame:
    """``fn`` over Arrow batches of some columns; it yields dicts of lists, a row per item.

    Spark bounds a batch by rows and bytes, so a task holds one batch at a time.
    """
    types = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    yield pa.RecordBatch.from_pydict(out, schema=types)

    return df.select(*columns).mapInArrow(run, schema)


def filter_batches(
    df: DataFrame, text: str, keep: Callable[[list[str | None]], list[bool]]
) -> DataFrame:
    """The rows whose text passes ``keep``, with all their columns as they are.

    Columns go by position, so names that occur twice do no harm.
    """
    at = df.columns.index(text)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, schema)


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[range]:
    """Row ranges of a batch with about ``chars`` characters each, one row at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def fold(key: str, parts: int):
    """Remainder of the CRC-32 of a key written as text; null counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")),
                  F.lit(parts))


def fold_of(key, parts: int) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % parts


def sample_by_hash(rows: DataFrame, key: str, limit: int, seed: int = 17) -> DataFrame:
    """About ``limit`` rows, those with the smallest hash of the key; all if there are fewer.

    The cut is found on the key column alone. Rows with one key stay or go together, so
    repeated keys can add rows; the reader bounds them again.
    """
    digest = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    cut = (
        rows.select(digest.alias("_h")).orderBy("_h").limit(limit).agg(F.max("_h")).first()[0]
    )
    return rows.filter(digest <= F.lit(cut)) if cut is not None else rows.filter(F.lit(False))


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))
