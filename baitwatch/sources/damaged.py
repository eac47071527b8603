"""Labelled files with damaged rows: each row is read, counted and kept, none is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.sources.datasets import CSV, REQUIRED, separator

RAGGED, UNDECODABLE = "ragged", "undecodable"
_RECORD = "_record"
#: What a reader puts in place of bytes that are no text.
_REPLACED = "�"


def read_checked(
    spark: SparkSession, path: str, columns: tuple[str, ...] | None = None
) -> DataFrame:
    """All rows of a CSV or TSV file or folder, with ``problem``, ``record`` and ``file``.

    ``problem`` is null for a sound row, ``ragged`` where a row has more or fewer fields than
    the header, ``undecodable`` where bytes had to be replaced. ``record`` is the row of a
    ragged one as it was read. Files without a header have their ``columns`` named.
    """
    reader = spark.read.options(**CSV | {"header": columns is None}, sep=separator(path))
    names = list(columns) if columns else reader.csv(path).columns
    missing = sorted(set(REQUIRED) - set(names))
    if missing:
        raise ValueError(f"{path} is missing required columns: {', '.join(missing)}")
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, _RECORD])
    # Header names are taken from the schema, and a file whose own differ is not refused.
    df = reader.options(columnNameOfCorruptRecord=_RECORD, enforceSchema=True).schema(quoted).csv(path)
    replaced = F.lit(False)
    for name in names:
        replaced = replaced | F.coalesce(_field(name).contains(_REPLACED), F.lit(False))
    problem = F.when(F.col(_RECORD).isNotNull(), RAGGED).when(replaced, UNDECODABLE)
    return df.select(
        *[_field(n) for n in names], problem.alias("problem"), F.col(_RECORD).alias("record"),
        F.col("_metadata.file_path").alias("file"))


def _field(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def sound_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("problem").isNull()).drop("problem", "record", "file")


def quarantine(checked: DataFrame, path: str) -> None:
    """Writes the damaged rows to a folder per problem, with the file each came from."""
    checked.filter(F.col("problem").isNotNull()).write.partitionBy("problem").parquet(path)


def damage(checked: DataFrame) -> DataFrame:
    """Rows per file, sound ones and those with each problem."""
    return checked.groupBy("file").agg(
        F.count("*").alias("rows"), F.count_if(F.col("problem").isNull()).alias("sound"),
        F.count_if(F.col("problem") == RAGGED).alias("ragged"),
        F.count_if(F.col("problem") == UNDECODABLE).alias("undecodable"))
