"""Labelled datasets and raw corpora as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("label", "email_text")
CORPUS_COLUMNS = ("label", "subject", "body")

# Quotes are doubled inside quoted fields, fields may hold line breaks and be of any
# length, and bytes that do not decode are replaced.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "maxCharsPerColumn": -1}


def _read(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.options(**CSV, sep=sep).csv(path)


def separator(path: str) -> str:
    if path.lower().endswith(".csv"):
        return ","
    if path.lower().endswith(".tsv"):
        return "\t"
    raise ValueError("Dataset must be a .csv or .tsv file.")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """``label, email_text`` and any other columns of a CSV or TSV file, all strings.

    A file with line breaks inside fields cannot be split, so land it as Parquet
    once before working on it at scale.
    """
    df = _read(spark, path, separator(path))
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        raise ValueError(f"{name} is missing required columns: {', '.join(missing)}")
    return df


def read_corpora(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``source, label, subject, body`` of several corpora; absent columns are NULL."""

    def one(source: str, path: str) -> DataFrame:
        df = _read(spark, path, separator(path))
        columns = [
            F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
            for c in CORPUS_COLUMNS
        ]
        return df.select(F.lit(source).alias("source"), *columns)

    return reduce(DataFrame.unionByName, [one(s, p) for s, p in paths.items()])


def write_labelled(df: DataFrame, path: str) -> DataFrame:
    """Writes the two columns as CSV and returns rows per label, read from the result."""
    df.select(*REQUIRED).write.options(header=True, quote='"', escape='"').csv(path)
    spark = df.sparkSession
    written = spark.read.options(**CSV).csv(path)
    return written.groupBy("label").agg(F.count("*").alias("n"))


def load_split(df: DataFrame, label: str) -> DataFrame:
    """Rows with exactly that label."""
    return df.filter(F.col("label") == label)


def write_results(results: DataFrame, path: str) -> None:
    results.write.json(path)
