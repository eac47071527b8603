"""Corpora: composing mail, pooling sources, samples and disjoint splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitwatch.functions.text import strip
from baitwatch.plans.hash_sample import ranked, seeded_hash, smallest_by_hash
from baitwatch.plans.once import once
from baitwatch.registry import (
    LEGITIMATE_CORPORA,
    MIXED_SAMPLE_ROWS,
    MIXED_SEED,
    PHISHING_CORPORA,
    SPLIT_ROWS_PER_CLASS,
    SPLIT_SEED,
)


def compose_mail(corpus: DataFrame) -> DataFrame:
    """Subject, blank line and body as ``email_text``; rows without text are dropped."""

    def part(name: str):
        return strip(F.coalesce(F.col(name), F.lit("")))

    text = strip(F.concat(part("subject"), F.lit("\n\n"), part("body")))
    kept = [c for c in corpus.columns if c not in ("subject", "body")]
    df = once(corpus, kept, email_text=text)
    return df.filter(F.col("email_text") != "")


def pool_labelled(corpus: DataFrame) -> DataFrame:
    """Rows of every corpus whose own label is ``0`` or ``1``, named by class."""
    kept = compose_mail(corpus.filter(F.col("label").isin("0", "1")))
    return kept.withColumn(
        "label", F.when(F.col("label") == "1", "phishing").otherwise("legitimate")
    )


def pool_focused(corpus: DataFrame) -> DataFrame:
    """All rows of the phishing corpora and the label-0 rows of the others."""
    phishing = F.col("source").isin(*PHISHING_CORPORA)
    legitimate = F.col("source").isin(*LEGITIMATE_CORPORA) & (F.col("label") == "0")
    kept = compose_mail(corpus.filter(phishing | legitimate))
    return kept.withColumn("label", F.when(phishing, "phishing").otherwise("legitimate"))


def mixed_sample(
    corpus: DataFrame, n: int = MIXED_SAMPLE_ROWS, seed: int = MIXED_SEED, key: str = "row_id"
) -> DataFrame:
    return smallest_by_hash(pool_labelled(corpus), n, seed, key).drop("_hash")


def focused_splits(
    corpus: DataFrame, per_class: int = SPLIT_ROWS_PER_CLASS, seed: int = SPLIT_SEED,
    key: str = "row_id",
) -> DataFrame:
    """Tuning and holdout rows, ``per_class`` of each class in each split.

    Both ends are found on hashes and keys; no text is sorted or moved.
    """
    pool = pool_focused(corpus).withColumn("_hash", seeded_hash(seed, key))
    picked = ranked(pool, key, [per_class, 2 * per_class], group="label")
    return picked.withColumn(
        "split", F.when(F.col("_part") == 0, "tuning").otherwise("holdout")
    ).drop("_hash", "_part")


def split_overlap(splits: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of each split and how many rows are in both, which has to be none."""
    rows = splits.groupBy(key).agg(
        F.max(F.when(F.col("split") == "tuning", 1).otherwise(0)).alias("t"),
        F.max(F.when(F.col("split") == "holdout", 1).otherwise(0)).alias("h"),
    )
    return rows.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("tuning_rows"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("holdout_rows"),
        F.coalesce(F.sum(F.col("t") * F.col("h")), F.lit(0)).alias("shared_rows"),
    )


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))
