"""Splits that keep copies together, and samples that grow with their corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baitwatch.operators.corpus import pool_focused, pool_labelled
from baitwatch.plans.hash_sample import deepest, depth, ranked, seeded_hash, smallest_by_hash
from baitwatch.registry import (
    MIXED_SAMPLE_ROWS,
    MIXED_SEED,
    SPLIT_ROWS_PER_CLASS,
    SPLIT_SEED,
)

#: What bulk mail changes from copy to copy.
COPY_NOISE = r"[0-9 \t\r\n]+"


def copy_key(text: Column) -> Column:
    """Equal for texts that differ in digits and white space only."""
    return F.md5(F.regexp_replace(text, COPY_NOISE, ""))


def grouped_splits(
    rows: DataFrame, group: str, target: int, seed, label: str = "label"
) -> DataFrame:
    """The rows of the groups drawn for ``tuning`` or ``holdout``, in a column ``split``.

    Groups are taken whole, in the order of a seeded hash, until a split has ``target`` rows
    of a label; so it has less than one group more. A group is in neither split if it
    holds rows of two labels, which no evaluation can score, or more rows than the
    target. Groups of any size are only counted; the window sees those near the smallest
    hashes, and the texts of all others are never shuffled.
    """
    groups = rows.groupBy(group).agg(
        F.min(label).alias(label), F.max(label).alias("_other"),
        F.count(label).alias("_labelled"), F.count("*").alias("_rows"))
    one_label = (F.col(label) == F.col("_other")) & (F.col("_labelled") == F.col("_rows"))
    groups = groups.filter(one_label & (F.col("_rows") <= target)).select(
        group, label, "_rows", seeded_hash(seed, group).alias("_hash"))
    own = depth(F.col("_hash"))
    levels = groups.groupBy(label, own.alias("depth")).agg(F.sum("_rows").alias("n"))
    # Each split ends with a group that is at most as large as its target.
    cuts = deepest(levels, 4 * target, [label])
    low = F.coalesce("_cut", F.lit(0))
    few = groups.join(cuts, label, "left").filter(own >= low)

    by_label = Window.partitionBy(label)
    in_order = by_label.orderBy("_hash", group).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    few = few.withColumn("_before", F.sum("_rows").over(in_order) - F.col("_rows"))
    tuning = F.col("_before") < target
    end = F.max(F.when(tuning, F.col("_before") + F.col("_rows"))).over(by_label)
    few = few.withColumn("split", F.when(tuning, "tuning").when(
        F.col("_before") - end < target, "holdout"))
    drawn = few.filter(F.col("split").isNotNull()).select(group, "split")

    near = rows.withColumn("_depth", depth(seeded_hash(seed, group)))
    near = near.join(cuts, label, "left").filter(F.col("_depth") >= low).drop("_depth", "_cut")
    return near.join(drawn, group)


def copy_splits(
    corpus: DataFrame, per_class: int = SPLIT_ROWS_PER_CLASS, seed: int = SPLIT_SEED
) -> DataFrame:
    """Tuning and holdout rows of which no text, numbers aside, is in both splits."""
    pool = pool_focused(corpus)
    return grouped_splits(
        pool.withColumn("copy", copy_key(F.col("email_text"))), "copy", per_class, seed)


def copies_in_both(splits: DataFrame, group: str = "copy") -> DataFrame:
    """Rows and groups of each split and label, and the groups in both, which has to be none."""
    seen = splits.groupBy("label", group).agg(
        F.count_if(F.col("split") == "tuning").alias("t"),
        F.count_if(F.col("split") == "holdout").alias("h"))
    return seen.groupBy("label").agg(
        F.sum("t").alias("tuning_rows"), F.sum("h").alias("holdout_rows"),
        F.count_if(F.col("t") > 0).alias("tuning_texts"),
        F.count_if(F.col("h") > 0).alias("holdout_texts"),
        F.count_if((F.col("t") > 0) & (F.col("h") > 0)).alias("shared_texts"))


def sample_state(
    corpus: DataFrame, n: int = MIXED_SAMPLE_ROWS, seed: int = MIXED_SEED, key: str = "row_id"
) -> DataFrame:
    """The rows of one corpus file that a sample of ``n`` may hold, with ``_hash``.

    That is its own sample, so it is all that ever has to be kept of the file.
    """
    return smallest_by_hash(pool_labelled(corpus), n, seed, key)


def merged_state(*states: DataFrame, n: int = MIXED_SAMPLE_ROWS, key: str = "row_id") -> DataFrame:
    """The state of several files together, from their states alone, in any order.

    It equals the state of the files read as one: a row among the ``n`` smallest hashes of
    all is among those of its file. Each state has at most ``n`` rows.
    """
    rows = states[0]
    for state in states[1:]:
        rows = rows.unionByName(state)
    return ranked(rows, key, [n]).drop("_part")
