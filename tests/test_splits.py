"""Splits that keep copies together and samples merged from states."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from baitwatch.operators import corpus, splits
from baitwatch.plans import hash_sample
from baitwatch.plans.hash_sample import ranked, seeded_hash, smallest_by_hash


def pool(spark):
    """Groups of one to nine copies, one with two labels and one larger than any split."""
    draw = random.Random(2)
    rows = []
    for group in range(300):
        label = draw.choice(("phishing", "legitimate"))
        rows += [(f"g{group}", label)] * draw.randrange(1, 10)
    rows += [("mixed", "phishing"), ("mixed", "legitimate"), ("half", None), ("half", "phishing")]
    rows += [("huge", "phishing")] * 400
    rows = [(i, *r) for i, r in enumerate(rows)]
    return rows, spark.createDataFrame(rows, "row_id long, copy string, label string")


def plain_splits(rows, target, seed):
    labels, sizes = defaultdict(set), defaultdict(int)
    for _, copy, label in rows:
        labels[copy].add(label)
        sizes[copy] += 1
    found = {}
    for label in ("phishing", "legitimate"):
        own = [c for c in sizes if labels[c] == {label} and sizes[c] <= target]
        own.sort(key=lambda c: (hashlib.md5(f"{seed}:{c}".encode()).hexdigest(), c))
        for split in ("tuning", "holdout"):
            taken = 0
            while own and taken < target:
                found[own[0]] = split
                taken += sizes[own.pop(0)]
    return {(i, found[c]) for i, c, _ in rows if c in found}


@pytest.mark.parametrize("target", [1, 7, 60, 10_000])
def test_groups_are_drawn_whole(spark, target):
    rows, df = pool(spark)
    got = splits.grouped_splits(df, "copy", target, 5).collect()
    assert {(r.row_id, r.split) for r in got} == plain_splits(rows, target, 5)
    assert len(got) == len({r.row_id for r in got})
    split_of = defaultdict(set)
    for r in got:
        split_of[r.copy].add(r.split)
    assert all(len(s) == 1 for s in split_of.values())
    assert not {"mixed", "half"} & set(split_of) and ("huge" in split_of) == (target > 400)
    if target == 60:
        for label in ("phishing", "legitimate"):
            for split in ("tuning", "holdout"):
                assert 60 <= sum(r.label == label and r.split == split for r in got) < 70


def test_texts_that_differ_in_numbers_are_copies(spark):
    df = spark.createDataFrame(
        [("Notice 17\n\npay now",), ("Notice 9 \n pay\tnow",), ("Notice pay later",)], "t string")
    keys = [r.k for r in df.select(splits.copy_key(F.col("t")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_only_few_texts_are_shuffled(spark):
    """Rows are cut by the hash of their group before they meet the groups drawn."""
    _, df = pool(spark)
    wide = df.withColumn("text", F.lit("x"))
    plan = splits.grouped_splits(wide, "copy", 7, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "_depth" in plan or "conv(" in plan


def test_empty_pool(spark):
    _, df = pool(spark)
    assert splits.grouped_splits(df.limit(0), "copy", 5, 1).collect() == []


def test_states_merge_to_the_sample_of_all_files(spark):
    draw = random.Random(4)
    rows = [(i, f"file{i % 5}", draw.choice(("0", "1", "2", None)), "s", f"body {i}")
            for i in range(600)]
    raw = spark.createDataFrame(
        rows, "row_id long, source string, label string, subject string, body string")
    want = {r.row_id for r in smallest_by_hash(splits.pool_labelled(raw), 50, 9, "row_id").collect()}
    states = [splits.sample_state(raw.filter(F.col("source") == f"file{i}"), 50, 9) for i in range(5)]
    assert {r.row_id for r in splits.merged_state(*states, n=50).collect()} == want
    grown = splits.merged_state(*states[3:], n=50)
    for state in states[:3]:  # one file after the other, in another order
        grown = splits.merged_state(grown, state, n=50)
    assert {r.row_id for r in grown.collect()} == want and len(want) == 50


def raw_rows(spark, n):
    rows = [(i, ("Enron", "Nazario", "CEAS_08")[i % 3], "01"[i % 2], "s", f"body {i}") for i in range(n)]
    return spark.createDataFrame(
        rows, "row_id long, source string, label string, subject string, body string")


@pytest.mark.parametrize("sample", [
    lambda raw: splits.merged_state(
        splits.sample_state(raw.filter("row_id < 400"), 200, 9),
        splits.sample_state(raw.filter("row_id >= 400"), 200, 9), n=200),
    lambda raw: corpus.mixed_sample(raw, 200, 9),
    lambda raw: corpus.focused_splits(raw, 60, 9),
])
def test_no_task_gets_a_whole_sample(spark, sample):
    """A sample may be a fourth of the table, so its rows are read where they are."""
    plan = sample(raw_rows(spark, 800))._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Limit", "TakeOrdered", "Sort", "Window", "SinglePartition"))


@pytest.mark.parametrize("few, digits", [(1, 1), (5, 3), (10_000, 3)])
def test_ranks_are_those_of_the_plain_order(spark, monkeypatch, few, digits):
    monkeypatch.setattr(hash_sample, "FEW", few)
    monkeypatch.setattr(hash_sample, "DIGITS", digits)
    rows = [(i, "ab"[i % 7 < 2], f"k{i}") for i in range(500)] + [(None, "a", None)]
    df = spark.createDataFrame(rows, "i long, label string, k string").withColumn("_hash", seeded_hash(3, "k"))
    # Rows of one hash, of which a rank may take some.
    one = F.when(F.col("i").between(100, 160), F.lit("7" * 32)).otherwise(F.col("_hash"))
    df = df.withColumn("_hash", one)
    order = sorted((r for r in df.collect() if r.k), key=lambda r: (r["_hash"], r.k))
    at = [j for j, r in enumerate(order) if r["_hash"] == "7" * 32]
    for ranks in ([at[0] + 30], [0], [1], [len(order)], [len(order) + 1], [at[0] + 1, at[-1] + 1], [0, 9]):
        got = {r.k: r["_part"] for r in ranked(df, "k", ranks).collect()}
        want = {r.k: next(i for i, n in enumerate(ranks) if j < n)
                for j, r in enumerate(order) if j < max(ranks)}
        assert got == want, ranks
    got = {r.k: r["_part"] for r in ranked(df, "k", [60, 120], "label").collect()}
    want = {}
    for label in "ab":
        own = [r.k for r in order if r.label == label]
        want |= {k: j // 60 for j, k in enumerate(own[:120])}
    assert got == want
    assert ranked(df.limit(0), "k", [5], "label").collect() == []
    assert ranked(df.limit(0), "k", [5]).collect() == []
