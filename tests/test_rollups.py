"""Totals kept by signed deltas, and sweeps from one histogram, against full counts."""

import random

import pytest
from pyspark.sql import functions as F

from baitwatch.operators import evaluate, history, rollups
from baitwatch.registry import CATEGORIES

LEVELS = ("Safe", "Suspicious", "Dangerous")


def level(score):
    return LEVELS[(score >= 3) + (score >= 6)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame(
            [(i, s, level(s), c) for i, s, c in rows],
            "id long, score int, risk_level string, network_checked boolean")

    return make


def test_totals_follow_appends_deletes_and_merges(spark, table, tmp_path):
    draw, path = random.Random(3), str(tmp_path)
    state = {i: (draw.randrange(9), draw.random() < 0.2) for i in range(200)}
    frame = lambda: table([(i, s, c) for i, (s, c) in state.items()])
    rollups.store_delta(rollups.append_delta(frame()), path, 0)
    for batch in range(1, 10):
        kind = batch % 3
        if kind == 0:
            new = {1000 * batch + i: (draw.randrange(9), False) for i in range(20)}
            rollups.store_delta(rollups.append_delta(
                table([(i, s, c) for i, (s, c) in new.items()])), path, batch)
            state |= new
        elif kind == 1:
            gone = draw.sample(sorted(state), 15) + [-1, 99_999]
            asked = spark.createDataFrame([(i,) for i in gone + gone[:3]], "id long")
            rollups.store_delta(rollups.delete_delta(frame(), asked), path, batch)
            state = {i: v for i, v in state.items() if i not in gone}
        else:
            points = {i: draw.choice((None, 0, 2, 5)) for i in draw.sample(sorted(state), 40)}
            checks = spark.createDataFrame(list(points.items()), "id long, points int")
            delta = rollups.link_delta(frame(), checks)
            for _ in range(2):  # a repeated run replaces what it stored
                rollups.store_delta(delta, path, batch)
            state = {i: (s if c else s + (points.get(i) or 0), c) for i, (s, c) in state.items()}
        kept = rollups.standing(spark, path)
        assert rows_of(kept.select("risk_level", "score", "n")) == rows_of(
            frame().groupBy("risk_level", "score").count())
        assert rows_of(rollups.risk_totals_of(kept)) == rows_of(history.risk_totals(frame()))
    rollups.compacted(spark, path, f"{path}-small", 9)
    small = spark.read.parquet(f"{path}-small")
    assert rows_of(rollups.standing(spark, f"{path}-small")) == rows_of(rollups.standing(spark, path))
    assert small.count() <= 30


def test_everything_taken_back_leaves_nothing(spark, table, tmp_path):
    rows = table([(1, 3, False), (2, 7, True)])
    rollups.store_delta(rollups.append_delta(rows), str(tmp_path), 0)
    rollups.store_delta(rollups.delete_delta(rows, rows), str(tmp_path), 1)
    kept = rollups.standing(spark, str(tmp_path))
    assert kept.collect() == []
    assert rows_of(rollups.risk_totals_of(kept)) == rows_of(history.risk_totals(rows.limit(0)))
    plan = rollups.delete_delta(rows.withColumn("email_text", F.lit("x")), rows)
    assert "email_text" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_evaluation_from_a_histogram(spark):
    draw = random.Random(5)
    rows = [(draw.choice(("phishing", "legitimate")), s := draw.randrange(12), level(s)) for _ in range(300)]
    scored = spark.createDataFrame(rows, "actual string, score int, risk_level string")
    bars = rollups.counted(scored, rollups.LABELLED_KEYS)
    assert rows_of(evaluate.sweep_of(bars)) == rows_of(evaluate.threshold_sweep(scored))
    assert evaluate.confusion_matrix(bars, F.col("n")).collect() == evaluate.confusion_matrix(scored).collect()
    none = evaluate.confusion_matrix(bars.limit(0), F.col("n")).first()
    assert none.total == 0 and none.risk_levels == {}


def test_ablation_equals_scoring_without_each_category(spark):
    draw = random.Random(6)
    weights = [(i, c.key, c.weight) for i, c in enumerate(CATEGORIES) if c.weight]
    rows = [(draw.choice(("phishing", "legitimate")), sum(1 << i for i, _, _ in weights if draw.random() < 0.2))
            for _ in range(200)]
    masked = spark.createDataFrame(rows, "actual string, mask long")
    got = evaluate.category_ablation(masked)
    assert got.count() == len(weights) * evaluate.MAX_THRESHOLD
    for i, key, _ in weights:
        scored = spark.createDataFrame(
            [(a, sum(w for j, _, w in weights if j != i and m >> j & 1)) for a, m in rows],
            "actual string, score int")
        own = got.filter(F.col("without") == key).drop("without")
        assert rows_of(own) == rows_of(evaluate.threshold_sweep(scored))


def test_mask_agrees_with_the_score(mails):
    mail = mails("Dear customer, verify your account: http://bit.ly/x", "Lunch?",
                 "You have won the lottery! http://192.168.1.1/claim invoice.exe").selectExpr(
        "mail_id", "email_text", "'phishing' AS label")
    masks = [r["mask"] for r in evaluate.mask_labelled(mail).collect()]
    scores = [r["score"] for r in evaluate.score_labelled(mail).collect()]
    assert [sum(c.weight for i, c in enumerate(CATEGORIES) if m >> i & 1) for m in masks] == scores
    assert max(scores) > 0
