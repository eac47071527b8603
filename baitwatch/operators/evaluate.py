"""Evaluation and calibration over scored, labelled mail.

Mail is scored once; everything below aggregates a few numbers per row, with partial
sums before any shuffle. The text never leaves the scan stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baitwatch.functions.text import ratio
from baitwatch.operators.detect import fired_categories, score_mail
from baitwatch.operators.text_rules import rule_fires, with_words
from baitwatch.operators.validate import normalize_label, predict
from baitwatch.registry import (
    CATEGORIES,
    DANGEROUS_FROM,
    MAX_THRESHOLD,
    PHISHING_CORPORA,
    RISK_LEVELS,
    SUSPICIOUS_FROM,
    TEXT_RULES,
    WEIGHTS,
)


def score_labelled(mail: DataFrame, label: str = "label", text: str = "email_text") -> DataFrame:
    """Adds ``actual, score, risk_level``; missing text counts as empty."""
    df = mail.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("actual", normalize_label(F.col(label)))
    return score_mail(df, text)


def mask_labelled(mail: DataFrame, label: str = "label", text: str = "email_text") -> DataFrame:
    """``actual, mask`` of every mail: its class, and a bit for each category that fires."""
    df = mail.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("actual", normalize_label(F.col(label)))
    return fired_categories(df, ["actual"], text)


def _f1(precision: Column, recall: Column) -> Column:
    return ratio(F.lit(2) * precision * recall, precision + recall)


def confusion_matrix(scored: DataFrame, rows: Column | None = None) -> DataFrame:
    """One row of counts and ratios from ``actual`` and ``risk_level``.

    ``rows`` says for how many mails a row stands, one by default.
    """
    positive = F.col("actual") == "phishing"
    flagged = predict(F.col("risk_level")) == "phishing"
    n = F.lit(1).cast("long") if rows is None else rows

    def count(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, n).otherwise(0)), F.lit(0)).alias(name)

    df = scored.agg(
        count(positive & flagged, "true_positive"), count(~positive & flagged, "false_positive"),
        count(~positive & ~flagged, "true_negative"), count(positive & ~flagged, "false_negative"),
        *[count(F.col("risk_level") == level, level.lower()) for level in RISK_LEVELS],
    )
    tp, fp, tn, fn = (
        F.col(c)
        for c in ("true_positive", "false_positive", "true_negative", "false_negative")
    )
    df = df.withColumns({
        "total": tp + fp + tn + fn, "actual_phishing": tp + fn, "actual_legitimate": fp + tn,
        "correct": tp + tn, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
    })
    df = df.withColumns({
        "accuracy": ratio(F.col("correct"), F.col("total")),
        "false_positive_rate": ratio(fp, F.col("actual_legitimate")),
        "false_negative_rate": ratio(fn, F.col("actual_phishing")),
        "f1_score": _f1(F.col("precision"), F.col("recall")),
    })
    pairs = [x for level in RISK_LEVELS for x in (F.lit(level), F.col(level.lower()))]
    df = df.withColumn("risk_levels", F.map_filter(F.create_map(*pairs), lambda _, n: n > 0))
    return df.drop(*[level.lower() for level in RISK_LEVELS])


def risk_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_level").agg(F.count("*").alias("mails"))


def threshold_sweep(scored: DataFrame, highest: int = MAX_THRESHOLD) -> DataFrame:
    """Quality of every threshold from 1 to ``highest``.

    The mail is reduced to a score histogram first, at most 29 scores for two
    classes; the thresholds are applied to that.
    """
    return sweep_of(scored.groupBy("score", "actual").agg(F.count("*").alias("n")), highest)


def sweep_of(bars: DataFrame, highest: int = MAX_THRESHOLD, *groups: str) -> DataFrame:
    """``threshold_sweep`` from a histogram ``score, actual, n``, for each of ``groups``."""
    bars = bars.withColumn(
        "threshold", F.explode(F.sequence(F.lit(1), F.lit(highest)))
    )
    hit = F.col("score") >= F.col("threshold")
    positive = F.col("actual") == "phishing"

    def count(cond: Column, name: str) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)

    df = bars.groupBy(*groups, "threshold").agg(
        count(positive & hit, "tp"), count(positive & ~hit, "fn"),
        count(~positive & hit, "fp"), count(~positive & ~hit, "tn"),
    )
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    df = df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return df.select(
        *groups, "threshold", "precision", "recall",
        _f1(F.col("precision"), F.col("recall")).alias("f1_score"),
        ratio(tp + tn, tp + fn + fp + tn).alias("accuracy"),
        ratio(fp, fp + tn).alias("fp_rate"),
        F.when(F.col("threshold") == SUSPICIOUS_FROM, "suspicious")
        .when(F.col("threshold") == DANGEROUS_FROM, "dangerous")
        .otherwise("").alias("in_use"),
    ).orderBy(*groups, "threshold")


def category_ablation(masked: DataFrame, highest: int = MAX_THRESHOLD) -> DataFrame:
    """The threshold sweep as it would be without one category, for each that scores.

    ``masked(actual, mask)`` has the categories that fired as bits. A histogram over masks
    tells the scores without any one of them, so the mail is read once for all sweeps.
    """
    weighted = [(i, c) for i, c in enumerate(CATEGORIES) if c.weight]
    bars = masked.groupBy("actual", "mask").agg(F.count("*").alias("n"))

    def score(without: int) -> Column:
        return reduce(Column.__add__, [F.shiftright("mask", i).bitwiseAND(F.lit(1)) * c.weight
                                       for i, c in weighted if i != without])

    without = F.array(*[F.struct(F.lit(c.key).alias("without"), score(i).cast("int").alias("score"))
                        for i, c in weighted])
    bars = bars.select("actual", "n", F.inline(without))
    bars = bars.groupBy("without", "score", "actual").agg(F.sum("n").alias("n"))
    return sweep_of(bars, highest, "without")


def rule_hit_rates(
    mail: DataFrame, label: str = "label", text: str = "email_text"
) -> DataFrame:
    """Share of each class a text rule fires on, before repeats are dropped.

    One pass with two counters a rule; rules that never fire stay in the result.
    Labels have to be exactly ``phishing`` or ``legitimate``; others are left out.
    """
    df = with_words(mail, text)
    positive, negative = F.col(label) == "phishing", F.col(label) == "legitimate"
    df = df.filter(positive | negative).select(positive.alias("_positive"), *[
        F.expr(rule_fires(r, text)).alias(r.key) for r in TEXT_RULES
    ])
    counted = [f"count_if({r.key} AND _positive) AS p_{r.key}" for r in TEXT_RULES]
    counted += [f"count_if({r.key} AND NOT _positive) AS n_{r.key}" for r in TEXT_RULES]
    counts = df.agg(
        F.count_if("_positive").alias("_p"), F.count_if(~F.col("_positive")).alias("_n"),
        *[F.expr(c) for c in counted],
    )
    rows = ", ".join(
        f"named_struct('rule', '{r.key}', 'category', '{r.category}', "
        f"'weight', {WEIGHTS[r.category]}, 'p', p_{r.key}, 'n', n_{r.key})"
        for r in TEXT_RULES
    )
    p, n = F.col("phishing_pct"), F.col("legitimate_pct")
    return (
        counts.select("_p", "_n", F.expr(f"explode(array({rows}))").alias("r"))
        .select(
            "r.rule", "r.category", "r.weight",
            (ratio(F.col("r.p"), F.col("_p")) * 100).alias("phishing_pct"),
            (ratio(F.col("r.n"), F.col("_n")) * 100).alias("legitimate_pct"),
        )
        .withColumn("ratio", F.when(n != 0, p / n).otherwise(F.lit(float("inf"))))
        .orderBy("category", F.desc("phishing_pct"), "rule")
    )


def _caught() -> Column:
    return F.count_if(F.col("score") >= SUSPICIOUS_FROM)


def source_breakdown(scored: DataFrame, label: str = "label") -> DataFrame:
    """Recall by corpus among the mail labelled phishing, largest corpus first."""
    by_source = scored.filter(F.col(label) == "phishing").groupBy("source").agg(
        F.count("*").alias("mails"), _caught().alias("caught")
    )
    # One row per corpus is left here, so the total over all of them is cheap.
    total = F.sum("mails").over(Window.partitionBy())
    kind = F.when(F.col("source").isin(*PHISHING_CORPORA), "phishing").otherwise("spam")
    return by_source.select(
        "source", "mails", ratio(F.col("mails"), total).alias("share"), "caught",
        ratio(F.col("caught"), F.col("mails")).alias("recall"), kind.alias("kind"),
    ).orderBy(F.desc("mails"), "source")


def kind_recall(scored: DataFrame, label: str = "label") -> DataFrame:
    """Recall on true phishing against generic spam, both always present."""
    phishing = F.col("source").isin(*PHISHING_CORPORA)
    hit = F.col("score") >= SUSPICIOUS_FROM
    counts = scored.filter(F.col(label) == "phishing").agg(
        F.count("*").alias("all"),
        F.count_if(phishing).alias("p"), F.count_if(phishing & hit).alias("p_hit"),
        F.count_if(~phishing).alias("s"), F.count_if(~phishing & hit).alias("s_hit"),
    )

    def group(kind: str, n: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.col(n).alias("mails"),
            ratio(F.col(n), F.col("all")).alias("share"),
            ratio(F.col(f"{n}_hit"), F.col(n)).alias("recall"),
        )

    rows = F.array(group("phishing", "p"), group("spam", "s"))
    return counts.select(F.explode(rows).alias("r")).select("r.*")
