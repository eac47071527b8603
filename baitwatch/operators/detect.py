"""The whole offline analysis of a mail table, in one pass and without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitwatch.functions.findings import FINDINGS, no_findings, risk_level, score, score_of
from baitwatch.operators.links import (
    brand_mismatch,
    deceptive_link,
    link_findings,
    mentioned_brand,
    with_links,
)
from baitwatch.operators.sender import sender_findings, with_sender
from baitwatch.operators.text_rules import (
    FOLDED,
    attachment_finding,
    attachment_match,
    drop_repeats,
    hit_findings,
    rule_fires,
    with_text_hits,
    with_words,
)
from baitwatch.plans.once import exploded, once
from baitwatch.registry import CATEGORIES, TEXT_CATEGORIES, TEXT_RULES

_GATES = ("credentials", "account_threat")


def with_findings(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """Adds ``findings`` in reporting order."""
    keep = mail.columns
    df = with_text_hits(mail, text=text)
    df = df.withColumn("_attachment", attachment_match(F.col(text), F.col(FOLDED)))
    df = with_links(with_sender(df, text), text)
    df = df.withColumn("_tagged", hit_findings(F.col("_hits")))
    df = df.withColumn("_text", drop_repeats(F.col("_tagged")))
    wanted = reduce(
        Column.__or__, [F.array_contains(F.col("_text.category"), g) for g in _GATES]
    ) & (F.size("_urls") > 0)
    df = df.withColumn("_lower", F.when(wanted, F.lower(F.col(text))))
    df = df.withColumn("_brand", mentioned_brand("_lower"))
    df = df.withColumn("_mismatch", brand_mismatch(F.col("_brand"), F.col("_links")))
    attachment = attachment_finding(F.col("_attachment"))
    findings = F.concat(
        F.col("_text"),
        F.when(attachment.isNotNull(), F.array(attachment)).otherwise(no_findings()),
        sender_findings("_sender"),
        link_findings(F.col(text), F.col(FOLDED), F.col("_urls"), F.col("_links")),
        F.when(F.col("_mismatch").isNotNull(), F.array("_mismatch")).otherwise(no_findings()),
    )
    return once(df, keep, findings=findings.cast(FINDINGS))


def analyse_mail(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """Adds ``findings, flags, score, risk_level``."""
    df = with_findings(mail, text)
    df = df.withColumns({
        "flags": F.col("findings.message"), "score": score_of("findings"),
    })
    return df.withColumn("risk_level", risk_level(F.col("score")))


def long_findings(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """``findings(mail_id, ord, rule, category, message, match)``."""
    df = with_findings(mail.select("mail_id", text), text)
    rows = exploded(df, ["mail_id"], F.col("findings"), "f", "pos")
    return rows.select("mail_id", (F.col("pos") + 1).alias("ord"), "f.*")


def _with_fired(mail: DataFrame, text: str) -> DataFrame:
    """Adds whether each scoring category fires, in columns ``_c_`` of its key."""
    keep = mail.columns
    df = with_words(mail, text)
    t, folded = F.col(text), F.col(FOLDED)
    fired = [
        " OR ".join(rule_fires(r, text) for r in TEXT_RULES if r.category == c) + f" AS _c_{c}"
        for c in TEXT_CATEGORIES
    ]
    df = df.select(
        *keep, FOLDED, *[F.expr(e) for e in fired],
        (attachment_match(t, folded) != "").alias("_c_attachment"),
    )
    df = with_links(with_sender(df, text), text)
    df = df.withColumns({
        "_c_sender": F.size(sender_findings("_sender")) > 0,
        "_own_link": deceptive_link(t, folded, F.col("_links")),
    })
    gate = F.col("_c_credentials") | F.col("_c_account_threat")
    wanted = gate & (F.size("_urls") > 0) & ~F.col("_own_link")
    df = df.withColumn("_lower", F.when(wanted, F.lower(t)))
    df = df.withColumn("_brand", mentioned_brand("_lower"))
    mismatch = brand_mismatch(F.col("_brand"), F.col("_links")).isNotNull()
    return df.withColumn("_c_link_manipulation", F.col("_own_link") | mismatch)


def score_mail(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """Adds ``score`` and ``risk_level`` without building findings.

    A category counts once, so its rules are tried until one fires and no match is
    copied out of the text. Evaluation and calibration need nothing else.
    """
    df = once(_with_fired(mail, text), mail.columns, score=score(lambda key: f"_c_{key}"))
    return df.withColumn("risk_level", risk_level(F.col("score")))


def fired_categories(mail: DataFrame, keep: list[str], text: str = "email_text") -> DataFrame:
    """``keep`` and ``mask``: a bit for each scoring category that fires, in registry order."""
    bits = " + ".join(f"CASE WHEN _c_{c.key} THEN {1 << i}L ELSE 0L END"
                      for i, c in enumerate(CATEGORIES) if c.weight)
    return once(_with_fired(mail, text), keep, mask=F.expr(bits))


def brand_mismatches(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """``mail_id, message`` for mail whose links miss the brand that it names.

    Only the rules of the categories that call for the check are tried, and only they.
    """
    df = with_links(with_words(mail.select("mail_id", text), text), text)
    gate = " OR ".join(rule_fires(r, text) for r in TEXT_RULES if r.category in _GATES)
    wanted = (F.size("_urls") > 0) & F.expr(f"({gate})")
    df = df.withColumn("_lower", F.when(wanted, F.lower(F.col(text))))
    df = df.withColumn("_brand", mentioned_brand("_lower"))
    found = brand_mismatch(F.col("_brand"), F.col("_links"))
    rows = once(df, ["mail_id"], message=found["message"])
    return rows.filter(F.col("message").isNotNull())
