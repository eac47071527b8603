"""Checks on submitted mail, labels and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitwatch.functions.text import strip
from baitwatch.plans.once import once
from baitwatch.registry import (
    DANGEROUS,
    EMPTY_MAIL,
    LONG_MAIL,
    MAX_MAIL_CHARS,
    NEGATIVE_LABELS,
    POSITIVE_LABELS,
    SUSPICIOUS,
)


def validate_mail(
    mail: DataFrame, max_chars: int | None = MAX_MAIL_CHARS, text: str = "email_text"
) -> DataFrame:
    """Replaces the text by its stripped form and adds ``error``, NULL when it is fine.

    Without ``max_chars`` only blank mail is an error.
    """
    df = once(mail, mail.columns, **{text: F.coalesce(strip(F.col(text)), F.lit(""))})
    error = F.when(F.col(text) == "", EMPTY_MAIL)
    if max_chars is not None:
        error = error.when(F.length(text) > max_chars, LONG_MAIL.format(limit=max_chars))
    return df.withColumn("error", error)


def valid_mail(
    mail: DataFrame, max_chars: int | None = None, text: str = "email_text"
) -> DataFrame:
    return validate_mail(mail, max_chars, text).filter(F.col("error").isNull()).drop("error")


def quarantined_mail(
    mail: DataFrame, max_chars: int | None = None, text: str = "email_text"
) -> DataFrame:
    """What ``valid_mail`` leaves out under the same limit, with the reason in ``error``."""
    return validate_mail(mail, max_chars, text).filter(F.col("error").isNotNull())


def normalize_label(label: Column, strict: bool = True) -> Column:
    """``phishing`` or ``legitimate``; other labels fail the job, or are NULL if not strict."""
    value = F.lower(strip(label))
    known = F.when(value.isin(*POSITIVE_LABELS), "phishing").when(
        value.isin(*NEGATIVE_LABELS), "legitimate"
    )
    if not strict:
        return known
    shown = F.coalesce(label, F.lit("NULL"))
    return known.otherwise(F.raise_error(F.concat(F.lit("Unsupported label: "), shown)))


def predict(risk_level: Column) -> Column:
    return F.when(risk_level.isin(SUSPICIOUS, DANGEROUS), "phishing").otherwise("legitimate")
