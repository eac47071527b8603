"""Rule-based mail-risk analytics over Spark DataFrames."""

from baitwatch.operators.detect import analyse_mail, score_mail

__all__ = ["analyse_mail", "score_mail"]
