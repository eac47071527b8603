"""Text rules and risky attachments.

Every rule is a row-local expression: no mail x rule join, no shuffle, and the
same code serves batch and stream. A rule's pattern only runs on mail that holds
the words every match needs; those are looked up in the lower-case text, which is
several times cheaper than a case-blind pattern.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitwatch.functions.findings import finding
from baitwatch.functions.text import (
    any_word,
    java_pattern,
    matching_case,
    phrases_pattern,
    sql_text,
    strip,
)
from baitwatch.plans.once import exploded, once
from baitwatch.registry import (
    ATTACHMENT_MESSAGE,
    ATTACHMENT_PATTERN,
    RISKY_EXTENSIONS,
    TEXT_RULES,
    TextRule,
)

FOLDED = "_folded"

# Words that several rules need first; each is looked up once per mail.
_SHARED = tuple(
    word for word, n in Counter(w for r in TEXT_RULES for w in r.needs[0]).items() if n > 1
)


def with_folded(mail: DataFrame, text: str = "email_text") -> DataFrame:
    return mail if FOLDED in mail.columns else mail.withColumn(FOLDED, matching_case(F.col(text)))


def rule_pattern(rule: TextRule) -> str:
    """The rule in Java's dialect, tried only where a match can begin."""
    body = rule.pattern or phrases_pattern(rule.phrases)
    starts = rule.starts or "".join(dict.fromkeys(p[0] for p in rule.phrases))
    return java_pattern(f"(?=[{starts}])(?:{body})")


def with_words(mail: DataFrame, text: str = "email_text") -> DataFrame:
    """Adds the folded text and, for each shared word, whether it occurs."""
    found = [f"contains({FOLDED}, {sql_text(w)}) AS _has_{i}" for i, w in enumerate(_SHARED)]
    return with_folded(mail, text).selectExpr("*", *found)


def may_match(rule: TextRule) -> str:
    """SQL over rows of ``with_words``: whether every group of needed words is met."""
    first, *others = rule.needs
    known = [f"_has_{_SHARED.index(w)}" for w in first if w in _SHARED]
    rest = [w for w in first if w not in _SHARED]
    met = " OR ".join(known + ([any_word(FOLDED, rest)] if rest else []))
    return " AND ".join([f"({met})"] + [any_word(FOLDED, words) for words in others])


def rule_fires(rule: TextRule, text: str, gated: bool = True) -> str:
    """SQL over rows of ``with_words``: whether the rule fires."""
    fires = f"rlike({text}, {sql_text(rule_pattern(rule))})"
    return f"({may_match(rule)} AND {fires})" if gated else fires


def rule_match(rule: TextRule, text: str, gated: bool = True) -> str:
    """SQL for the first match of the rule, ``''`` when it does not fire."""
    match = f"regexp_extract({text}, {sql_text(rule_pattern(rule))}, 0)"
    return f"CASE WHEN {may_match(rule)} THEN {match} ELSE '' END" if gated else match


def with_text_hits(
    mail: DataFrame, rules=TEXT_RULES, text: str = "email_text", gated: bool = True
) -> DataFrame:
    """Adds ``_hits``: the rules that fire, as ``(ord, match)`` in registry order."""
    order = {rule.key: i for i, rule in enumerate(TEXT_RULES, start=1)}
    hits = ", ".join(
        f"named_struct('ord', {order[rule.key]}, 'match', {rule_match(rule, text, gated)})"
        for rule in rules
    )
    return with_words(mail, text).selectExpr(
        *dict.fromkeys([*mail.columns, FOLDED]),
        f"filter(array({hits}), hit -> hit.match != '') AS _hits",
    )


def _rule_facts(ord_: Column) -> Column:
    """Key, category and message ends of a rule, by its place in the registry."""
    facts = []
    for rule in TEXT_RULES:
        before, _, after = rule.message.partition("{match}")
        facts.append(
            f"named_struct('rule', {sql_text(rule.key)}, 'category', {sql_text(rule.category)}, "
            f"'before', {sql_text(before)}, 'after', {sql_text(after)})"
        )
    return F.element_at(F.expr(f"array({', '.join(facts)})"), ord_)


def hit_findings(hits: Column) -> Column:
    """Hits as findings, before repeated phrases are dropped."""

    def build(hit: Column) -> Column:
        match, facts = strip(hit["match"]), _rule_facts(hit["ord"])
        return finding(
            facts["rule"], facts["category"],
            F.concat(facts["before"], match, facts["after"]), match,
        )

    return F.transform(hits, build)


def drop_repeats(findings: Column) -> Column:
    """Keeps the first of several findings that quote one phrase in one category."""

    def first(f: Column, i: Column) -> Column:
        same = F.exists(
            F.slice(findings, F.lit(1), i),
            lambda g: (g["category"] == f["category"])
            & (F.lower(g["match"]) == F.lower(f["match"])),
        )
        return (f["match"] == "") | ~same

    return F.filter(findings, first)


def tag_text_rules(mail: DataFrame, rules=TEXT_RULES, text: str = "email_text") -> DataFrame:
    """Long table of rule hits before repeats are dropped: one row per mail and rule."""
    hits = with_text_hits(mail.select("mail_id", text), rules, text)
    rows = exploded(hits, ["mail_id"], F.col("_hits"), "hit")
    found = hit_findings(F.array("hit"))[0]
    return rows.select("mail_id", F.col("hit.ord").alias("ord"), found.alias("f")).select(
        "mail_id", "ord", "f.*"
    )


def deduplicated_text_findings(mail: DataFrame, text: str = "email_text") -> DataFrame:
    hits = with_text_hits(mail.select("mail_id", text), text=text)
    tagged = hits.select("mail_id", hit_findings(F.col("_hits")).alias("_text"))
    kept = exploded(tagged, ["mail_id"], drop_repeats(F.col("_text")), "f", "pos")
    return kept.select("mail_id", (F.col("pos") + 1).alias("ord"), "f.*")


# --- attachments ----------------------------------------------------------------------


def attachment_match(text: Column, folded: Column) -> Column:
    """First file name with a risky ending, ``''`` when there is none."""
    return F.when(
        folded.rlike(rf"\.(?:{'|'.join(RISKY_EXTENSIONS)})"),
        F.regexp_extract(text, java_pattern(ATTACHMENT_PATTERN), 0),
    ).otherwise(F.lit(""))


def attachment_finding(match: Column) -> Column:
    before, _, after = ATTACHMENT_MESSAGE.partition("{match}")
    message = F.concat(F.lit(before), match, F.lit(after))
    return F.when(match != "", finding("risky_attachment", "attachment", message, match))


def tag_attachment(mail: DataFrame, text: str = "email_text") -> DataFrame:
    df = with_folded(mail.select("mail_id", text), text)
    df = once(df, ["mail_id"], _match=attachment_match(F.col(text), F.col(FOLDED)))
    df = df.filter(F.col("_match") != "")
    return df.select("mail_id", attachment_finding(F.col("_match")).alias("f")).select(
        "mail_id", "f.rule", "f.category", "f.message", "f.match"
    )
