"""Text rules: registry, dialect, gating, repeats."""

import random
import re

import pytest
from pyspark.sql import functions as F

from baitwatch.fixture import TEMPLATES
from baitwatch.functions.text import java_pattern, phrases_pattern, strip
from baitwatch.operators.text_rules import (
    drop_repeats,
    rule_fires,
    tag_attachment,
    tag_text_rules,
    with_text_hits,
    with_words,
)
from baitwatch.registry import ATTACHMENT_PATTERN, CATEGORIES, TEXT_RULES, WEIGHTS


def python_pattern(rule):
    return re.compile(rule.pattern or phrases_pattern(rule.phrases), re.IGNORECASE)


def test_registry_is_consistent():
    keys = [r.key for r in TEXT_RULES]
    assert len(keys) == len(set(keys)) == 28
    assert {r.category for r in TEXT_RULES} <= set(WEIGHTS)
    assert all("{match}" in r.message for r in TEXT_RULES)
    assert [c.key for c in CATEGORIES if not c.weight] == ["informational"]
    assert all(c.advice for c in CATEGORIES if c.weight)
    assert sum(WEIGHTS.values()) == 28


def test_ordinary_sentences_fire_nothing(mails):
    texts = [
        "The ferry leaves at six, so bring the tent to the pier by five.",
        "Heavy rain is expected; the hut stays shut until Sunday.",
        "From May on the bus stops at the mill, and the old timetable ends.",
        "The seeds arrived on Tuesday and are in the shed.",
        "Choir practice starts ten minutes later this week.",
        "The minutes of the garden meeting are in the folder on the shelf.",
        "You can pick another colour for the fence whenever you like.",
    ]
    assert tag_text_rules(mails(*texts)).collect() == []


def random_texts(n=400, seed=3):
    """Texts built from pieces of the rules, odd characters and odd white space."""
    rng = random.Random(seed)
    words = sorted({w for r in TEXT_RULES for p in r.phrases for w in p.split()})
    words += [w for r in TEXT_RULES for w in re.findall(r"[a-z]{2,}", r.pattern)]
    words += ["of", "the", "your", "to", "i", "am", "is", "24", "5", "%", "$1,000,000", "£2.000.000",
              "x@gmail.com", "won", "dear", "№", "é", "²", "中", "e-mail", "sir/madam", "२४"]
    gaps = [" ", " ", " ", " ", "\n", "\t", "  ", "\xa0", "\x1c", "\x85", " ", "", "-", ". "]
    odd = {"s": "ſ", "i": "ı", "k": "K", "I": "İ"}
    texts = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(3, 40)))
        if rng.random() < 0.4:
            text = text.upper() if rng.random() < 0.5 else text.title()
        if rng.random() < 0.5:
            text = "".join(odd.get(c, c) if rng.random() < 0.3 else c for c in text)
        texts.append(text)
    for t in TEMPLATES:
        for text in (t.head, t.tail, t.head.upper(), t.head + t.tail):
            mixed = "".join(odd.get(c, c) if rng.random() < 0.2 else c for c in text)
            texts += [text, mixed, "".join(rng.choice(gaps) if c == " " else c for c in mixed)]
    texts += ["What is the sum total. Reply with the following; I am the widow of.", "from $5,000,000"]
    for rule in TEXT_RULES:
        for phrase in rule.phrases:
            texts += [phrase, "é" + phrase.upper() + "ß", phrase.replace("s", "ſ")]
    return texts


def test_rules_agree_with_plain_search(mails):
    """Dialect, needed words and start characters never change what is found."""
    texts = random_texts()
    expected = {
        (i, rule.key, m.group(0))
        for i, text in enumerate(texts) for rule in TEXT_RULES
        if (m := python_pattern(rule).search(text))
    }
    found = tag_text_rules(mails(*texts)).select("mail_id", "rule", "match").collect()
    assert {tuple(r) for r in found} == expected
    assert len({r for _, r, _ in expected}) == 28


def test_gate_is_neutral_on_match_and_predicate(mails):
    df = mails(*random_texts(150, seed=9))
    gated = with_text_hits(df).select("mail_id", "_hits").collect()
    assert gated == with_text_hits(df, gated=False).select("mail_id", "_hits").collect()
    flags = with_words(df).select("mail_id", F.array(*[
        F.expr(rule_fires(r, "email_text")) for r in TEXT_RULES]).alias("f"))
    fired = {r.mail_id: [i + 1 for i, x in enumerate(r.f) if x] for r in flags.collect()}
    assert fired == {r.mail_id: [h["ord"] for h in r._hits] for r in gated}


@pytest.mark.parametrize("text,match", [
    ("see invoice-2024.exe now", "invoice-2024.exe"), ("example.com only", None),
    ("a.exec b.zipper", None), ("-x.PS1!", "x.PS1"), ("ünï.hta", "ünï.hta"), ("ﬁle.ıso", "ﬁle.ıso"),
])
def test_attachment(mails, text, match):
    expected = re.search(ATTACHMENT_PATTERN, text, re.IGNORECASE)
    assert (expected and expected.group(0)) == match
    assert [r.match for r in tag_attachment(mails(text)).collect()] == ([match] if match else [])


def test_repeats_are_dropped_within_a_category(analyse, spark):
    [row] = analyse("Kindly verify your account on paper.")
    assert [f.rule for f in row.findings] == ["personal_info_phrases"]
    df = spark.sql(
        "SELECT array(named_struct('category','a','match','X'), named_struct('category','a',"
        "'match','x'), named_struct('category','b','match','x'), named_struct('category','a',"
        "'match',''), named_struct('category','a','match','')) AS f")
    kept = df.select(drop_repeats(F.col("f")).alias("k")).first().k
    assert [(k.category, k.match) for k in kept] == [("a", "X"), ("b", "x"), ("a", ""), ("a", "")]


def test_strip_and_boundaries(spark):
    text = "\x1f \xa0 a b\x85　\n"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(strip(F.col("t"))).first()[0] == text.strip()
    words = ["éfbi", "fbi", "fbi²", "(fbi)", "_fbi"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    rows = df.select("t", F.col("t").rlike(java_pattern(r"\bfbi\b")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == {w: bool(re.search(r"\bfbi\b", w)) for w in words}
