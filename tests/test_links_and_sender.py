"""URL parts, link findings, header block and sender checks."""

import re

import pytest
from pyspark.sql import functions as F

from baitwatch.functions import urls as U
from baitwatch.functions.mail_headers import address, display_name, header_block, header_value
from baitwatch.operators.links import tag_domain_spoofing, tag_links, url_facts
from baitwatch.operators.sender import extract_headers, tag_sender
from baitwatch.registry import CREDENTIAL_PATH_WORDS

HOSTS = {
    "http://www.paypal.com/login": "paypal.com",
    "paypal.com/login": "paypal.com",
    "http://example.com:8080/path": "example.com",
    "http://www.paypal.com@203.0.113.4/login": "203.0.113.4",
    "https://a_b.com?x": "a_b.com",
    "HTTP://Upper.example.com/X": "http",
    "http://example.com.": "example.com.",
    "http://[bad": "[bad", "https://[bad": "", "http://a[b].com/x": "a[b].com",
    "https://a[b].com/x": "", "https://[2001:db8::1]/x": "[2001", "www.[]": "[]",
    "https://ex／ample.com/": "", "http://www.www.x.com": "www.x.com", "www.": "",
    "http://ÉCOLE.fr#x": "école.fr",
}


def test_hostname(spark):
    df = spark.createDataFrame([(u,) for u in HOSTS], "u string")
    rows = df.select("u", U.hostname(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in rows} == HOSTS


def test_root_and_tld(spark):
    cases = {"mail.google.com": ("google.com", "com"), "localhost": ("localhost", ""),
             "example.co.uk": ("co.uk", "uk"), "example.com.": ("com.", ""), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    rows = df.select("h", U.root_domain(F.col("h")).alias("r"),
                     U.top_level(U.root_domain(F.col("h"))).alias("t")).collect()
    assert {r.h: (r.r, r.t) for r in rows} == cases


def test_url_extraction_keeps_order_and_repeats(mails):
    rows = url_facts(mails(
        "(see http://example.com/a) www.B.org/x, HTTPS://c.net' http://example.com/a",
        "httpſ://long.example/s ", "No links.")).orderBy("mail_id", "pos").collect()
    assert [(r.mail_id, r.pos, r.url) for r in rows] == [
        (0, 0, "http://example.com/a"), (0, 1, "www.B.org/x,"), (0, 2, "HTTPS://c.net"),
        (0, 3, "http://example.com/a"), (1, 0, "httpſ://long.example/s")]


def spoofs(mails, url):
    return [r.message for r in tag_domain_spoofing(mails(url)).collect()]


@pytest.mark.parametrize("url,words", [
    ("https://www.paypal.com/signin", []), ("https://example.com", []),
    ("https://mail.google.com/inbox", []), ("http://paypal-secure-login.com", ["impersonation"]),
    ("http://paypa1.com", ["misspelled"]), ("http://paypall.com", ["impersonation"]),
    ("http://amazom.com", ["typo-squatting"]), ("http://hsbd.com", []),
    ("http://pаypal.com/login", ["homograph", "misspelled"]),
    ("http://xn--pple-43d.com", ["punycode"]), ("http://my-purchase.com", ["impersonation"]),
    ("https://www.barclays.co.uk/", ["impersonation"]),
])
def test_spoofing(mails, url, words):
    messages = spoofs(mails, url)
    assert len(messages) == len(words)
    assert all(any(w in m for m in messages) for w in words)


def test_link_findings_in_order_without_repeats(mails):
    rows = tag_links(mails(
        "http://bit.ly/a http://bit.ly/a http://1.2.3.4/login http://u@x.tk/ http://login-ebay.com/1 "
        "http://login-ebay.com/2")).orderBy("ord").collect()
    assert [r.rule for r in rows] == [
        "has_links", "ip_url", "shortener", "userinfo_trick", "suspicious_tld", "domain_spoofing",
        "credential_path", "insecure_http"]
    assert rows[0].message.startswith("Contains 6 link(s)")


def test_credential_path_agrees_with_the_plain_form(spark):
    plain = re.compile(r"https?://[^\s<>\"']*?/[^\s<>\"']*?(?:" + "|".join(CREDENTIAL_PATH_WORDS)
                       + ")", re.IGNORECASE)
    texts = ["http://a.com/x/y/login", "http://login.com/", "http://a.com login", "https://a/b)login",
             "http://a.com?u=/SECURE", "http:///auth", "http://a.com/x 'https://b.de/verify", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.col("t").rlike(U.CREDENTIAL_PATH_PATTERN).alias("x")).collect()
    assert {r.t: r.x for r in rows} == {t: bool(plain.search(t)) for t in texts}


HEADER_CASES = {
    "From: A <a@x.org>\nSubject: Hi\n\nFrom: b@y.org": {"from": "A <a@x.org>", "subject": "Hi"},
    "Just text.": {}, "": {}, " \n\r\n\t From : a@x.org\r\nto: b\r\nTo: c\r\nbody": {
        "from": "a@x.org", "to": "b"},
    "From: a\n continued\nTo: b": {"from": "a"}, "Subject:\nTo: b": {}, "Cc:  \nTo: b": {
        "cc": "", "to": "b"},
    "From: 😀 a Date: now\x0bSender: s\x1eX: y": {"from": "😀 a", "date": "now", "sender": "s"},
    "From:a\nReturn-Path: <r@z.org>": {"from": "a", "return-path": "<r@z.org>"},
}


def test_header_block(mails, spark):
    rows = extract_headers(mails(*HEADER_CASES)).collect()
    got = {i: {} for i in range(len(HEADER_CASES))}
    for r in rows:
        got[r.mail_id][r.name] = r.value
    assert list(got.values()) == list(HEADER_CASES.values())
    df = spark.createDataFrame([("To: a\n" * 20000 + "body",)], "t string")
    block = header_block(F.col("t"))
    assert df.select(header_value(block, "to"), F.length(block)).first() == ("a", 20000 * 6)


def test_split_address(spark):
    cases = {"Alice <Alice@Example.com>": ("Alice", "alice@example.com"),
             "a@b.org": ("", "a@b.org"), '"Support Team" <s@e.com>': ("Support Team", "s@e.com"),
             "x <y> z <q@r.st>": ("x <y> z", "q@r.st"), "none": ("", ""),
             "<" * 60000: ("", ""), "<a@b.c> x": ("", "a@b.c"), "> < a@B.c >": (">", "a@b.c"),
             "<x<y@z.w>": ("", "y@z.w"), "Ünï 😀 <ü@ex.org>": ("Ünï 😀", "ü@ex.org"), ">": ("", ""),
             "a <> <>": ("a <>", ""),
             "a" * 50000: ("", ""), "x@y" + ".a.bc" * 30000: ("", "x@y" + ".a.bc" * 30000), "Bob <not an address>": ("Bob", "")}
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    rows = df.select("v", display_name(F.col("v")).alias("d"), address(F.col("v")).alias("a"))
    assert {r.v: (r.d, r.a) for r in rows.collect()} == cases


@pytest.mark.parametrize("text,rules", [
    ("From: Odile <odile@harbour.example>\nReply-To: odile@harbour.example\n\nAhoy", []),
    ("From: Quay <q@harbour.example>\nReply-To: r@rented.example\nReturn-Path: <l@third.example>\n\n"
     "Ahoy", ["reply_to_mismatch", "return_path_mismatch"]),
    ("From: A ma zon <p@parcel-desk.tk>\n\nAhoy", ["display_name_brand_mismatch"]),
    ("From: Amazon <p@parcel-desk.tk>\n\nAhoy", ["display_name_brand_mismatch"]),
    ("From: eBay <post@ebay.com>\n\nAhoy", []),
    ("From: desk@savings.example <box@rented.example>\n\nAhoy", ["display_name_address_mismatch"]),
    ("From: Tenant Support <rooms@gmail.com>\n\nAhoy", ["organisation_from_free_mail"]),
    ("From: Marisol <marisol.k@gmail.com>\n\nAhoy", []),
    ("From: Tides <t@news.harbour.example>\nReply-To: crew@harbour.example\n\nAhoy", []),
    ("Subject: tide\n\nFrom: Amazon <p@parcel-desk.tk>", []),
])
def test_sender_checks(mails, text, rules):
    assert [r.rule for r in tag_sender(mails(text)).collect()] == rules
