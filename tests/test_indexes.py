"""Search and link indexes and the brand registry against the forms that read everything."""

import random
import sys
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from baitwatch.functions.findings import FINDINGS
from baitwatch.operators import (
    brand_registry, enrich, history, link_index, links, search_index, trigram_lists)
from baitwatch.operators.scans import SCAN_COLUMNS, merge_link_findings
from baitwatch.registry import BRAND_DOMAINS, THREAT_POINTS
from baitwatch.streaming.scan_stream import standing_hits, stream_late_threats

SCAN = ("id long, email_text string, flags array<string>, findings " + FINDINGS + ", score int, "
        "risk_level string, note string, created_at timestamp_ntz, network_checked boolean")


@pytest.fixture(scope="module")
def scans(spark):
    def make(rows):
        full = [(i, t, f, [], 0, "Safe", n, None, c) for i, t, f, n, c in rows]
        return spark.createDataFrame(full, SCAN).select(*SCAN_COLUMNS)

    return make


@pytest.fixture
def place(tmp_path):
    return f"t{uuid.uuid4().hex}", str(tmp_path)


TEXTS = ["Pay at PayPal, then log in", "paypal x\nLOGIN now", "Zürich 😀😀 smile", "ab", "", "100%_list here",
         "aXbXc", "İstanbul straße", "note only", "aİbc KELVIN K"]
QUERIES = ["paypal%login", " paypal%LOGIN ", "ab", "", None, "%%", "zürich", "😀😀", "100%_list", "a_b_c",
           "smile%paypal", "nothing like it", "flagged", "STRASSE", "straße", "kelvin", "___", "seen"]


def test_indexed_search_finds_what_a_search_finds(spark, scans, place):
    """Batches go into one block and into others; a list may grow in each of them."""
    name, path = place
    rows = [(i * 37 % 900, TEXTS[i % len(TEXTS)], ["Flagged LINE", "two"] if i % 7 == 0 else [],
             None if i % 3 else "seen by 100%_list", False) for i in range(900)]
    table = scans(rows)
    for batch in (0, 1, 2, 1):  # one of them twice
        search_index.add_to_index(table.filter(F.col("id") % 3 == batch), name, path, bits=6)
    found = 0
    for query in QUERIES:
        for literal in (False, True):
            got = search_index.indexed_search(spark, name, query, literal).collect()
            want = history.search_scans(table, query, literal).collect()
            assert sorted(r.id for r in got) == sorted(r.id for r in want), (query, literal)
            found += len(got)
    assert found
    page = search_index.indexed_page(spark, name, "pay", "Safe", 7).collect()
    assert page == history.history_page(table, "pay", "Safe", 7).collect() and len(page) == 7
    assert spark.table(f"{name}_scans").count() == table.count()
    # An append leaves the lists of earlier batches as they are.
    assert spark.table(f"{name}_postings").filter("gram = 'pay'").groupBy("block").count().filter(
        "count > 1").count() > 0


def test_indexed_search_reads_blocks_of_candidates(spark, scans, place):
    name, path = place
    search_index.add_to_index(
        scans([(i, "rare word" if i == 500 else "plain text", [], None, False) for i in range(1000)]),
        name, path, bits=4)
    found = search_index.indexed_search(spark, name, "rare%word")
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in found.collect()] == [500]


def listed(rows):
    """Ids by block and trigram; a block may have several lists of a trigram, in any order."""
    found = {}
    for r in rows:
        assert r["n"] == len(r["places"])
        ids = [r["base"] + p for p in r["places"]]
        assert ids == sorted(set(ids))
        found.setdefault((r["block"], r["gram"]), []).extend(ids)
    return {k: sorted(v) for k, v in found.items()}


def grams_of(*parts):
    """Trigrams of the parts with ASCII letters in lower case."""
    lower = ["".join(c.lower() if c.isascii() else c for c in p) for p in parts if p is not None]
    return {p[i:i + 3] for p in lower for i in range(len(p) - 2)}


def test_postings_make_no_row_per_trigram(spark, scans):
    """A trigram of a scan is a place in a list, never a row that is shuffled or sorted."""
    rows = [(i, TEXTS[i % len(TEXTS)] + (f" no. {i}" if i % 2 else ""), ["Flagged LINE", "two"] if i % 7 == 0 else [],
             None if i % 3 else "seen \U0001F600\U0001F601x", False) for i in range(300)]
    table = scans(rows).withColumn("block", search_index.block_of(F.col("id"), 5))
    lists = search_index.postings(table, 5)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Generate", "Aggregate", "Exchange", "Sort"))
    want = {}
    for i, text, flags, note, _ in rows:
        for gram in grams_of(text, note, "\n".join(flags)):
            want.setdefault((i >> 5, gram), []).append(i)
    assert listed(r.asDict() for r in lists.collect()) == want


def arrow_batch(ids, block, texts):
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array([block] * len(ids)), pa.array([t and t.encode() for t in texts], pa.binary())],
        names=["id", "block", "part0"])


@pytest.mark.parametrize("bits", [12, 20])
def test_lists_of_runs_and_of_many_letters(monkeypatch, bits):
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    many = [every] + ["Abc abc"] * 8  # too many letters for one number per letters and text
    block, last = 3, (4 << bits) - 1
    ids = [3 << bits, *range(last - 7, last + 1)]
    got = listed(r for b in trigram_lists.block_lists(
        iter([arrow_batch(ids, block, many)]), bits) for r in b.to_pylist())
    assert got[(3, "abc")] == ids and got[(3, " ab")] == ids[1:]
    assert {g for _, g in got} == grams_of(*many)

    monkeypatch.setattr(trigram_lists, "RUN_CHARS", 12)
    monkeypatch.setattr(trigram_lists, "RUN_TEXTS", 3)
    texts = ["", None, "ab", "abcabc", "a longer text than a run", "x", "abc", "", None, "abd"]
    batches = [arrow_batch([0, 1, 2, 3, 4], 0, texts[:5]), arrow_batch([5, 6, 7], 0, texts[5:8]),
               arrow_batch([(1 << bits) + 8, (1 << bits) + 9], 1, texts[8:])]
    got = listed(r for b in trigram_lists.block_lists(iter(batches), bits) for r in b.to_pylist())
    want = {}
    for i, text in enumerate(texts):
        for gram in grams_of(text):
            want.setdefault((i // 8, gram), []).append(i if i < 8 else (1 << bits) + i)
    assert got == want
    assert list(trigram_lists.block_lists(iter([]), bits)) == []


def test_query_grams():
    assert search_index.query_grams("Pay_al%x") == ["pay"]
    assert search_index.query_grams("a%b", literal=True) == ["a%b"]
    assert search_index.query_grams("ab") == []


MAIL = [(1, "see http://a.example/x and http://b.example/y"), (2, "http://a.example/x http://a.example/x"),
        (3, "no link"), (4, "www.c.example/z"), (5, "http://d.example/")]
ENTRIES = [("http://a.example/x", "MALWARE", 4), ("http://b.example/y", None, 6), ("", "MALWARE", 1),
           ("www.c.example/z", "SOCIAL_ENGINEERING", 3), (None, "MALWARE", 2),
           ("http://a.example/x", "UNWANTED_SOFTWARE", 1), ("http://gone.example/", "MALWARE", 5),
           ("http://a.example/x", "MALWARE", 9), ("http://d.example/", "MALWARE", 7)]
ENTRY = "url string, threat_type string, ord long"


@pytest.mark.parametrize("late", [[5], [0, 3], [1, 2, 4, 7], list(range(9)), [], [7], [8]])
def test_index_and_late_entries_equal_the_whole_list(spark, scans, place, late):
    name, path = place
    table = scans([(i, t, [], "", False) for i, t in MAIL])
    for batch in range(2):
        link_index.add_links(table.filter(F.col("id") % 2 == batch), name, path)
    whole = spark.createDataFrame(ENTRIES, ENTRY)
    known = spark.createDataFrame([e for i, e in enumerate(ENTRIES) if i not in late], ENTRY)
    new = spark.createDataFrame([e for i, e in enumerate(ENTRIES) if i in late], ENTRY)
    index = spark.table(name)
    found = link_index.late_hits(index, known, new)
    merged = link_index.merged_hits(link_index.indexed_hits(index, known), found)
    want = enrich.threat_hits(table, whole, "id")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, want.collect()))

    # The findings of checked scans become those of a check with the whole list.
    none = spark.createDataFrame([], "domain string, created_at timestamp_ntz")
    as_of = "2024-02-01 00:00:00"

    def checked(entries):
        return merge_link_findings(table, enrich.check_links(table, entries, none, as_of, "id"))

    def view(df):
        return {r.id: (sorted(r.flags), sorted(f.message for f in r.findings), r.score, r.risk_level,
                       r.network_checked) for r in df.collect()}

    after = link_index.merge_late_findings(checked(known), found)
    assert view(after) == view(checked(whole)) and after.columns == list(SCAN_COLUMNS)
    unchecked = link_index.merge_late_findings(table, found)
    assert view(unchecked) == view(table)


def test_entries_of_a_stream_find_old_scans(spark, scans, place):
    """Files arrive in two runs, so the second meets what the first one knew."""
    name, path = place
    table = scans([(i, t, [], "", False) for i, t in MAIL])
    link_index.add_links(table, name, f"{path}/links")
    order = [8, 3, 0, 5, 1, 2, 4, 7, 6]
    for run, some in enumerate((order[:4], order[4:])):
        for i in some:
            spark.createDataFrame([ENTRIES[i]], ENTRY).coalesce(1).write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        stream_late_threats(arriving, spark.table(name), f"{path}/out", f"{path}/state").awaitTermination()
        seen = spark.createDataFrame([ENTRIES[i] for i in (order[:4] if not run else order)], ENTRY)
        got = standing_hits(spark, f"{path}/out").select("id", "url", "threat", "ord", "message").collect()
        want = enrich.threat_hits(table, seen, "id").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_late_entries_read_no_text(spark, scans, place):
    name, path = place
    link_index.add_links(scans([(i, t, [], "", True) for i, t in MAIL]), name, path)
    entries = spark.createDataFrame(ENTRIES, ENTRY)
    plan = link_index.late_hits(spark.table(name), entries.limit(2), entries)
    assert "email_text" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert THREAT_POINTS > 0


def registry(spark, extra=()):
    rows = [(i, b, b.title(), list(d)) for i, (b, d) in enumerate(BRAND_DOMAINS.items())]
    return spark.createDataFrame([*rows, *extra], "ord long, brand string, title string, official array<string>")


HOSTS = ["paypal.com", "paypal.evil.example", "paypa1.com", "amazom.com", "amazon.co.uk", "ebay.com.example",
         "dhl.com", "dhl-track.net", "wellsfarg0.com", "linkedln.com", "xn--pple-43d.com", "pаypal.com",
         "dropbax.com", "drop-box.work", "g00gle.com", "googel.com", "appl.com", "localhost", "a.b", "netflixx.io",
         "1.2.3.4", "micros0ft.com", "mircosoft.com", "faceboook.com", "instagran.com", "", "usps.com", "upss.com"]


def test_registry_equals_the_literal_form(spark, mails):
    mail = mails(*(f"look: http://{h}/x and https://www.{h}" for h in HOSTS))
    got = {(r.mail_id, r.message) for r in
           brand_registry.registry_spoofs(mail, registry(spark)).collect()}
    script = links.tag_domain_spoofing(mail).collect()
    want = {(r.mail_id, r.message) for r in script
            if "punycode" not in r.message.lower() and "look-alike" not in r.message.lower()}
    want = {(i, m) for i, m in want if any(b.title() in m for b in BRAND_DOMAINS)}
    assert got == want and len(got) > 15


def test_registry_of_many_brands_makes_no_nested_loop(spark):
    draw = random.Random(7)
    names = ["".join(draw.choice("abcde") for _ in range(draw.randrange(1, 12))) for _ in range(4_000)]
    names = sorted(set(names))
    rows = [(100 + i, b, b.title(), [f"{b}.com"] if i % 3 else []) for i, b in enumerate(names)]
    table = registry(spark, [*rows, (99, "", "", [])])
    # The table of 100,000 brands, of which the hosts below resemble none of the numbered ones.
    many = table.unionByName(spark.range(100_000).selectExpr(
        "id + 10000 AS ord", "concat('qq', id, 'zz') AS brand", "'Q' AS title", "array('q.q') AS official"))
    hosts = sorted({draw.choice(names) + draw.choice((".com", ".example.com", "x.org", "-b.net"))
                    for _ in range(60)} | {"a.com", "abcde.com", ""})
    df = brand_registry.alike_hosts(spark.createDataFrame([(h,) for h in hosts], "host string"), many)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.host, r.ord) for r in df.collect()}

    def one_edit(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    want = set()
    brands = [(i, b, o) for i, b, _, o in rows] + [
        (i, b, list(d)) for i, (b, d) in enumerate(BRAND_DOMAINS.items())]
    for h in hosts:
        root = ".".join(h.split(".")[-2:])
        plain = root.split(".")[0]  # letters only, so nothing to replace
        for i, b, official in brands:
            near = len(b) >= 5 and one_edit(plain, b)
            if (b in h or plain == b or near) and root not in official:
                want.add((h, i))
    assert got == want and len(want) > 100
    empty = registry(spark).limit(0)
    assert brand_registry.alike_hosts(spark.createDataFrame([("a.com",)], "host string"), empty).collect() == []


def test_brands_that_begin_alike_meet_only_hosts_that_hold_them(spark):
    """Every host and every brand has the same first letters, as numbered names have."""
    n = 3_000
    brands = spark.range(n).selectExpr(
        "id AS ord", "concat('upgrade-desk', id) AS brand", "'U' AS title",
        "cast(array() AS array<string>) AS official")
    hosts = spark.range(n).selectExpr("concat('upgrade-desk', id * 7, '.\U0001F600x.org') AS host")
    names = brands.select("brand")
    got = [tuple(r) for r in brand_registry._held(hosts, names, [6]).collect()]
    cut = brand_registry._cut(hosts, names, [6]).count()
    names = {f"upgrade-desk{i}" for i in range(n)}
    want = set()
    for i in range(n):
        host = f"upgrade-desk{i * 7}.\U0001F600x.org"
        want |= {(host, host[:k]) for k in range(1, len(host)) if host[:k] in names}
    assert set(got) == want and len(got) == len(want)
    assert cut <= 4 * n  # brands of four sizes, and one place where any of them begins
