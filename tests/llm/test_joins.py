"""SimHash, sharding, archive and URL filters against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from baitwatch.llm import sharding, simhash, url_filter, warc_archive
from baitwatch.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w)
             for w in (text or "").translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or (
        [" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Smallest id reachable for each (id, fingerprint) by comparing all pairs."""
    found = {}
    values = sorted(set(f for _, f in prints))
    group = {f: {f} for f in values}
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 2 and group[a] is not group[b]:
                merged = group[a] | group[b]
                for f in merged:
                    group[f] = merged
    for f in values:
        ids = [k for k, g in prints if g in group[f] and k is not None]
        found[f] = min(ids, default=None)
    return found


def check_classes(rows, texts):
    prints = [(k, plain_fingerprint(t)) for k, t in texts]
    want = plain_classes(prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == Counter(
        (k, f"{f:016x}", want[f]) for k, f in prints)


def test_simhash_of_the_whole_table(spark):
    texts = [tuple(r) for r in
             spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_classes(simhash.op5_simhash(spark, SF).collect(), texts)


def test_simhash_edge_cases(docs, odd):
    check_classes(simhash.near_duplicates(docs(*odd)).collect(), odd)
    assert simhash.near_duplicates(docs(*odd).limit(0)).collect() == []


def test_links_of_close_fingerprints(spark):
    import random

    draw = random.Random(4)
    values = set()
    for _ in range(40):
        value = draw.getrandbits(64)
        for _ in range(12):
            values.add(value)
            for _ in range(draw.choice((1, 2, 2, 3))):
                value ^= 1 << draw.randrange(64)
    values |= {0, (1 << 64) - 1, 1 << 63, 1}
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(sorted(values))]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    want = plain_classes([(i, v) for i, v in enumerate(sorted(values))])
    assert {(r.fp % (1 << 64)): r.component_id for r in got} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_stays(docs, odd):
    kept = simhash.keep_one_of_each(docs(*odd))
    assert kept.columns == docs(*odd).columns
    want = plain_classes([(k, plain_fingerprint(t)) for k, t in odd])
    got = Counter((r.doc_id, plain_fingerprint(r.text)) for r in kept.collect())
    assert sum(got.values()) == len(got) == len(want)
    assert sorted(got, key=str) == sorted(((want[f], f) for f in want), key=str)
    assert simhash.keep_one_of_each(docs(*odd).limit(0)).collect() == []


def check_shards(rows, texts, shards=8):
    sizes = [len((t or "").encode()) + 1 for _, t in texts]
    want = Counter((k, s, zlib.crc32((t or "").encode())) for (k, t), s in zip(texts, sizes))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    totals = [sum(r.size for r in rows if r.shard == s) for s in range(shards)]
    assert max(totals) - min(totals) <= 2 * max(sizes) + 0.03 * sum(sizes) / shards
    return slots


def test_shards_of_the_whole_table(spark):
    texts = [tuple(r) for r in
             spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(sharding.op2_sharding(spark, SF).collect(), texts)


def test_shard_edge_cases(docs, odd):
    check_shards(sharding.shard(docs(*odd)).collect(), odd)
    assert sharding.shard(docs(*odd).limit(0)).collect() == []


def test_a_group_of_copies_larger_than_a_shard_is_subdivided(docs):
    rows = [(i, "a copied text of some length") for i in range(2000)]
    rows += [(10_000 + i, f"a text of its own, number {i}") for i in range(2000)]
    rows += [(7, "one repeated row")] * 900
    check_shards(sharding.shard(docs(*rows)).collect(), rows)


def test_equal_texts_stay_together_and_runs_agree(docs):
    rows = [(i, f"text {i // 3}") for i in range(3000)]
    first = sharding.shard(docs(*rows)).collect()
    where = defaultdict(set)
    for r in first:
        where[r.text_crc32].add(r.shard)
    assert all(len(own) == 1 for own in where.values())
    again = sharding.shard(docs(*rows)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in first} == {
        (r.doc_id, r.shard, r.slot) for r in again}


PAGES = [
    (5, "http://a.example/x", "<p>same</p>"), (3, "http://b.example/", "<p>same</p>"),
    (9, "http://c.example/", "<p>same</p>"), (4, None, None), (6, "http://d.example/", ""),
    (7, "http://e.example/\r\nWARC-Type: x", "own ß \U0001f600"), (8, "", "L" * 50_000),
    (8, "", "L" * 50_000), (None, "http://f.example/", "no id"), (None, "http://g.example/", "<p>same</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns(
        {"digest": F.lit(1), "payload": F.lit("x"), "first": F.lit(2)})


def test_archive_round_trip(spark, pages):
    archive = warc_archive.write_archive(pages)
    rows = warc_archive.read_archive(spark, archive).collect()
    first = {}
    for k, _, html in PAGES:
        own = first.setdefault(html or "", k)
        if k is not None and (own is None or k < own):
            first[html or ""] = k
    want = Counter()
    for k, _, html in PAGES:
        data = (html or "").encode()
        response = k is None or first[html or ""] == k
        want[k, len(data), warc_archive.base32_sha1(data),
             "response" if response else "revisit", None if response else first[html or ""]] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    texts = Counter((k, html or "") for k, _, html in PAGES)
    for r in rows:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert texts[r.page_id, body.decode()] and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        assert "\n" not in r.target_uri
    stored = spark.read.parquet(archive.payloads)
    assert stored.count() == len(first)


def test_changed_payload_is_noticed(spark, pages, tmp_path):
    archive = warc_archive.write_archive(pages)
    broken = spark.read.parquet(archive.payloads).withColumn(
        "packed", F.when(F.col("digest") == F.lit(bytearray(hashlib.sha256(b"no id").digest())),
                         F.lit(bytearray(zlib.compress(b"other")))).otherwise(F.col("packed")))
    broken.write.parquet(str(tmp_path / "broken"))
    with pytest.raises(Exception, match="has changed"):
        warc_archive.read_archive(
            spark, archive._replace(payloads=str(tmp_path / "broken"))).collect()


def test_archive_of_short_payloads_and_of_nothing(spark, pages):
    archive = warc_archive.write_archive(pages, min_revisit_bytes=100)
    types = Counter(r.record_type for r in warc_archive.read_archive(spark, archive).collect())
    assert types == {"response": len(PAGES)}
    empty = warc_archive.write_archive(pages.limit(0))
    assert warc_archive.read_archive(spark, empty).collect() == []


def day(n):
    return datetime(2024, 1, n)


ENTRIES = [
    ("l1", "host", "a.example.org", "add", day(3)), ("l1", "host", "a.example.org", "remove", day(5)),
    ("l1", "host", "a.example.org", "remove", day(5)), ("l1", "host", "a.example.org", "add", day(20)),
    ("l2", "domain", "example.org", "add", day(4)), ("l2", "domain", "example.org", "add", day(6)),
    ("l2", "prefix", "b.example.org/x/y", "add", day(1)),
    ("l3", "host", "c.example.org", "add", day(2)), ("l3", "host", "c.example.org", "remove", day(2)),
    (None, "host", "d.example.org", "add", day(2)), ("l3", "host", None, "add", day(2)),
    ("l3", "host", "e.example.org", "other", day(2)), ("l3", "host", "e.example.org", "add", None),
]
CAPTURES = [
    (1, "http://a.example.org/", day(2)), (2, "http://a.example.org/", day(3)),
    (3, "HTTP://u:p@A.example.org.:80/q?x#y", day(5)), (4, "http://a.example.org", day(25)),
    (5, "http://b.example.org/x/y/z.html", day(2)), (6, "http://b.example.org/x/yy", day(2)),
    (7, "http://c.example.org/", day(3)), (8, None, day(3)), (9, "http://a.example.org/", None),
    (10, "", day(3)), (11, "no url", day(3)), (12, "http://a.example.org/", day(3)),
    (12, "http://a.example.org/", day(3)), (None, "http://d.example.org/", day(3)),
    (13, "http://b.example.org/" + "s/" * 3000, day(3)),
]


def listed(kind, pattern, url):
    rest = url.partition("://")[2]
    host = rest.split("/")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
    path = "/".join(p for p in rest.partition("/")[2].split("?")[0].split("#")[0].split("/") if p)
    if kind == "host":
        return host == pattern
    if kind == "domain":
        return host == pattern or host.endswith("." + pattern)
    return f"{host}/{path}/".startswith(pattern + "/")


def plain_filter(url, at):
    hits = []
    if url and at:
        for name, kind, pattern in {e[:3] for e in ENTRIES if None not in e}:
            past = [(e[4], e[3]) for e in ENTRIES if e[:3] == (name, kind, pattern)
                    and None not in e and e[4] <= at and e[3] in ("add", "remove")]
            if past and max(past)[1] == "add" and listed(kind, pattern, url):
                hits.append((name, max(past)[0]))
    return bool(hits), len(hits), min((h[0] for h in hits), default=None), min(
        (h[1] for h in hits), default=None)


@pytest.mark.parametrize("days", [1, 7, 400])
def test_filters_against_all_entries(spark, days):
    entries = spark.createDataFrame(
        ENTRIES, "list_name string, kind string, pattern string, action string, at timestamp")
    captures = spark.createDataFrame(CAPTURES, "id long, url string, fetched_at timestamp")
    captures = captures.withColumns({"kind": F.lit("k"), "pattern": F.lit(1), "bucket": F.lit(2)})
    got = url_filter.filter_captures(captures, entries, bucket_days=days)
    assert got.columns[:6] == captures.columns
    names = ("id", "url", "fetched_at", "blocked", "n_matches", "first_list", "listed_since")
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(
        (*c, *plain_filter(c[1], c[2])) for c in CAPTURES)
    nothing = url_filter.filter_captures(captures, entries.limit(0)).collect()
    assert len(nothing) == len(CAPTURES) and not any(r.blocked for r in nothing)
    assert url_filter.filter_captures(captures.limit(0), entries).collect() == []


def test_hot_pattern_with_many_events(spark):
    events = [("l", "host", "a.example.org", ("add", "remove")[i % 2], datetime(2024, 1, 1, i // 60, i % 60))
              for i in range(600)]
    captures = [(i, "http://a.example.org/", datetime(2024, 1, 1, i // 60, i % 60, 30)) for i in range(700)]
    got = url_filter.filter_captures(
        spark.createDataFrame(captures, "id long, url string, fetched_at timestamp"),
        spark.createDataFrame(events, "list_name string, kind string, pattern string, action string, at timestamp"))
    assert {r.id for r in got.collect() if r.blocked} == set(range(0, 600, 2))


def test_a_payload_that_half_of_all_pages_share(spark):
    """Its bytes are stored once, and each of its records is put together again."""
    rows = [(i, f"http://h{i}.example/", "same <b>page</b>" * 50 if i % 2 else f"page {i}")
            for i in range(3_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc_archive.write_archive(pages)
    assert spark.read.parquet(archive.payloads).count() == 1_501
    found = warc_archive.read_archive(spark, archive).collect()
    types = Counter(r.record_type for r in found)
    assert types == {"response": 1_501, "revisit": 1_499} and len(found) == 3_000
    assert {r.refers_to for r in found if r.record_type == "revisit"} == {1}
    for r in found:
        assert bytes(r.record).endswith(b"\r\n\r\n" + rows[r.page_id][2].encode())


def test_large_groups_and_a_passage_that_many_share(spark, docs):
    """Copies cost a row each, and what documents only share a passage of stays."""
    import random

    draw = random.Random(12)
    prose = lambda n: " ".join(f"w{draw.randrange(5_000)}" for _ in range(n))
    passage, page = prose(60), prose(300)
    rows = [(i, page) for i in range(3_000)]
    rows += [(5_000 + i, f"{page} {'x' * (i % 7)}".strip()) for i in range(500)]
    rows += [(10_000 + i, f"{prose(40)} {passage} {prose(40)}") for i in range(400)]
    prints = [(k, simhash.fingerprint(t) % (1 << 64)) for k, t in rows]
    want = plain_classes(prints)
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs(*rows)).collect()}
    assert kept == set(want.values()) and {10_000 + i for i in range(400)} <= kept
    assert 0 in kept and len(kept) <= 400 + 7
