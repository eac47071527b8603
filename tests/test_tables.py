"""Corpora, evaluation, enrichment, scan table, files and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from baitwatch.operators import corpus, enrich, evaluate, history, scans
from baitwatch.operators.validate import quarantined_mail
from baitwatch.plans.hash_sample import seeded_hash, smallest_by_hash
from baitwatch.plans.lookup import side_lookup
from baitwatch.plans.scan_store import store_scans
from baitwatch.plans.session import work_folder
from baitwatch.sources import datasets, exports
from baitwatch.streaming.scan_stream import stream_link_check, stream_quarantine, stream_scan



def AT():
    return F.lit("2024-02-01 10:11:12").cast("timestamp_ntz")



@pytest.mark.parametrize("n", [0, 1, 7, 100, 999, 5000])
def test_hash_sample_equals_the_plain_form(spark, n):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    plain = rows.withColumn("h", seeded_hash(5, "k")).orderBy("h", "k").limit(n)
    assert {r.k for r in smallest_by_hash(rows, n, 5, "k").collect()} == {
        r.k for r in plain.collect()}


def raw(spark):
    rows = [(i, s, label, f" subject {i} ", None if i % 5 == 0 else f"body {i}")
            for i, (s, label) in enumerate(
                [(s, label) for s in ("Enron", "Nazario", "CEAS_08") for label in ("0", "1", "2")]
                * 20)]
    rows.append((1000, "Enron", "0", " ", None))
    return spark.createDataFrame(
        rows, "row_id long, source string, label string, subject string, body string")


def test_corpora(spark):
    df = raw(spark)
    assert corpus.compose_mail(df).count() == 180
    first = {r.row_id: r.email_text for r in corpus.compose_mail(df).collect()}
    assert first[0] == "subject 0" and first[1] == "subject 1\n\nbody 1"
    assert {tuple(r) for r in corpus.label_counts(corpus.pool_labelled(df)).collect()} == {
        ("phishing", 60), ("legitimate", 60)}
    assert {tuple(r) for r in corpus.label_counts(corpus.pool_focused(df)).collect()} == {
        ("phishing", 60), ("legitimate", 40)}
    splits = corpus.focused_splits(df, per_class=15)
    got = {tuple(r) for r in splits.groupBy("label", "split").count().collect()}
    assert got == {(c, s, 15) for c in ("phishing", "legitimate") for s in ("tuning", "holdout")}
    assert corpus.split_overlap(splits).first() == (30, 30, 0)


def scored(spark, rows):
    return spark.createDataFrame(rows, "actual string, score int, risk_level string, source string")


def test_confusion_and_sweep(spark):
    rows = [("phishing", 7, "Dangerous", "Nazario"), ("phishing", 1, "Safe", "Enron"),
            ("legitimate", 3, "Suspicious", "Enron"), ("legitimate", 0, "Safe", "Enron"),
            ("phishing", 4, "Suspicious", "Enron")]
    r = evaluate.confusion_matrix(scored(spark, rows)).first()
    assert (r.true_positive, r.false_positive, r.true_negative, r.false_negative) == (2, 1, 1, 1)
    assert (r.accuracy, r.precision, r.recall) == (3 / 5, 2 / 3, 2 / 3)
    assert r.risk_levels == {"Safe": 2, "Suspicious": 2, "Dangerous": 1}
    sweep = evaluate.threshold_sweep(scored(spark, rows)).collect()
    recalls = [x.recall for x in sweep]
    assert [x.threshold for x in sweep] == list(range(1, 13))
    assert recalls == sorted(recalls, reverse=True) and recalls[3] == 2 / 3
    assert [x.in_use for x in sweep if x.in_use] == ["suspicious", "dangerous"]
    df = scored(spark, rows).withColumnRenamed("actual", "label")
    kinds = {r.kind: tuple(r)[1:] for r in evaluate.kind_recall(df).collect()}
    assert kinds == {"phishing": (1, 1 / 3, 1.0), "spam": (2, 2 / 3, 0.5)}
    assert [r.source for r in evaluate.source_breakdown(df).collect()] == ["Enron", "Nazario"]


def test_empty_evaluation_gives_zeros(spark):
    r = evaluate.confusion_matrix(scored(spark, [])).first()
    assert (r.total, r.accuracy, r.f1_score, r.risk_levels) == (0, 0.0, 0.0, {})
    empty = spark.createDataFrame([], "label string, email_text string")
    rates = evaluate.rule_hit_rates(empty).collect()
    assert len(rates) == 28 and all(x.phishing_pct == 0.0 for x in rates)


def test_enrichment_with_a_hot_link(spark, mails):
    """One link in every mail: results are whole and equal to a plain lookup."""
    texts = [f"http://hot.example/x http://hot.example/x http://d{i}.top/ http://e{i}.top/ "
             f"http://f{i}.top/ http://g{i}.top/" for i in range(60)]
    texts.append("no link")
    threats = spark.createDataFrame(
        [("http://hot.example/x", "B_B", 2), ("http://hot.example/x", "SOCIAL_ENGINEERING", 1),
         (None, "M", 0), ("http://f3.top/", None, 5), ("http://unseen/", "M", 6)],
        "url string, threat_type string, ord int")
    base = dt.datetime(2024, 2, 1)
    reg = [(f"d{i}.top", base - dt.timedelta(days=i, microseconds=i % 2)) for i in range(60)]
    reg += [("g1.top", base), ("e5.top", None), ("e6.top", base + dt.timedelta(hours=1))]
    domains = spark.createDataFrame(reg, "domain string, created_at timestamp_ntz")
    got = {r.mail_id: r for r in enrich.check_links(
        mails(*texts), threats, domains, "2024-02-01 00:00:00").collect()}
    assert set(got) == set(range(60))
    for i in range(60):
        expected = ["Google Safe Browsing flagged 'http://hot.example/x' as a known social "
                    "engineering site"]
        if i == 3:
            expected.append("Google Safe Browsing flagged 'http://f3.top/' as a known threat site")
        points = 5 * len(expected)
        if i < 30:
            expected.append(f"Domain 'd{i}.top' was registered only {i} day(s) ago, which is common "
                            "for phishing sites")
            points += 2
        if i == 1:
            expected.append("Domain 'g1.top' was registered only 0 day(s) ago, which is common "
                            "for phishing sites")
            points += 2
        if i == 6:
            expected.append("Domain 'e6.top' was registered only -1 day(s) ago, which is common "
                            "for phishing sites")
            points += 2
        assert [f.message for f in got[i].link_findings] == expected
        assert got[i].points == points


def test_domain_cap_and_array_dates(spark, mails):
    rows = enrich.capped_domains(mails("http://a.x http://b.a.x http://c.y www.d.z http://e.w"))
    assert [(r.pos, r.domain) for r in rows.orderBy("pos").collect()] == [
        (1, "a.x"), (2, "c.y"), (3, "d.z")]
    reg = spark.createDataFrame(
        [("a.x", [dt.datetime(2024, 1, 31), dt.datetime(2000, 1, 1)])],
        "domain string, created_at array<timestamp_ntz>")
    hit = enrich.new_domain_hits(mails("http://a.x"), reg, "2024-02-01 00:00:00").first()
    assert hit.age_days == 1


@pytest.fixture(scope="module")
def table(spark, mails):
    texts = ["Kindly verify your account at http://w1.top/", "hello", "   ",
             "Dear Customer, 100%_off www.x.org"]
    rows = scans.new_scans(mails(*texts), AT(), feed=0)
    return rows.withColumn("id", F.col("id") - 1).cache()


def test_append_keeps_invalid_mail_out(table, mails):
    assert [r.id for r in table.orderBy("id").collect()] == [0, 1, 3]
    grown = scans.append_scans(table, mails("new", " ", "newer"), AT()).orderBy("id").collect()
    first = 1 + scans.FEED_SPAN
    assert [r.id for r in grown] == [0, 1, 3, first, first + 2]
    assert grown[-1].created_at == dt.datetime(2024, 2, 1, 10, 11) and grown[-1].note == ""


def test_mail_of_any_length_is_kept_unless_a_limit_is_set(mails):
    df = mails("x" * 20001, "y" * 300_000, " ", "short")
    assert {r.id for r in scans.new_scans(df, AT(), feed=0).collect()} == {1, 2, 4}
    kept = scans.new_scans(df, AT(), feed=0, max_chars=20000).collect()
    out = quarantined_mail(df, 20000).collect()
    assert {r.id - 1 for r in kept} | {r.mail_id for r in out} == {0, 1, 2, 3}
    assert {r.mail_id: "long" in r.error for r in out} == {0: True, 1: True, 2: False}


def test_every_domain_of_a_mail_is_looked_up(spark, mails):
    df = mails(" ".join(f"http://n{i}.top/" for i in range(10)))
    reg = spark.createDataFrame([(f"n{i}.top", dt.datetime(2024, 1, 30)) for i in range(10)],
                                "domain string, created_at timestamp_ntz")
    threats = spark.createDataFrame([], "url string, threat_type string, ord int")
    as_of = "2024-02-01 00:00:00"
    assert enrich.new_domain_hits(df, reg, as_of).count() == 10
    assert enrich.new_domain_hits(df, reg, as_of, domains_per_mail=3).count() == 3
    assert enrich.check_links(df, threats, reg, as_of).first().points == 20


def test_merge_keeps_flags_of_rows_without_findings(spark, table):
    stored = table.limit(1).withColumns({
        "id": F.lit(7), "flags": F.array(F.lit("an old flag")),
        "findings": F.slice("findings", 1, 0), "network_checked": F.lit(False)})
    rows = stored.unionByName(stored.withColumn("id", F.lit(8)))
    found = F.array(F.struct(*[F.lit("safe_browsing").alias("rule"), F.lit("link_manipulation")
                               .alias("category"), F.lit("new").alias("message"), F.lit("").alias("match")]))
    hits = spark.range(7, 8).select("id", found.cast(rows.schema["findings"].dataType)
                                    .alias("link_findings"), F.lit(5).alias("points"))
    merged = {r.id: r for r in scans.merge_link_findings(rows, hits).collect()}
    assert merged[7].flags == ["an old flag", "new"] and merged[8].flags == ["an old flag"]
    assert [f.message for f in merged[7].findings] == ["an old flag", "new"]


def test_local_folder_needs_a_local_master():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="shared folder"):
        work_folder(Session, "x")


def test_merge_is_idempotent(spark, table):
    threats = spark.createDataFrame([("http://w1.top/", "MALWARE", 1)],
                                    "url string, threat_type string, ord int")
    reg = spark.createDataFrame([("w1.top", dt.datetime(2024, 1, 30))],
                                "domain string, created_at timestamp_ntz")

    def merge(df):
        hits = enrich.check_links(
            enrich.link_check_queue(df), threats, reg, "2024-02-01 00:00:00", "id")
        return scans.merge_link_findings(df, hits)

    first = merge(table)
    rows = {r.id: r for r in first.collect()}
    before = {r.id: r for r in table.collect()}
    assert rows[0].score == before[0].score + 7 and rows[0].risk_level == "Dangerous"
    assert [f.rule for f in rows[0].findings][-2:] == ["safe_browsing", "new_domain"]
    assert rows[0].flags == [f.message for f in rows[0].findings]
    assert all(r.network_checked for r in rows.values()) and rows[1].score == before[1].score
    assert sorted(merge(first).collect()) == sorted(first.collect())


def test_notes_deletes_and_search(spark, table):
    edits = spark.createDataFrame(
        [(0, 1, " first "), (0, 2, "second"), (0, 3, "n" * 2001), (1, 1, "m" * 2000), (3, 1, None),
         (77, 1, "lost")], "id long, seq long, note string")
    noted = scans.update_notes(table, edits)
    assert {r.id: r.note for r in noted.collect()} == {0: "second", 1: "m" * 2000, 3: ""}
    assert {(r.id, r.seq, r.error) for r in scans.rejected_notes(table, edits).collect()} == {
        (0, 3, "Note is too long (max 2000 characters)."), (77, 1, "Scan not found")}
    gone = spark.createDataFrame([(0,), (9,), (9,)], "id long")
    assert {r.id for r in scans.delete_scans(table, gone).collect()} == {1, 3}
    assert [r.id for r in scans.missing_deletes(table, gone).collect()] == [9]

    def found(query, **kw):
        return {r.id for r in history.search_scans(noted, query, **kw).collect()}

    assert found(" SECOND ") == {0} and found("") == {0, 1, 3} and found("d_ar%off") == {3}
    assert found("d_ar%off", literal=True) == set() and found("100%_", literal=True) == {3}
    assert found("greeting INSTEAD") == {3}
    assert [r.id for r in history.newest(table, 2).collect()] == [3, 1]
    assert history.newest(table.filter("id < 0"), 2).collect() == []
    assert history.filter_risk(table, "Unknown").count() == 3
    totals = {r.risk_level: r.scans for r in history.risk_totals(table).collect()}
    assert totals["all"] == 3 and sum(totals.values()) == 6


def test_older_rows(spark):
    old = spark.createDataFrame(
        [(1, "a\n\nb", '[{"rule":"r","category":"prize","message":"m"}]'), (2, "a\nb", "{bad"),
         (3, "", None), (4, "x", '[{"rule":"r","category":"gone","message":"m","match":""}]')],
        "id long, flags string, findings string")
    df = scans.evolve_schema(old)
    assert df.columns == [*old.columns, "network_checked"]
    rows = {r.id: [tuple(f) for f in r.findings] for r in scans.restore_findings(df).collect()}
    assert rows == {
        1: [("r", "prize", "m", "")], 3: [], 4: [("legacy", "informational", "x", "")],
        2: [("legacy", "informational", "a", ""), ("legacy", "informational", "b", "")]}
    assert "findings" in scans.evolve_schema(old.drop("findings")).columns


def test_files(spark, table, tmp_path):
    rows = [("phishing", 'He said "x",\nthen\r\nleft'), ("legitimate", "ünï"),
            ("phishing", "y" * 200000)]
    df = spark.createDataFrame(rows, "label string, email_text string")
    path = str(tmp_path / "set.csv")
    counts = datasets.write_labelled(df, path)
    assert {tuple(r) for r in counts.collect()} == {("phishing", 2), ("legitimate", 1)}
    back = datasets.read_labelled(spark, path)
    assert {tuple(r) for r in back.collect()} == set(rows)
    assert datasets.load_split(back, "phishing").count() == 2
    bad = tmp_path / "bad.tsv"
    bad.write_bytes(b"text\tother\nx\ty\n")
    with pytest.raises(ValueError, match="bad.tsv is missing required columns: email_text, label"):
        datasets.read_labelled(spark, str(bad))
    with pytest.raises(ValueError):
        datasets.read_labelled(spark, "x.xlsx")
    tsv = tmp_path / "ok.tsv"
    tsv.write_bytes(b"label\temail_text\nham\tcaf\xff\n")
    assert datasets.read_labelled(spark, str(tsv)).first() == ("ham", "caf�")
    one = tmp_path / "c.csv"
    one.write_text("subject,body,label,extra\ns,b,1,z\n")
    two = tmp_path / "d.csv"
    two.write_text("label,body\n0,q\n")
    rows = datasets.read_corpora(spark, {"A": str(one), "B": str(two)}).collect()
    assert {tuple(r) for r in rows} == {("A", "1", "s", "b"), ("B", "0", None, "q")}
    exports.export_csv(table, str(tmp_path / "flat"))
    exports.export_json(table, str(tmp_path / "nested"))
    flat = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "flat"))
    assert flat.columns == ["id", "created_at", "risk_level", "score", "note", "flags", "email_text"]
    nested = spark.read.json(str(tmp_path / "nested")).filter("id = 0").first()
    assert nested.findings[0].category_label == "Requests credentials or personal data"


def test_stream_equals_batch(spark, mails, tmp_path):
    df = mails("Verify your account http://bit.ly/x", " ", "Dear Sir, act now", "x" * 30000)
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream_scan(source, out, state, received_at=AT()).awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(scans.new_scans(df, AT()).collect())
    stream_scan(source, out, state, received_at=AT()).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    rejects = str(tmp_path / "rejects")
    stream_quarantine(source, rejects, str(tmp_path / "state2"), 20000).awaitTermination()
    assert {r.mail_id for r in spark.read.parquet(rejects).collect()} == {1, 3}


def exchanged(df):
    """Columns below each shuffle of a plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    for i, line in enumerate(lines):
        if "Exchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_changes_by_id_do_not_move_the_texts(spark, table, tmp_path):
    stored = store_scans(table, "scans_in_buckets", str(tmp_path / "scans"), buckets=4)
    edits = spark.createDataFrame([(0, 1, "new")], "id long, seq long, note string")
    hits = stored.select("id", F.col("findings").alias("link_findings"), F.lit(5).alias("points"))
    changed = (scans.update_notes(stored, edits), scans.delete_scans(stored, edits),
               scans.merge_link_findings(stored, hits))
    old = {k: spark.conf.get(k) for k in (
        "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for df in changed:
            df = df.select("*")
            assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
            assert not any("email_text" in part for part in exchanged(df))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.id for r in changed[1].collect()} == {1, 3}
    spark.sql("DROP TABLE scans_in_buckets")


def test_a_hot_link_is_split_by_its_size(spark):
    facts = spark.range(200_000).select(
        F.concat(F.lit("http://"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(
            F.col("id").cast("string"))).alias("url"), F.col("id").alias("mail"),
        F.sha2(F.col("id").cast("string"), 256).alias("more"))
    side = spark.range(1000).select(F.concat(F.lit("http://"), (F.col("id") * 3).cast("string"))
                                    .alias("url")).union(spark.sql("SELECT 'http://hot'"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "500k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = side_lookup(facts, side, ["url"])
        assert len(df.collect()) == 133_333 + 1000
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_results_are_written(spark, tmp_path):
    df = spark.createDataFrame([(3, 0.5, "in use"), (6, 0.25, "")], "threshold int, recall double, x string")
    datasets.write_results(df, str(tmp_path / "results"))
    assert sorted(spark.read.json(str(tmp_path / "results")).select(*df.columns).collect()) == [
        (3, 0.5, "in use"), (6, 0.25, "")]


def test_streams_into_a_table_with_rows_and_repeated_batches(spark, mails, tmp_path):
    """A feed of its own never collides with stored rows, and a batch that runs again
    leaves one result."""
    out, checked = str(tmp_path / "scans"), str(tmp_path / "checked")
    scans.new_scans(mails("stored http://w1.top/", "stored too"), AT(), feed=0).write.parquet(f"{out}/feed=0")
    df = mails("arrived http://w1.top/", "arrived too")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream_scan(source, f"{out}/feed=1", str(tmp_path / "s1"), received_at=AT()).awaitTermination()
    ids = [r.id for r in spark.read.parquet(out).collect()]
    assert len(ids) == len(set(ids)) == 4
    threats = spark.createDataFrame([("http://w1.top/", "MALWARE", 1)],
                                    "url string, threat_type string, ord int")
    reg = spark.createDataFrame([], "domain string, created_at timestamp_ntz")
    rounds = []
    for turn in ("s2", "s3"):
        stream_link_check(spark, out, checked, str(tmp_path / turn), threats, reg,
                          "2024-02-01 00:00:00").awaitTermination()
        rounds.append(sorted((r.id, r.score, r.network_checked)
                             for r in spark.read.parquet(checked).collect()))
    assert rounds[0] == rounds[1] and [r[0] for r in rounds[0]] == sorted(ids)
    assert all(r[2] for r in rounds[0])


def test_work_folders_have_one_parent_that_can_be_removed(spark, tmp_path):
    import os

    from baitwatch.plans.session import discard

    one, other = work_folder(spark, "x"), work_folder(spark, "x")
    assert one != other and os.path.dirname(one) == os.path.dirname(other)
    for folder in (one, other):
        spark.range(3).write.parquet(folder)
    discard(spark, one)
    local = other.removeprefix("file:")
    assert not os.path.exists(one.removeprefix("file:")) and os.path.exists(local)
    with pytest.raises(ValueError, match="no work folder"):
        discard(spark, str(tmp_path))
