"""Changes that rewrite the touched buckets only, against changes of the whole table."""

import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from baitwatch import fixture as X
from baitwatch.operators import scans
from baitwatch.plans import snapshots, spread

ROWS = [(i, f"text {i}" * 10, "" if i % 3 else None) for i in range(200)]
SCHEMA = "id long, email_text string, note string"


def files(path):
    return {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in pathlib.Path(path).rglob("*.parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    snapshots.create(rows, str(tmp_path), 16)
    return rows, str(tmp_path)


def test_changes_equal_those_of_the_whole_table(spark, table):
    rows, path = table
    edits = spark.createDataFrame([(3, 1, " new "), (3, 2, "newer"), (77, 1, "x"), (9_999, 1, "?")],
                                  "id long, seq long, note string")
    gone = spark.createDataFrame([(4,), (3,), (500,), (4,)], "id long")
    fresh = spark.createDataFrame([(1_000, "added", "")], SCHEMA)
    before = files(path)
    assert snapshots.rewrite(spark, path, edits, lambda part: scans.update_notes(part, edits)) == 1
    want = scans.update_notes(rows, edits)
    assert rows_of(snapshots.read(spark, path)) == rows_of(want)
    snapshots.rewrite(spark, path, gone, lambda part: scans.delete_scans(part, gone))
    snapshots.rewrite(spark, path, fresh, lambda part: part.unionByName(fresh))
    want = scans.delete_scans(want, gone).unionByName(fresh)
    assert rows_of(snapshots.read(spark, path)) == rows_of(want)
    assert rows_of(snapshots.read(spark, path, 0)) == rows_of(rows)
    assert snapshots.versions(spark, path) == [0, 1, 2, 3]
    # Nothing that was there is written again, and untouched buckets are named as they are.
    after = files(path)
    assert {f: after[f] for f in before} == before
    names = [{r.bucket: r.folder for r in snapshots._entries(spark, path, v)} for v in (0, 1)]
    assert sum(names[0][b] == names[1].get(b) for b in names[0]) >= 16 - 3


def test_a_failed_change_leaves_the_snapshot(spark, table):
    rows, path = table
    ids = rows.filter("id < 50").select("id")

    def fails(part):
        return part.withColumn("note", F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).cast("string"))

    with pytest.raises(Exception, match="broken"):
        snapshots.rewrite(spark, path, ids, fails)
    assert snapshots.versions(spark, path) == [0]
    assert rows_of(snapshots.read(spark, path)) == rows_of(rows)
    snapshots.rewrite(spark, path, ids, lambda part: part.filter("id >= 50"))
    assert rows_of(snapshots.read(spark, path)) == rows_of(rows.filter("id >= 50"))


def test_the_second_of_two_changes_fails(spark, table):
    rows, path = table
    ids = rows.filter("id = 5").select("id")

    def late(part):
        snapshots.rewrite(spark, path, ids, lambda p: p.withColumn("note", F.lit("first")))
        return part.withColumn("note", F.lit("second"))

    with pytest.raises(Exception, match="exist"):
        snapshots.rewrite(spark, path, ids, late)
    assert rows_of(snapshots.read(spark, path).filter("note = 'second'")) == []
    assert snapshots.versions(spark, path) == [0, 1]


def test_everything_deleted_and_empty_tables(spark, table, tmp_path):
    rows, path = table
    snapshots.rewrite(spark, path, rows, lambda part: part.limit(0))
    assert snapshots.read(spark, path).collect() == []
    snapshots.rewrite(spark, path, rows, lambda part: part.unionByName(rows))
    assert rows_of(snapshots.read(spark, path)) == rows_of(rows)
    empty = str(tmp_path / "empty")
    snapshots.create(rows.limit(0), empty, 4)
    assert snapshots.read(spark, empty).columns == rows.columns
    assert snapshots.buckets_for(rows, "email_text", 1_000) > 10 and snapshots.buckets_for(rows.limit(0), "email_text") == 1


def test_more_text_is_spread_over_more_tasks(spark, monkeypatch):
    """No task gets more than its share, and no join moves the texts again."""
    small = "/root/testdata/sf0.001"
    documents = X.table(spark, small, "documents")
    size = documents.selectExpr("sum(octet_length(text))").first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread.spread(documents, "doc_id").rdd.getNumPartitions() == least
    monkeypatch.setattr(spread, "PART_BYTES", size // 40)
    assert spread.spread(documents, "doc_id").rdd.getNumPartitions() >= 40
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mail = X.mail(spark, small)
        assert mail.rdd.getNumPartitions() >= 40
        plain = X.mail_from(documents, X.table(spark, small, "labels"), X.table(spark, small, "pages"))
        assert sorted(mail.collect()) == sorted(plain.collect()) != []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
