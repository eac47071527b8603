"""Mail that arrives twice, and files with damaged rows."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from baitwatch import catalog
from baitwatch.sources import damaged
from baitwatch.streaming.scan_stream import first_arrivals, stream_scan

START = dt.datetime(2024, 2, 1)


def arrivals(spark, folder, rows):
    """Mail as (number, minute) below ``folder``."""
    spark.createDataFrame(
        [(i, f"mail number {i}", START + dt.timedelta(minutes=m)) for i, m in rows],
        "mail_id long, email_text string, sent timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_a_repeat_inside_the_bound_is_stored_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))

    def run():
        mail = spark.readStream.schema("mail_id long, email_text string, sent timestamp").parquet(inbox)
        query = stream_scan(first_arrivals(mail, "sent", "30 minutes"), out, state)
        query.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return sorted(r.id & 0xFFFF for r in spark.read.parquet(out).collect()), kept[-1]

    arrivals(spark, inbox, [(i, i % 5) for i in range(100)] + [(7, 6), (8, 1)])
    stored, kept = run()
    assert stored == [i + 1 for i in range(100)] and kept == 100
    arrivals(spark, inbox, [(3, 20), (200, 21)])  # a second run meets the state of the first
    stored, _ = run()
    assert stored == [i + 1 for i in range(100)] + [201]
    # The watermark passes all of them, so their keys leave the state.
    arrivals(spark, inbox, [(300, 600)])
    run()
    arrivals(spark, inbox, [(301, 601)])
    stored, kept = run()
    assert stored[-2:] == [301, 302] and kept < 10


def write(tmp_path, name, data):
    folder = tmp_path / "files"
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder / name)


def test_damaged_rows_are_counted_and_kept(spark, tmp_path):
    path = write(tmp_path, "mixed.csv", (
        b"label,email_text\n"
        b"spam,plain\n"
        b"spam\n"
        b'ham,"two\nlines, ""quoted"""\n'
        b"ham,one,two\n"
        b"ham,caf\xe9\n"
        b"ham,caf\xc3\xa9\n"
        b",\n"))
    checked = damaged.read_checked(spark, path)
    rows = [tuple(r)[:3] for r in checked.collect()]
    assert [r[2] for r in rows] == [None, "ragged", None, "ragged", "undecodable", None, None]
    assert [r[:2] for r in rows if r[2] is None] == [
        ("spam", "plain"), ("ham", 'two\nlines, "quoted"'), ("ham", "café"), (None, None)]
    assert tuple(damaged.damage(checked).drop("file").first()) == (7, 4, 2, 1)
    records = [r.record for r in checked.filter("problem = 'ragged'").collect()]
    assert records[0].strip() == "spam" and records[1].strip() == "ham,one,two"
    damaged.quarantine(checked, str(tmp_path / "bad"))
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert bad.count() + damaged.sound_rows(checked).count() == 7
    assert all(r.file.endswith("mixed.csv") for r in bad.collect())


def test_damage_is_told_by_file(spark, tmp_path):
    write(tmp_path, "a.tsv", b"label\temail_text\tnote\nspam\tx\ty\nspam\tx\n")
    write(tmp_path, "b.tsv", b"label\temail_text\tnote\nham\tx\ty\n")
    folder = tmp_path / "files.tsv"
    (tmp_path / "files").rename(folder)
    got = {r.file.rsplit("/", 1)[-1]: tuple(r)[1:] for r in
           damaged.damage(damaged.read_checked(spark, str(folder))).collect()}
    assert got == {"a.tsv": (2, 1, 1, 0), "b.tsv": (1, 1, 0, 0)}


def test_a_file_without_the_columns_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="email_text"):
        damaged.read_checked(spark, write(tmp_path, "c.csv", b"label,text\nspam,x\n"))
    named = damaged.read_checked(spark, write(tmp_path, "d.csv", b"spam,x\nham,y\n"), ("label", "email_text"))
    assert named.filter(F.col("problem").isNull()).count() == 2


@pytest.mark.parametrize("name", ["stream_scan", "stream_resubmitted", "stream_link_check"])
def test_a_table_in_several_files_is_streamed_like_one_file(spark, tmp_path, name):
    small = "/root/testdata/sf0.001"
    for path in glob.glob(f"{small}/*.parquet"):
        if not path.endswith("/documents.parquet"):
            os.symlink(path, tmp_path / os.path.basename(path))
    documents = spark.read.parquet(f"{small}/documents.parquet")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    query = catalog.queries()[name]
    assert sorted(query(spark, str(tmp_path)).collect()) == sorted(query(spark, small).collect()) != []
