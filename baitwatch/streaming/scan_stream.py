"""Scoring mail on arrival and checking links afterwards, with Structured Streaming.

Detection is row-local, so a stream runs the very expressions of a batch and keeps no
state. Link checks join each micro-batch with the static side tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from baitwatch.operators.enrich import check_links, link_check_queue
from baitwatch.operators.link_index import late_hits
from baitwatch.operators.scans import merge_link_findings, new_scans
from baitwatch.operators.validate import quarantined_mail


def stream_scan(
    mail: DataFrame, out_path: str, checkpoint: str, received_at=None, trigger=None,
    feed: int = 1, max_chars: int | None = None,
) -> StreamingQuery:
    """Appends a scan row to ``out_path`` for each valid mail of a stream.

    Ids are those a batch over the same feed assigns. A stream lists its files in a log
    that hides others in its folder, so each feed of a table has a folder of its own.
    """
    when = F.current_timestamp() if received_at is None else received_at
    return _append(new_scans(mail, when, feed, max_chars), out_path, checkpoint, trigger)


def first_arrivals(
    mail: DataFrame, sent: str, within: str, keys: tuple[str, ...] = ("mail_id",)
) -> DataFrame:
    """A stream without mail that is handed in again within a time of its first arrival.

    The state holds a key of each mail until the watermark, ``within`` behind the latest
    ``sent``, has passed it; no text is kept. A feed's number is unique there, so streams of
    several feeds have both in ``keys``. Mail sent again later than that is stored again
    under the id it had.
    """
    return mail.withWatermark(sent, within).dropDuplicatesWithinWatermark(list(keys))


def stream_quarantine(
    mail: DataFrame, out_path: str, checkpoint: str, max_chars: int | None = None, trigger=None
) -> StreamingQuery:
    """The second sink of a stream: mail that ``stream_scan`` leaves out, with the reason."""
    return _append(quarantined_mail(mail, max_chars), out_path, checkpoint, trigger)


def _append(rows: DataFrame, out_path: str, checkpoint: str, trigger) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start(out_path)
    )


def stream_link_check(
    spark: SparkSession, scans_path: str, out_path: str, checkpoint: str,
    threat_list: DataFrame, domain_reg: DataFrame, as_of: str, trigger=None,
) -> StreamingQuery:
    """Writes each arriving scan to ``out_path`` with its link findings merged in.

    A batch that runs again replaces its own folder, and scans that are already
    checked pass unchanged.
    """
    schema = spark.read.parquet(scans_path).schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        hits = check_links(link_check_queue(batch), threat_list, domain_reg, as_of, key="id")
        merge_link_findings(batch, hits).write.mode("overwrite").parquet(
            f"{out_path}/batch={batch_id}"
        )

    return (
        spark.readStream.schema(schema).parquet(scans_path).writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_late_threats(
    entries: DataFrame, index: DataFrame, out_path: str, checkpoint: str, key: str = "id",
    trigger=None,
) -> StreamingQuery:
    """Finds the stored scans that arriving threat entries concern, from the link index alone.

    Each batch stores its entries and the hits that are new or changed with them; earlier
    batches are what was known. A batch that runs again replaces what it stored.
    """
    spark = entries.sparkSession
    dated = StructType([*entries.schema.fields, StructField("batch", LongType())])

    def find(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/entries/batch={batch_id}")
        stored = spark.read.schema(dated).parquet(f"{out_path}/entries")
        known = stored.filter(F.col("batch") < batch_id).drop("batch")
        late = stored.filter(F.col("batch") == batch_id).drop("batch")
        late_hits(index, known, late, key).drop("before").write.mode("overwrite").parquet(
            f"{out_path}/hits/batch={batch_id}")

    return (
        entries.writeStream.foreachBatch(find).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def standing_hits(spark: SparkSession, out_path: str, key: str = "id") -> DataFrame:
    """``key, url, threat, ord, message`` of all batches, the last one of each scan and link."""
    hits = spark.read.parquet(f"{out_path}/hits")
    facts = [c for c in hits.columns if c not in (key, "url", "batch")]
    last = F.max_by(F.struct(*facts), "batch").alias("last")
    return hits.groupBy(key, "url").agg(last).select(key, "url", "last.*")
