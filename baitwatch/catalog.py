"""Registered queries: every operator run over whole derived tables.

Nested results are flattened to text so that two engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch import fixture as X
from baitwatch.functions.text import minute
from baitwatch.operators import (
    brand_registry,
    corpus,
    enrich,
    evaluate,
    history,
    link_index,
    links,
    rollups,
    scans,
    search_index,
    sender,
    splits,
    text_rules,
)
from baitwatch.operators.detect import (
    analyse_mail,
    brand_mismatches,
    long_findings,
    score_mail,
)
from baitwatch.operators.validate import normalize_label, quarantined_mail, validate_mail
from baitwatch.plans import snapshots
from baitwatch.plans.session import work_folder
from baitwatch.registry import CORPORA, MAX_MAIL_CHARS, MIXED_SEED, TEXT_CATEGORIES, TEXT_RULES
from baitwatch.sources import damaged
from baitwatch.sources.datasets import (
    load_split,
    read_corpora,
    read_labelled,
    write_labelled,
    write_results,
)
from baitwatch.sources.exports import flat_export, nested_export
from baitwatch.streaming.scan_stream import (
    first_arrivals,
    standing_hits,
    stream_late_threats,
    stream_link_check,
    stream_scan,
)

Query = Callable[[SparkSession, str], DataFrame]

_FLAT = ("id", "email_text", "flags", "score", "risk_level", "note", "created_at",
         "network_checked")


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    df = df.withColumns({
        "flags": F.array_join("flags", "\n"), "created_at": minute(F.col("created_at")),
    })
    return df.select(*(columns or _FLAT))


def _on_mail(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(X.mail(spark, sf))


def _on_corpus(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(X.raw_corpus(spark, sf))


def _on_scans(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(X.scans(spark, sf))


def _tag(category: str) -> Query:
    rules = [r for r in TEXT_RULES if r.category == category]
    return _on_mail(lambda mail: text_rules.tag_text_rules(mail, rules))


def _labelled(mail: DataFrame) -> DataFrame:
    return evaluate.score_labelled(mail.withColumnRenamed("raw_label", "label"))


def _analysed(mail: DataFrame) -> DataFrame:
    return analyse_mail(mail).select(
        "mail_id", "score", "risk_level", F.array_join("flags", "\n").alias("flags"),
        F.size("findings").alias("n_findings"),
    )


def _csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark, "labelled") + ".csv"
    write_labelled(corpus.pool_labelled(X.raw_corpus(spark, sf)), path)
    return read_labelled(spark, path).select("label", "email_text")


def _load_split(spark: SparkSession, sf: str) -> DataFrame:
    return load_split(_csv_round_trip(spark, sf), "phishing")


def _read_corpora(spark: SparkSession, sf: str) -> DataFrame:
    raw, base = X.raw_corpus(spark, sf), work_folder(spark, "corpora")
    paths = {name: f"{base}/{name}.csv" for name in CORPORA}
    for name, path in paths.items():
        raw.filter(F.col("source") == name).select("label", "subject", "body").write.options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False).csv(path)
    return read_corpora(spark, paths)


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    pool = corpus.pool_labelled(X.raw_corpus(spark, sf))
    return evaluate.source_breakdown(score_mail(pool))


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    pool = corpus.pool_labelled(X.raw_corpus(spark, sf))
    return evaluate.kind_recall(score_mail(pool))


def _share(rows: DataFrame, part: int) -> int:
    """One in ``part`` of the rows, so that samples of any table are samples."""
    return max(1, rows.count() // part)


def _sample(spark: SparkSession, sf: str) -> DataFrame:
    raw = X.raw_corpus(spark, sf)
    return corpus.mixed_sample(raw, n=_share(corpus.pool_labelled(raw), 4))


def _merged_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The same sample from the stored states of two corpora and of the three that follow."""
    raw = X.raw_corpus(spark, sf)
    n = _share(corpus.pool_labelled(raw), 4)
    early = F.col("source").isin(*CORPORA[:2])
    folder = work_folder(spark, "sample")
    for i, files in enumerate((early, ~early)):
        splits.sample_state(raw.filter(files), n, MIXED_SEED).write.parquet(f"{folder}/{i}")
    states = [spark.read.parquet(f"{folder}/{i}") for i in range(2)]
    return splits.merged_state(*states, n=n).drop("_hash")


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    raw = X.raw_corpus(spark, sf)
    return corpus.focused_splits(raw, per_class=_share(corpus.pool_focused(raw), 8))


def _copy_splits(spark: SparkSession, sf: str) -> DataFrame:
    raw = X.raw_corpus(spark, sf)
    return splits.copy_splits(raw, per_class=_share(corpus.pool_focused(raw), 8))


def _write_results(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark, "results")
    write_results(evaluate.threshold_sweep(_labelled(X.mail(spark, sf))), path)
    schema = ("threshold int, precision double, recall double, f1_score double, accuracy double, "
              "fp_rate double, in_use string")
    return spark.read.schema(schema).json(path)


def _read_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled mail as a TSV file; line breaks and tabs stay inside quotes."""
    path = work_folder(spark, "labelled") + ".tsv"
    corpus.pool_labelled(X.raw_corpus(spark, sf)).select("label", "email_text").write.options(
        header=True, sep="\t", quote='"', escape='"', quoteAll=True).csv(path)
    return read_labelled(spark, path).select("label", "email_text")


def _damaged_input(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled mail as lines of a file of which some miss a field or have one too many."""
    path = work_folder(spark, "damaged") + ".csv"
    pool, i = corpus.pool_labelled(X.raw_corpus(spark, sf)), F.col("row_id")
    text = F.when(i % 10 == 5, F.concat("email_text", F.lit("\ufffd"))).otherwise(F.col("email_text"))
    line = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.when(i % 10 == 3, F.col("label")).when(
        i % 10 == 7, F.concat("label", F.lit(","), line, F.lit(",extra"))).otherwise(
        F.concat("label", F.lit(","), line))
    pool.select(line.alias("value")).write.text(path)
    checked = damaged.read_checked(spark, path, ("label", "email_text"))
    return checked.groupBy(F.coalesce("problem", F.lit("")).alias("problem")).agg(
        F.count("*").alias("n"), F.sum(F.when(
            F.col("problem").isNull(), F.length("email_text"))).alias("chars"))


def _kept_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals after two batches of scans, deletions and a merge of link findings."""
    path, table = work_folder(spark, "totals"), X.scans(spark, sf)
    for batch, rows in enumerate((f"NOT ({X.SECOND_BATCH})", X.SECOND_BATCH)):
        rollups.store_delta(rollups.append_delta(table.filter(rows)), path, batch)
    requests = X.delete_requests(spark, sf)
    rollups.store_delta(rollups.delete_delta(table, requests), path, 2)
    left = scans.delete_scans(table, requests)
    hits = _checks(spark, sf, enrich.link_check_queue(left), "id")
    rollups.store_delta(rollups.link_delta(left, hits), path, 3)
    return rollups.risk_totals_of(rollups.standing(spark, path))


def _kept_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold sweep after mail was added, taken back and labelled anew."""
    path = work_folder(spark, "sweep")
    keys = ("mail_id", *rollups.LABELLED_KEYS)
    scored, folder = _labelled(X.mail(spark, sf)).select(*keys), work_folder(spark, "scored")
    scored.write.parquet(folder)
    scored, i = spark.read.schema(scored.schema).parquet(folder), F.col("mail_id")
    for batch, rows in enumerate((i % 4 != 1, i % 4 == 1)):
        rollups.store_delta(rollups.append_delta(
            scored.filter(rows), rollups.LABELLED_KEYS), path, batch)
    gone = scored.filter(i % 5 == 2).select("mail_id")
    rollups.store_delta(rollups.delete_delta(
        scored, gone, rollups.LABELLED_KEYS, "mail_id"), path, 2)
    other = F.when(F.col("actual") == "phishing", "legitimate").otherwise("phishing")
    anew = scored.filter((i % 5 != 2) & (i % 7 == 3)).select("mail_id")
    rollups.store_delta(rollups.change_delta(
        scored, anew, {"actual": other}, rollups.LABELLED_KEYS, "mail_id"), path, 3)
    return evaluate.sweep_of(rollups.standing(spark, path))


def _rewritten(spark: SparkSession, sf: str, ids: DataFrame, change) -> DataFrame:
    path = X.scan_snapshots(spark, sf)
    snapshots.rewrite(spark, path, ids, change)
    return _flat(snapshots.read(spark, path))


def _rewritten_notes(spark: SparkSession, sf: str) -> DataFrame:
    edits = X.note_edits(spark, sf)
    return _rewritten(spark, sf, edits, lambda part: scans.update_notes(part, edits))


def _rewritten_deletes(spark: SparkSession, sf: str) -> DataFrame:
    requests = X.delete_requests(spark, sf)
    return _rewritten(spark, sf, requests, lambda part: scans.delete_scans(part, requests))


def _indexed(spark: SparkSession, sf: str, query: str, literal: bool = False) -> DataFrame:
    return _flat(search_index.indexed_search(spark, X.search_index(spark, sf), query, literal))


def _late(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Threat entries that were known when mail was checked, and those that came later."""
    entries = X.threat_list(spark, sf)
    return entries.filter(f"NOT ({X.LATE_ENTRY})"), entries.filter(X.LATE_ENTRY)


def _late_threats(spark: SparkSession, sf: str) -> DataFrame:
    index = X.link_index(spark, sf)
    known, late = _late(spark, sf)
    hits = link_index.indexed_hits(index, known)
    return link_index.merged_hits(hits, link_index.late_hits(index, known, late))


def _merge_late(spark: SparkSession, sf: str) -> DataFrame:
    known, late = _late(spark, sf)
    table = X.scans(spark, sf)
    hits = enrich.check_links(
        enrich.link_check_queue(table), known, X.domain_reg(spark, sf), X.AS_OF, "id")
    checked = scans.merge_link_findings(table, hits)
    found = link_index.late_hits(X.link_index(spark, sf), known, late)
    return _flat(link_index.merge_late_findings(checked, found), "id", "flags", "score", "risk_level")


def _as_of():
    return F.lit(X.AS_OF).cast("timestamp_ntz")


def _append(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(scans.append_scans(X.scans(spark, sf), X.submissions(spark, sf), _as_of()))


def _checks(spark: SparkSession, sf: str, mail: DataFrame, key: str = "mail_id") -> DataFrame:
    return enrich.check_links(
        mail, X.threat_list(spark, sf), X.domain_reg(spark, sf), X.AS_OF, key
    )


def _check_links(spark: SparkSession, sf: str) -> DataFrame:
    return _checks(spark, sf, X.mail(spark, sf)).select(
        "mail_id", F.array_join("link_findings.message", "\n").alias("messages"), "points"
    )


def _merge(spark: SparkSession, sf: str) -> DataFrame:
    table = X.scans(spark, sf)
    hits = _checks(spark, sf, enrich.link_check_queue(table), "id")
    return _flat(scans.merge_link_findings(table, hits))


def _merge_legacy(spark: SparkSession, sf: str) -> DataFrame:
    """The same merge for rows as an older release stored them."""
    table = scans.restore_findings(X.old_scans(spark, sf)).withColumn(
        "created_at", F.to_timestamp_ntz("created_at", F.lit("yyyy-MM-dd HH:mm")))
    hits = _checks(spark, sf, enrich.link_check_queue(table), "id")
    return _flat(scans.merge_link_findings(table, hits))


def _evolve(spark: SparkSession, sf: str) -> DataFrame:
    older = X.old_scans(spark, sf).drop("findings", "network_checked")
    return scans.evolve_schema(older)


def _legacy(spark: SparkSession, sf: str) -> DataFrame:
    restored = scans.restore_findings(X.old_scans(spark, sf))
    lines = F.transform("findings", lambda f: F.concat_ws(
        "|", f["rule"], f["category"], f["message"], f["match"]))
    return restored.select(
        "id", F.size("findings").alias("n_findings"), F.array_join(lines, "\n").alias("findings")
    )


def _nested(table: DataFrame) -> DataFrame:
    lines = F.transform("findings", lambda f: F.concat_ws(
        "|", f["category"], f["category_label"], f["message"]))
    return nested_export(table).withColumn("findings", F.array_join(lines, "\n"))


def _streamed_scans(spark: SparkSession, sf: str, repeats: int = 1) -> str:
    """Scans of the document table read as a stream; returns where they are.

    With ``repeats`` every mail is handed in so many times, a minute apart.
    """
    schema = X.table(spark, sf, "documents").schema
    # A table is a file or a folder of files. A stream takes a single file only by a pattern.
    documents = spark.readStream.schema(schema).parquet(f"{sf}/[d]ocuments.parquet")
    # A micro-batch has few files; its rows are spread over all cores.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    documents = documents.repartition(partitions, "doc_id")
    mail = X.mail_from(documents, X.table(spark, sf, "labels"), X.table(spark, sf, "pages"))
    base, mail = work_folder(spark, "stream"), mail.select("mail_id", "email_text")
    if repeats > 1:
        again = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
        sent = F.timestamp_seconds(F.unix_timestamp(F.lit(X.AS_OF)) + F.col("again") * 60)
        mail = first_arrivals(mail.withColumn("again", again).withColumn("sent", sent), "sent", "1 hour")
    stream_scan(
        mail, f"{base}/scans", f"{base}/scan-state", received_at=_as_of(),
    ).awaitTermination()
    return base


def _stream_resubmitted(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark.read.parquet(f"{_streamed_scans(spark, sf, 2)}/scans"))


def _stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark.read.parquet(f"{_streamed_scans(spark, sf)}/scans"))


def _stream_late_threats(spark: SparkSession, sf: str) -> DataFrame:
    """Threat entries that arrive in several files, a micro-batch each."""
    base, entries = work_folder(spark, "late"), X.threat_list(spark, sf)
    entries.repartition(4, "ord").write.parquet(f"{base}/arriving")
    arriving = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{base}/arriving")
    stream_late_threats(
        arriving, X.link_index(spark, sf), base, f"{base}/state").awaitTermination()
    return standing_hits(spark, base)


def _stream_link_check(spark: SparkSession, sf: str) -> DataFrame:
    base = _streamed_scans(spark, sf)
    stream_link_check(
        spark, f"{base}/scans", f"{base}/checked", f"{base}/check-state",
        X.threat_list(spark, sf), X.domain_reg(spark, sf), X.AS_OF,
    ).awaitTermination()
    return _flat(spark.read.parquet(f"{base}/checked"))


def queries() -> dict[str, Query]:
    joined = F.array_join
    return {
        **{f"tag_{c}": _tag(c) for c in TEXT_CATEGORIES},
        "dedupe_findings": _on_mail(text_rules.deduplicated_text_findings),
        "tag_attachment": _on_mail(text_rules.tag_attachment),
        "header_block": _on_mail(sender.extract_headers),
        "sender_address": _on_mail(sender.sender_addresses),
        "sender_checks": _on_mail(sender.tag_sender),
        "sender_brand": _on_mail(lambda m: sender.tag_sender(m).filter(
            F.col("rule") == "display_name_brand_mismatch")),
        "url_facts": _on_mail(links.url_facts),
        "url_findings": _on_mail(links.tag_links),
        "url_shorteners": _on_mail(links.shortened_links),
        "url_suspicious_tld": _on_mail(links.suspicious_tld_links),
        "domain_spoofing": _on_mail(links.tag_domain_spoofing),
        "brand_link_mismatch": _on_mail(brand_mismatches),
        "all_findings": _on_mail(long_findings),
        "score_mail": _on_mail(lambda m: score_mail(m).select("mail_id", "score", "risk_level")),
        "analyse_mail": _on_mail(_analysed),
        "scored_categories": _on_mail(lambda m: history.scored_categories(analyse_mail(m)).select(
            "mail_id", joined("categories", ",").alias("categories"))),
        "grouped_findings": _on_mail(lambda m: history.grouped_findings(analyse_mail(m)).withColumn(
            "messages", joined("messages", "\n"))),
        "category_listing": _on_mail(lambda m: history.category_listing(analyse_mail(m))),
        "normalize_label": _on_mail(lambda m: m.select(
            "mail_id", "raw_label", normalize_label(F.col("raw_label")).alias("label"))),
        "confusion_matrix": _on_mail(lambda m: evaluate.confusion_matrix(_labelled(m)).withColumn(
            "risk_levels", joined(F.transform(F.map_entries("risk_levels"), lambda e: F.concat_ws(
                "=", e["key"], e["value"])), ","))),
        "risk_distribution": _on_mail(lambda m: evaluate.risk_distribution(_labelled(m))),
        "threshold_sweep": _on_mail(lambda m: evaluate.threshold_sweep(_labelled(m))),
        "category_ablation": _on_mail(lambda m: evaluate.category_ablation(
            evaluate.mask_labelled(m, "raw_label"))),
        "kept_sweep": _kept_sweep,
        "kept_totals": _kept_totals,
        "compose_mail": _on_corpus(corpus.compose_mail),
        "corpus_union": _on_corpus(corpus.pool_labelled),
        "focused_pool": _on_corpus(corpus.pool_focused),
        "label_counts": _on_corpus(lambda c: corpus.label_counts(corpus.pool_labelled(c))),
        "read_labelled": _csv_round_trip,
        "load_split": _load_split,
        "read_corpora": _read_corpora,
        "read_tsv": _read_tsv,
        "write_results": _write_results,
        "damaged_input": _damaged_input,
        "seeded_sample": _sample,
        "merged_sample": _merged_sample,
        "focused_splits": lambda spark, sf: _splits(spark, sf).select("row_id", "label", "split"),
        "split_disjoint": lambda spark, sf: corpus.split_overlap(_splits(spark, sf)),
        "copy_splits": lambda spark, sf: _copy_splits(spark, sf).select("row_id", "label", "split"),
        "copies_in_both": lambda spark, sf: splits.copies_in_both(_copy_splits(spark, sf)),
        "rule_hit_rates": _on_corpus(lambda c: evaluate.rule_hit_rates(corpus.pool_focused(c))),
        "source_breakdown": _sources,
        "kind_recall": _kinds,
        "validate_mail": _on_mail(lambda m: validate_mail(m).select(
            "mail_id", F.length("email_text").alias("chars"), "error")),
        "quarantined_mail": _on_mail(lambda m: quarantined_mail(m, MAX_MAIL_CHARS).select(
            "mail_id", F.length("email_text").alias("chars"), "error")),
        "history_search": _on_scans(lambda s: _flat(history.search_scans(s, " paypal%LOGIN "))),
        "indexed_search": lambda spark, sf: _indexed(spark, sf, " paypal%LOGIN "),
        "indexed_search_literal": lambda spark, sf: _indexed(spark, sf, "100%_List", literal=True),
        "indexed_page": lambda spark, sf: _flat(search_index.indexed_page(
            spark, X.search_index(spark, sf), "your account", "Dangerous")),
        "history_risk": _on_scans(lambda s: _flat(history.filter_risk(s, "Suspicious"))),
        "scan_detail": _on_scans(lambda s: _flat(history.scan_by_id(s, 42))),
        "history_page": _on_scans(lambda s: _flat(
            history.history_page(s, "your account", "Dangerous"))),
        "link_check_queue": _on_scans(lambda s: enrich.link_check_queue(s).select("id")),
        "history_preview": _on_scans(history.history_preview),
        "risk_totals": _on_scans(history.risk_totals),
        "export_flat": _on_scans(flat_export),
        "export_nested": _on_scans(_nested),
        "append_scans": _append,
        "threat_join": lambda spark, sf: enrich.threat_hits(
            X.mail(spark, sf), X.threat_list(spark, sf)),
        "late_threats": _late_threats,
        "merge_late_threats": _merge_late,
        "registry_spoofing": lambda spark, sf: brand_registry.registry_spoofs(
            X.mail(spark, sf), X.brand_registry(spark, sf)),
        "domain_cap": _on_mail(enrich.capped_domains),
        "domain_age": lambda spark, sf: enrich.new_domain_hits(
            X.mail(spark, sf), X.domain_reg(spark, sf), X.AS_OF),
        "check_links": _check_links,
        "merge_link_findings": _merge,
        "merge_legacy": _merge_legacy,
        "update_notes": lambda spark, sf: _flat(scans.update_notes(
            X.scans(spark, sf), X.note_edits(spark, sf))),
        "rejected_notes": lambda spark, sf: scans.rejected_notes(
            X.scans(spark, sf), X.note_edits(spark, sf)),
        "delete_scans": lambda spark, sf: _flat(scans.delete_scans(
            X.scans(spark, sf), X.delete_requests(spark, sf))),
        "rewritten_notes": _rewritten_notes,
        "rewritten_deletes": _rewritten_deletes,
        "missing_deletes": lambda spark, sf: scans.missing_deletes(
            X.scans(spark, sf), X.delete_requests(spark, sf)),
        "evolve_schema": _evolve,
        "legacy_findings": _legacy,
        "stream_scan": _stream_scan,
        "stream_resubmitted": _stream_resubmitted,
        "stream_link_check": _stream_link_check,
        "stream_late_threats": _stream_late_threats,
    }
