"""A training corpus from ``documents``: five stages, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from baitwatch.llm.common import table, written
from baitwatch.llm.decontamination import drop_contaminated
from baitwatch.llm.language_id import fit_limit, keep_known_language, train_language_model
from baitwatch.llm.packing import pack_documents
from baitwatch.llm.simhash import keep_one_of_each
from baitwatch.llm.toxicity import drop_toxic, train_toxicity_model


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that are rather in no language."""
    model = train_language_model(docs, rejecting=True)
    return keep_known_language(docs, model, fit_limit(docs, model))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted to be toxic."""
    return drop_toxic(docs, train_toxicity_model(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of linked fingerprints."""
    return keep_one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences; a row per piece."""
    return pack_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("packing", packed),
]

#: Models, fingerprints and tokenizers are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
