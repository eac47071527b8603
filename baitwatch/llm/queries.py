"""Queries of the operators in this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from baitwatch.llm import spelling, topk_search, url_filter, warc_archive
from baitwatch.llm.decontamination import op9_decontamination
from baitwatch.llm.language_id import op8_language_id
from baitwatch.llm.packing import op6_packing
from baitwatch.llm.quality_rules import op3_quality_rules
from baitwatch.llm.sharding import op2_sharding
from baitwatch.llm.simhash import op5_simhash
from baitwatch.llm.spelling import op13_spelling
from baitwatch.llm.token_counts import op1_token_counts
from baitwatch.llm.topk_search import op12_topk
from baitwatch.llm.toxicity import op4_toxicity
from baitwatch.llm.url_filter import op10_url_filter
from baitwatch.llm.warc_archive import op7_warc_archive
from baitwatch.llm.whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_sharding, op3_quality_rules, op4_toxicity, op5_simhash,
             op6_packing, op7_warc_archive, op8_language_id, op9_decontamination, op10_url_filter,
             op11_whitening, op12_topk, op13_spelling)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc_archive": warc_archive.ORACLE_SQL, "op10_url_filter": url_filter.ORACLE_SQL,
            "op12_topk": topk_search.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL}
