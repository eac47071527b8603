"""The language stage of the pipeline rejects lettered texts that are in no language."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from baitwatch.llm import language_id as L

SF = "/root/testdata/sf0.01"
DRAW = random.Random(3)
STRANGE = [
    "Это обычный русский текст о погоде. " * 5, "这是一个普通的中文文本关于天气。" * 5,
    "".join(DRAW.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400)),
    " ".join("".join(DRAW.choice("bcdfghjklmnpqrstvwxyz") for _ in range(6)) for _ in range(60)),
    "Это. " * 20_000,
]


def test_stage_rejects_what_is_in_no_language_and_keeps_labelled_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(STRANGE)], "doc_id long, text string")
    strange = strange.selectExpr("doc_id", "text", "cast(null as string) AS lang", "'s' AS source",
                                 "cast(0 as bigint) AS n_chars")
    rows = docs.unionByName(strange)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, rows, "").collect()}
    assert not any(k < 0 for k in kept)
    lettered = {r.doc_id for r in docs.collect() if L.has_letter(r.text)}
    assert {r.doc_id for r in docs.collect() if r.lang and r.doc_id in lettered} <= kept
    assert any(len(r.text) < 20 for r in docs.collect() if r.doc_id in kept)
    assert len(kept) > 0.99 * len(lettered)


def test_one_limit_holds_for_all_sizes(spark, docs, odd):
    """A text is judged alike once and many times over."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train_language_model(table, rejecting=True)
    assert model.languages[-1] == L.UNDETERMINED
    limit = L.fit_limit(table, model)
    assert isinstance(limit, float) and limit >= L.MARGIN
    leads = model.strangeness([STRANGE[2] * n for n in (1, 10, 200)], model.pairs())
    assert all(lead > limit for lead in leads)
    kept = L.keep_known_language(docs(*odd), model, limit)
    assert kept.columns == docs(*odd).columns and kept.count() < len(odd)
    assert L.keep_known_language(docs(*odd).limit(0), model, limit).collect() == []
    untaught = L.train_language_model(docs(*odd), rejecting=True)
    assert untaught.languages == [] and L.fit_limit(docs(*odd), untaught) == 0.0
    assert {r.doc_id for r in L.keep_known_language(docs(*odd), untaught, 0.0).collect()} == {
        k for k, t in odd if L.has_letter(t)}


def test_strange_windows_are_as_long_as_the_learned_ones():
    data = np.stack([L.windows(t)[0] for t in ("short", "a longer text " * 30, "x", "two words")])
    strange = L.strange_windows(data)
    assert strange.shape == data.shape
    assert (np.count_nonzero(strange, axis=1) <= np.count_nonzero(data, axis=1)).all()
    assert sorted(strange[1]) == sorted(data[1]) and (strange[1] != data[1]).any()


def test_limit_is_taken_from_every_held_out_row(spark):
    """One strange labelled row among 20,000 counts, wherever its id hashes to."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train_language_model(documents, rejecting=True)
    texts = {k: "the weather was fine and the bus came on time" for k in range(60_000)
             if L.fold_of(k, 3) == 1}
    plain = spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id long, text string, lang string")
    assert len(texts) > 2 * L.SAMPLE_ROWS
    lead = max(model.strangeness([STRANGE[2]], model.pairs()))
    keys = sorted(texts)[::4_000]
    for key in keys:
        text = F.when(F.col("doc_id") == key, STRANGE[2]).otherwise(F.col("text"))
        assert L.fit_limit(plain.withColumn("text", text), model) == pytest.approx(lead + L.MARGIN, rel=1e-4)
