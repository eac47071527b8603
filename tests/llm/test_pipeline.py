"""Registered queries with SQL, and the pipeline against its stages in plain form."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from baitwatch.llm import decontamination, packing, queries, simhash, toxicity
from baitwatch.llm import language_id as L

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names}
    assert "pipeline" in names and set(queries.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    sql = connection.sql(entry.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    expected = Counter(sql.select(*[f'"{c}"' for c in columns]).fetchall())
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == expected and expected


def test_pipeline_keeps_what_the_stages_keep_one_by_one(spark):
    docs, labels, items = (
        spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}

    model = L.train_language_model(docs, rejecting=True)
    limit = L.fit_limit(docs, model)
    found = model.strangeness(list(texts.values()), model.pairs())
    left = {k for k, lead in zip(texts, found) if lead <= limit}

    kept = docs.filter(docs.doc_id.isin(list(left)))
    toxic = toxicity.train_toxicity_model(kept, labels)
    own = sorted(left)
    left = {k for k, s in zip(own, toxic.scores([texts[k] for k in own])) if s < toxicity.THRESHOLD}

    prints = {k: simhash.fingerprint(texts[k]) % (1 << 64) for k in left}
    group = {k: {k} for k in left}
    for a in left:
        for b in left:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] is not group[b]:
                merged = group[a] | group[b]
                for k in merged:
                    group[k] = merged
    left = {k for k in left if k == min(group[k])}

    index = decontamination.ItemIndex([tuple(r) for r in items.collect()])
    left = {k for k in left if not index.search(texts[k])}

    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == left and left
    bpe = packing.ByteBpe()
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == Counter(
        (k, len(bpe.encode(texts[k])) // 4 + 1) for k in left)


def test_stages_return_the_columns_of_documents(spark, docs, odd, tmp_path):
    """Odd rows, names that clash and an empty table go through every stage."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for rows in (docs(*odd), docs(*odd).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            if name == "packing":
                assert out.count() >= rows.count()
            else:
                assert out.columns == rows.columns and out.count() <= rows.count()
