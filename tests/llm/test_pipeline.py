"""The corpus pipeline and the registered queries on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import queries, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts, current = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, SMALL)
        assert out.columns == docs.columns
        current = spark.createDataFrame(out.toPandas(), docs.schema)
        counts.append(current.count())
    assert counts == sorted(counts, reverse=True)
    assert counts[2] < counts[1] and counts[4] == counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, current, SMALL)
    assert last.count() == counts[-1] and "ids" in last.columns


def test_first_stage_drops_what_the_operator_calls_toxic(spark, monkeypatch):
    """Also documents with a score from the operator's threshold up to 0.5."""
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(["", "vile", "vile vile vile"])], "doc_id long, text string")
    monkeypatch.setattr(toxicity, "fit", lambda *a: toxicity.Model({b"vile": 1.0}, 1.0, 1.0, (-1.5, 1.0, 0, 0, 0)))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit()).collect()}
    assert any(queries.LIMIT <= s < 0.5 for s in scores.values())
    labels = spark.createDataFrame([(0, 0)], "doc_id long, toxic int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: labels)
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SMALL).collect()}
    assert kept == {i for i, s in scores.items() if s < queries.LIMIT}


def test_stages_take_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumnRenamed("source", "rid")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        assert stage(spark, docs.limit(5), SMALL).count() <= 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS FROM '{SMALL}/{table}.parquet'")
    want = db.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SMALL).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_every_operator_has_its_query():
    numbers = {int(name.split("_")[0][2:]) for name in queries.QUERIES}
    assert numbers == set(range(1, 14))
