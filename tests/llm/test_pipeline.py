"""The pipeline stage by stage on the given tables, and as one run; the registered queries on them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import helpers as h
from docweave.llm import queries
from docweave.llm.registry import QUERIES


def test_stages_and_run_agree(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = {r.doc_id for r in queries.QUERIES["op1_toxicity"](spark, sf_dir).where("predicted = 1").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf_dir)
        path = str(tmp_path / f"{number}-{name}")
        made.write.parquet(path)
        before, docs = docs, spark.read.schema(made.schema).parquet(path)
        if name == "toxicity":
            assert {r.doc_id for r in docs.collect()} == kept - toxic
        elif name == "line_dedup":
            assert docs.count() == before.count()
            assert docs.agg(F.sum("n_chars")).first()[0] == docs.agg(F.sum(F.length("text"))).first()[0] < before.agg(F.sum("n_chars")).first()[0]
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id for r in docs.collect()} <= kept
            kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in docs.collect()} == kept
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_stages_on_odd_tables(spark, sf_dir):
    for make in (h.odd, h.empty):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, make(spark), sf_dir)
            assert made.count() >= 0
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert made.columns == docs.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_have_rows_and_ids(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    assert rows.limit(1).count() == 1
    assert "doc_id" not in rows.columns or dict(rows.dtypes)["doc_id"] == "bigint"
    if name in ("op1_toxicity", "op2_quality", "op7_jaccard_join", "op8_language_id", "op9_line_dedup", "op10_fingerprints"):
        assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
