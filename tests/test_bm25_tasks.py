"""BM25 summed up in tasks against the grouped hits, with ties, repeated and missing keys and chunks across batches."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import access, index


def rows(frame):
    return sorted(((r["query_id"], r["rank"], r["chunk_id"] is None, r["chunk_id"] or 0, r["document_id"], round(r["score"], 8)) for r in frame.collect()), key=str)


@pytest.mark.parametrize("k, batch, scoped", [(3, 7, False), (50, 10_000, False), (4, 7, True)])
def test_same_rows_as_the_grouped_hits(spark, monkeypatch, k, batch, scoped):
    rng = random.Random(k)
    words = [f"w{n}" for n in range(12)]
    texts = [(None if n == 5 else n, n // 4, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for n in range(150)]
    texts += [(1000 + n, 90, "w1 w2") for n in range(20)] + texts[20:30] + [(3000, 91, "other words"), (3001, 91, "")]
    chunks = spark.createDataFrame(texts, "chunk_id long, document_id long, content string").repartition(3)
    asked = [(q, t) for q in range(9) for t in rng.sample(words, 4)] + [(1, "w1"), (3, "nowhere"), (20, "nowhere"), (21, "w1"), (21, "w2")]
    terms = spark.createDataFrame(asked, "query_id long, term string")
    scope = None
    if scoped:
        queries = spark.createDataFrame([(q, q % 3 == 0, q % 2 == 0) for q in [*range(9), 21]], "query_id long, see_all boolean, has_request boolean")
        pairs = lambda f: spark.createDataFrame([(q, d) for q in range(9) for d in range(92) if f(q, d)], "query_id long, document_id long")
        scope = access.Scope(queries, spark.createDataFrame([(d, d % 3 == 0) for d in range(92)], "document_id long, shared boolean"),
                             pairs(lambda q, d: (q + d) % 5 == 0), pairs(lambda q, d: (q * d) % 3 == 1))
    built = index.build_index(chunks)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        monkeypatch.setattr(index, "MAX_GRID", 150)  # several blocks of questions
        made = rows(index.bm25_search(terms, built, k, scope))
        monkeypatch.setattr(index, "MAX_GRID", 0)
        grouped = rows(index.bm25_search(terms, built, k, scope))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert made == grouped and made


def test_hits_are_no_rows(spark):
    """Every chunk meets every question: no join of postings and questions, and no group of a chunk and a question, is planned."""
    chunks = spark.range(200).select(F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.lit("alpha beta").alias("content"))
    terms = spark.range(30).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("alpha"), F.lit("beta"))).alias("term"))
    found = index.bm25_search(terms, index.build_index(chunks), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sum(share" not in plan
    assert found.count() == 60
