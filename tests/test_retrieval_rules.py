"""Retrieval over a small corpus: live documents, named files, empty and damaged input."""

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import corpus, index, retrieval, vectors

CHUNK = "chunk_id long, document_id long, seq long, filename string, page long, paragraph long, content string, status string, lifecycle string"


# A lambda travels inside the tasks; a named function of a test module would have to be importable there.
encoder = lambda: vectors.HashEncoder(16)


@pytest.fixture(scope="module")
def small(spark):
    documents = spark.createDataFrame(
        [(1, "a.txt", "ready", "active"), (2, "b.txt", "ready", "active"), (3, "a.txt", "ready", "archived"), (4, "c.txt", "failed", "active")],
        "document_id long, filename string, status string, lifecycle string")
    chunks = spark.createDataFrame(
        [(10, 1, 0, "a.txt", None, 1, "alpha motor speed E12 value", "ready", "active"), (11, 1, 1, "a.txt", None, 2, "beta motor", "ready", "active"),
         (20, 2, 0, "b.txt", None, 1, "alpha motor speed E12 other", "ready", "active")], CHUNK)
    return documents, chunks


def ask(spark, small, *texts):
    questions = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    found = retrieval.retrieve(questions, retrieval.build_corpus(*small, encoder), 3, None, -1.0, encoder)
    rows = {}
    for r in found.collect():
        rows.setdefault(r["query_id"], []).append(r)
    return rows


def test_named_files_narrow_a_search_without_scope(spark, small):
    rows = ask(spark, small, "《a.txt》 alpha motor", "《unknown.pdf》 alpha motor", "alpha motor speed")
    assert {r["document_id"] for r in rows[0]} == {1}
    assert [(r["chunk_id"], r["reason"]) for r in rows[1]] == [(None, "no_hits")]
    assert {r["document_id"] for r in rows[2]} <= {1, 2} and sorted(r["source_no"] for r in rows[2]) == list(range(1, len(rows[2]) + 1))


def test_no_question_no_source(spark, small):
    assert ask(spark, small) == {}


def test_titles_stand_for_live_documents_only(spark, small):
    built = retrieval.build_corpus(*small, encoder)
    assert {r["document_id"] for r in built.titles.collect()} == {1, 2} and built.documents.count() == 2


def test_cosine_of_empty_and_damaged_vectors(spark):
    schema = "chunk_id long, document_id long, vector array<float>"
    chunks = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.6, 0.8]), (3, 2, [1.0]), (4, 2, []), (5, 2, None), (6, 2, [float("nan"), 1.0])], schema)
    asked = lambda rows: spark.createDataFrame(rows, "query_id long, vector array<float>")
    assert vectors.cosine_topk(asked([]), chunks, 5).count() == 0
    found = vectors.cosine_topk(asked([(1, [1.0, 0.0]), (2, [1.0]), (3, []), (4, None)]), chunks, 5).collect()
    assert sorted((r["query_id"], r["chunk_id"], round(r["score"], 6)) for r in found) == [(1, 1, 1.0), (1, 2, 0.6), (2, 3, 1.0)]
    assert vectors.cosine_topk(asked([(1, [1.0, 0.0])]), chunks.limit(0), 5).count() == 0


def test_one_long_question_does_not_end_the_others(spark):
    rows = [(1, "motor speed", 10, "a.txt", "motor speed of the pump", 1), (1, "motor speed", 11, "a.txt", "nothing", 2),
            (2, "word " * 600, 10, "a.txt", "motor speed of the pump", 1)]
    found = vectors.rerank(spark.createDataFrame(rows, "query_id long, question string, chunk_id long, filename string, content string, position long"))
    got = {(r["query_id"], r["chunk_id"]): (r["rerank_rank"], r["rerank_error"]) for r in found.collect()}
    assert got == {(1, 10): (1, None), (1, 11): (2, None), (2, 10): (1, "window_too_small")}


def test_terms_are_taken_whole_and_all(spark):
    long = "x" * 80
    words = " ".join([f"w{n}" for n in range(12)] + [long])
    row = spark.createDataFrame([(words,)], "text string").select(corpus.search_terms("text").alias("t")).first()["t"]
    assert len(row) == 13 and row[-1] == long
    questions = spark.createDataFrame([(1, " ".join(f"id_{n}" for n in range(30)))], "query_id long, text string")
    assert index.identifier_terms(questions).count() == 30
    assert index.or_terms(questions, tx.technical_terms("text")).select(F.countDistinct("term")).first()[0] == 30
