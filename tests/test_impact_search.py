"""Impact blocks: the rows of the exhaustive search from fewer postings."""

import random

import pytest

from docweave.functions import text as tx
from docweave.operators import impact, index

CHUNKS = "chunk_id long, document_id long, content string"


def corpus(seed, count, vocabulary):
    """Words of very different frequency in chunks of 1 to 60 words, with repeated chunks for ties."""
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(vocabulary)]
    weights = [1 / (n + 1) for n in range(vocabulary)]
    rows = [(n, n // 7, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for n in range(count)]
    return rows + [(count + n, 10_000 + n, rows[n][2]) for n in range(0, count, 9)]


def searched(spark, rows, questions, k):
    chunks = spark.createDataFrame(rows, CHUNKS)
    terms = index.or_terms(spark.createDataFrame(questions, "query_id long, text string"), tx.technical_terms("text"))
    built = impact.build_impact_index(chunks)
    fast = impact.block_max_search(terms, built, k)
    plain = index.bm25_search(terms, index.build_index(chunks), k)
    return built, terms, [sorted((r["query_id"], r["rank"], r["chunk_id"], r["document_id"], round(r["score"], 8)) for r in f.collect()) for f in (fast, plain)]


@pytest.mark.parametrize("seed, k", [(1, 1), (2, 5), (3, 40)])
def test_same_rows_as_the_exhaustive_search(spark, seed, k):
    rng = random.Random(100 + seed)
    questions = [(q, " ".join(f"w{rng.choice([rng.randrange(8), rng.randrange(400)])}" for _ in range(rng.randint(1, 12)))) for q in range(25)]
    questions += [(90, "nothing known here"), (91, ""), (92, None), (93, "w0"), (94, "w399 w398 w0 w1")]
    _, _, (fast, plain) = searched(spark, corpus(seed, 900, 400), questions, k)
    assert fast == plain and len(fast) > 25 * min(k, 5)


def test_light_blocks_are_not_read(spark):
    rare = [(5000 + n, 700, f"needle thread w{n}") for n in range(12)]
    built, terms, (fast, plain) = searched(spark, corpus(4, 3000, 300) + rare, [(1, "needle thread w0 w1 w2")], 5)
    assert fast == plain
    read = impact.postings_read(terms, built, 5).first()
    assert read["read"] < 0.1 * read["held"]


def test_empty_index(spark):
    terms = spark.createDataFrame([(1, "a")], "query_id long, term string")
    assert impact.block_max_search(terms, impact.build_impact_index(spark.createDataFrame([], CHUNKS)), 3).count() == 0


def test_levels_hold_their_lengths(spark):
    from pyspark.sql import functions as F
    rows = spark.range(1, 3000).select("id", impact.level(F.col("id")).alias("level")).select(
        "id", impact.shortest(F.col("level")).alias("low"), impact.longest(F.col("level")).alias("high"))
    assert rows.where("id < low OR id > high").count() == 0
