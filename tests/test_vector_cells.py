"""Cells of vectors: the rows of the exhaustive search from fewer vectors."""

import numpy as np
import pytest

from docweave.operators import cells, vectors

CHUNKS = "chunk_id long, document_id long, vector array<float>"
QUESTIONS = "query_id long, vector array<float>"


def clustered(seed, centres, each, dim, spread):
    rng = np.random.default_rng(seed)
    made = np.repeat(rng.standard_normal((centres, dim)), each, axis=0) + spread * rng.standard_normal((centres * each, dim))
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def rows(frame):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["document_id"], r["score"]) for r in frame.collect())


@pytest.mark.parametrize("k, min_score, part", [(1, None, 20_000), (7, 0.25, 20_000), (40, None, 25)])
def test_same_rows_as_the_exhaustive_search(spark, monkeypatch, k, min_score, part):
    monkeypatch.setattr(cells, "PART", part)
    made = clustered(1, 12, 50, 16, 0.15)
    listed = [(n, n // 9, v.tolist()) for n, v in enumerate(made)]
    listed += [(1000 + n, 900, made[3].tolist()) for n in range(60)]  # a crowd of equal vectors, all ties
    listed += [(2000, 1, None), (2001, 1, []), (2002, 1, [0.0] * 16), (2003, 1, [float("nan")] * 16), (2004, 1, [0.5, 0.5, 0.5]), (2005, 1, (-made[5]).tolist()), (2006, 1, [3 * x for x in made[7].tolist()])]
    asked = [(n, v.tolist()) for n, v in enumerate(clustered(2, 6, 3, 16, 0.4))] + [(100, made[3].tolist()), (101, [0.1, 0.2, 0.3]), (102, [0.0] * 16), (103, None), (104, [1.0, 2.0])]
    chunks, questions = spark.createDataFrame(listed, CHUNKS), spark.createDataFrame(asked, QUESTIONS)
    found = rows(cells.pruned_topk(questions, cells.build_cells(chunks), k, min_score))
    assert found == rows(vectors.cosine_topk(questions, chunks, k, min_score)) and found


def test_far_cells_are_not_read(spark):
    made = clustered(3, 30, 60, 24, 0.05)
    chunks = spark.createDataFrame([(n, n, v.tolist()) for n, v in enumerate(made)], CHUNKS)
    questions = spark.createDataFrame([(n, made[n * 97].tolist()) for n in range(15)], QUESTIONS)
    index = cells.build_cells(chunks)
    read = cells.vectors_read(questions, index, 5).toPandas()
    assert len(read) == 15 and read["read"].mean() < 0.2 * len(made)
    assert rows(cells.pruned_topk(questions, index, 5)) == rows(vectors.cosine_topk(questions, chunks, 5))


def test_no_vectors_and_no_questions(spark):
    none, one = spark.createDataFrame([], CHUNKS), spark.createDataFrame([(1, [1.0, 0.0])], QUESTIONS)
    assert cells.pruned_topk(one, cells.build_cells(none), 3).count() == 0
    assert cells.pruned_topk(spark.createDataFrame([], QUESTIONS), cells.build_cells(spark.createDataFrame([(1, 1, [1.0, 0.0])], CHUNKS)), 3).count() == 0
