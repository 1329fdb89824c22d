"""Identifier search from the rarest term against the search over all hits."""

import random

import pytest

from docweave import runtime
from docweave.operators import access, index


def rows(frame):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["document_id"], round(r["score"], 8)) for r in frame.collect())


def tables(spark):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(9)]
    texts = [(n, n // 5, " ".join(rng.sample(words, rng.randrange(1, 7)))) for n in range(120)]
    asked = [(q, t) for q in range(14) for t in rng.sample(words, 1 + q % 3)] + [(20, "w1"), (21, "w1"), (20, "w2"), (21, "w2"), (22, "nowhere"), (23, "w3"), (23, "t7")]
    titles = [(d, f"t{d}") for d in range(24)] + [(d, f"w{d % 4}") for d in range(24)]
    return (spark.createDataFrame(texts, "chunk_id long, document_id long, content string"), spark.createDataFrame(asked, "query_id long, term string"),
            spark.createDataFrame(titles, "document_id long, term string"))


@pytest.mark.parametrize("titled, scoped", [(False, False), (True, False), (True, True)])
def test_same_rows_as_all_hits(spark, monkeypatch, titled, scoped):
    chunks, terms, titles = tables(spark)
    scope = None
    if scoped:
        pairs = lambda f: spark.createDataFrame([(q, d) for q in range(24) for d in range(24) if f(q, d)], "query_id long, document_id long")
        scope = access.Scope(spark.createDataFrame([(q, q % 3 == 0, q % 2 == 0) for q in range(24)], "query_id long, see_all boolean, has_request boolean"),
                             spark.createDataFrame([(d, d % 3 == 0) for d in range(24)], "document_id long, shared boolean"),
                             pairs(lambda q, d: (q + d) % 2 == 0), pairs(lambda q, d: (q * d) % 3 == 1))
    built = index.build_index(chunks)
    search = lambda: rows(index.identifier_search(terms, built, 6, scope, titles if titled else None))
    made = search()
    monkeypatch.setattr(index, "_repeated", lambda *_: True)
    assert made == search() and made


def test_hits_of_common_terms_are_not_listed(spark, monkeypatch):
    chunks, terms, titles = tables(spark)

    def refuse(*_):
        raise AssertionError("all hits are listed")

    built = index.build_index(chunks)
    monkeypatch.setattr(index, "term_hits", refuse)
    assert index.identifier_search(terms, built, 6).count() and index.identifier_search(terms, built, 6, None, titles).count()


def test_repeated_chunks_and_terms_count_twice(spark):
    chunks, terms, _ = tables(spark)
    assert index._repeated(index.weighted_terms(terms.unionAll(terms), index.build_index(chunks)), index.build_index(chunks), None)
    assert index._repeated(index.weighted_terms(terms, index.build_index(chunks)), index.build_index(chunks.unionAll(chunks)), None)
    assert not index._repeated(index.weighted_terms(terms, index.build_index(chunks)), index.build_index(chunks), None)


def test_sets_meet_postings_in_slices(spark, monkeypatch):
    """Sets of terms beyond the broadcast limit come in several slices, postings in several parts; the rows are the same."""
    chunks, terms, _ = tables(spark)
    built = index.build_index(chunks)
    made = rows(index.identifier_search(terms, built, 6))
    cut = []
    monkeypatch.setattr(index, "bounded_slices", lambda *a: cut.append(runtime.bounded_slices(*a, limit=1500)) or cut[-1])
    for limit in ("BROADCAST_LIMIT_BYTES", "TASK_ROWS", "TASK_HITS"):
        monkeypatch.setattr(index, limit, 20)
    assert made == rows(index.identifier_search(terms, built, 6)) and len(cut[-1]) > 1


def test_terms_live_without_listing_hits(spark, monkeypatch):
    chunks, terms, _ = tables(spark)
    terms = terms.unionAll(terms)
    built = index.build_index(chunks)
    pairs = lambda frame: sorted(map(tuple, frame.collect()))
    listed = pairs(index.live_terms(index.term_hits(terms, built)))

    def refuse(*_):
        raise AssertionError("all hits are listed")

    monkeypatch.setattr(index, "term_hits", refuse)
    assert pairs(index.live_question_terms(terms, built)) == listed and listed
