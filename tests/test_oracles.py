"""Every registered query runs; those with a SQL twin equal it."""

import pytest

from oracle import connect, difference, spark_rows, sql_rows
from docweave.plans import catalog


@pytest.fixture(scope="session")
def registered(spark):
    catalog.load_all()
    return catalog


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


def names():
    import re
    from pathlib import Path
    plans = Path(__file__).resolve().parents[1] / "docweave" / "plans"
    return [n for m in catalog.MODULES for n in re.findall(r'@query\("([^"]+)"', (plans / f"{m}.py").read_text())]


@pytest.mark.parametrize("name", names())
def test_query(name, spark, registered, duck, sf_dir):
    result = spark_rows(registered.QUERIES[name](spark, sf_dir))
    if name in registered.SQL:
        assert difference(result, sql_rows(duck, registered.SQL[name])) is None


INVARIANT = ["dedup_exact", "bm25_search", "identifier_search", "title_fallback", "cosine_topk", "rrf_fuse", "keyword_search", "select_sources",
             "literal_candidates", "attach_literals", "assign_event_numbers", "admission_batch", "chunk_units", "table_lookup", "rerank"]


@pytest.mark.parametrize("name", INVARIANT)
def test_partition_count_does_not_matter(name, spark, registered, sf_dir):
    many = spark_rows(registered.QUERIES[name](spark, sf_dir))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert spark_rows(registered.QUERIES[name](spark, sf_dir)) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
