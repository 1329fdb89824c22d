"""Lookups whose hits are questions times records: counted before they meet, and no record is shuffled."""

import contextlib
import io

from docweave.operators import facts

VALUES = [(1, 10, "a"), (1, 11, "b"), (2, 12, "c"), (3, 13, None)]
ASKED = [(1, "Byte 1 和 Byte 7"), (1, "Byte 1"), (2, "Byte 2, Byte 3"), (None, "Byte 1"), (4, None)]


def test_parameter_lookup_lists_every_definition_and_shuffles_none(spark):
    values = spark.createDataFrame(VALUES, "byte int, chunk_id long, definition string")
    found = facts.parameter_lookup(spark.createDataFrame(ASKED, "query_id long, text string"), values)
    rows = sorted((r["query_id"], r["byte"], r["records"], r["status"], r["definition"] or "") for r in found.collect())
    # Question 1 comes twice and names byte 1 both times: each definition stands for both.
    assert rows == [(1, 1, 4, "several", "a"), (1, 1, 4, "several", "a"), (1, 1, 4, "several", "b"), (1, 1, 4, "several", "b"), (1, 7, 0, "none", ""),
                    (2, 2, 1, "answer", "c"), (2, 3, 0, "none", "")]
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        found.explain()
    assert "Exchange hashpartitioning" not in plan.getvalue()
