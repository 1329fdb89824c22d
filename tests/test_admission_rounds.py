"""A key whose limit binds without a pause: the rounds of the dense form do not grow with its chunks."""

from docweave.streaming import admission


def test_dense_admission_settles_in_rounds_that_do_not_grow_with_the_chunks(spark, monkeypatch):
    hour = 3_600_000_000
    events = spark.range(2000, numPartitions=4).selectExpr("id AS event_id", "id % 2 AS key", f"id * 37000000 + (id * id * 7919) % 30000000 + {hour} AS at_us")
    written = []
    real = admission.materialize
    monkeypatch.setattr(admission, "materialize", lambda df: written.append(1) or real(df))
    got = {r["event_id"]: (r["admitted"], r["retry_after_s"]) for r in admission.admission_dense(events, 3, 3600, 40).collect()}
    assert got == {r["event_id"]: (r["admitted"], r["retry_after_s"]) for r in admission.admission_batch(events, 3, 3600).collect()}
    assert len(got) == 2000 and sum(a for a, _ in got.values()) < 1000
    assert len(written) <= 14
