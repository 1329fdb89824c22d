"""Access by grants against plain sets; the plan forms no pairs that nobody asked for."""

from pyspark.sql import functions as F

from docweave.operators import access

USERS = [(u, "root" if u == 9 else "user") for u in range(1, 10)] + [(None, "user")]
MEMBERS = [(7, 1), (7, 2), (7, 2), (8, 2), (8, 3), (7, 40), (None, 4), (8, None), (7, 5), (8, 5)]
GRANTS = [(5, "user", 1), (6, "group", 7), (6, "group", 7), (6, "user", 1), (7, "group", 8), (6, "group", 8), (8, "user", 77), (9, "user", 4), (9, "user", 4),
          (None, "group", 7), (None, "user", 1), (3, "group", None), (11, "user", 9), (12, "user", 3)]
DOCUMENTS = [(d, "shared" if d < 3 else "secret") for d in range(13)]


def frames(spark):
    return (spark.createDataFrame(USERS, "user_id long, role string"), spark.createDataFrame(DOCUMENTS, "document_id long, visibility string"),
            spark.createDataFrame(GRANTS, "document_id long, subject_type string, subject_id long"),
            spark.createDataFrame(MEMBERS, "group_id long, user_id long"))


def brute():
    known = {u for u, _ in USERS if u is not None}
    direct = {(s, d) for d, kind, s in GRANTS if kind == "user" and s in known}
    return direct | {(u, d) for d, kind, s in GRANTS if kind == "group" for g, u in MEMBERS if g == s and g is not None and u in known}


def test_granted_documents_are_distinct_pairs(spark):
    users, _, grants, members = frames(spark)
    rows = [(r["user_id"], r["document_id"]) for r in access.granted_documents(users, grants, members).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute()


def test_counts_and_requests(spark):
    users, documents, grants, members = frames(spark)
    granted, hidden = brute(), {d for d, v in DOCUMENTS if v != "shared"}
    counts = {r["user_id"]: r["visible_documents"] for r in access.visible_counts(users, documents, grants, members).collect()}
    assert counts == {u: len(DOCUMENTS) if role == "root" else 3 + sum(1 for w, d in granted if w == u and d in hidden) for u, role in USERS}
    asked = [(n, u, d) for n, (u, d) in enumerate((u, d) for u in [*range(1, 11), None] for d in [*range(15), None])]
    requests = spark.createDataFrame(asked + asked[:20], "id long, user_id long, document_id long")
    found = access.check_access(requests, users, documents, grants, members)
    seen = {(r["id"], r["visible"]) for r in found.collect()}
    roles, docs = dict(USERS), dict(DOCUMENTS)
    assert found.count() == len(asked) + 20
    assert seen == {(n, u is not None and u in roles and d in docs and (roles[u] == "root" or docs[d] == "shared" or (u, d) in granted)) for n, u, d in asked}


def test_group_members_that_do_not_ask_form_no_pairs(spark):
    """2,000 members times 2,000 documents of one group; the work follows the one request and the one question."""
    users = spark.range(2000).select(F.col("id").alias("user_id"), F.lit("user").alias("role"))
    members = users.select(F.lit(1).cast("long").alias("group_id"), "user_id")
    documents = spark.range(2000).select(F.col("id").alias("document_id"), F.lit("secret").alias("visibility"))
    grants = documents.select("document_id", F.lit("group").alias("subject_type"), F.lit(1).cast("long").alias("subject_id"))
    requests = spark.createDataFrame([(4, 9), (4, 4000)], "user_id long, document_id long")
    checked = access.check_access(requests, users, documents, grants, members)
    assert {(r["document_id"], r["visible"]) for r in checked.collect()} == {(9, True), (4000, False)}
    plan = access.granted_documents(users, grants, members)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # the pairs are not compared with each other
    questions = spark.createDataFrame([(1, 4)], "query_id long, user_id long")
    scope = access.effective_scope(questions, users, documents, grants, members, spark.createDataFrame([], "query_id long, document_id long"))
    assert scope.granted.count() == 2000
