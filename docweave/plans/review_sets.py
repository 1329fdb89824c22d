"""Queries over feedback, evaluation cases and evidence packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import reviews as rv
from docweave.plans.catalog import query
from docweave.plans.ctes import define, with_ctes
from docweave.plans.frames import Frames

define("latest", "SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY review_id DESC) = 1", "reviews")
define("fstatus", """
    SELECT f.*, l.review_id, l.expected_answer, l.should_refuse, l.s_question,
           CASE WHEN l.review_id IS NOT NULL AND f.rating <> 'helpful' AND l.s_answer = f.answer THEN l.review_status
                WHEN f.rating = 'helpful' THEN 'not_required' ELSE 'pending' END AS status,
           l.review_id IS NOT NULL AND f.rating <> 'helpful' AND l.s_answer <> f.answer AS review_stale
    FROM feedback f LEFT JOIN latest l USING (feedback_id)""", "feedback", "latest")


def status_rows(f: Frames):
    return rv.feedback_status(f.feedback(), f.reviews())


@query("feedback_status", sql=with_ctes("fstatus") + "SELECT feedback_id, review_id, status, review_stale FROM fstatus")
def feedback_status(spark, sf):
    return status_rows(Frames(spark, sf)).select("feedback_id", "review_id", "status", "review_stale")


@query("fingerprint", sql=with_ctes("turns") + """
    SELECT a.turn_id, count(*) AS same_content FROM turns a JOIN turns b ON a.question = b.question AND a.answer = b.answer GROUP BY a.turn_id""")
def fingerprint(spark, sf):
    """Turns with equal content share one fingerprint."""
    rows = Frames(spark, sf).turns().select("turn_id", rv.fingerprint("question", "answer").alias("digest"))
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("same_content"))
    return rows.join(counts, "digest").select("turn_id", "same_content")


@query("feedback_snapshot", sql=with_ctes("feedback", "turns", "citations", "docs") + """
    SELECT f.feedback_id, (SELECT count(*) FROM turns t WHERE t.conversation_id = f.feedback_id AND t.turn_id < f.turn_id) AS prior,
           (SELECT count(*) FROM citations c JOIN docs d USING (document_id) WHERE c.turn_id = f.turn_id) AS sources,
           EXISTS (SELECT 1 FROM turns t WHERE t.conversation_id = f.feedback_id AND t.turn_id < f.turn_id) AS context_requires_revalidation FROM feedback f""")
def feedback_snapshot(spark, sf):
    f = Frames(spark, sf)
    rows = rv.feedback_snapshot(f.feedback(), f.turns(), f.citations(), f.documents())
    return rows.select("feedback_id", F.coalesce(F.size("prior_turns"), F.lit(0)).cast("long").alias("prior"),
                       F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("sources"), "context_requires_revalidation")


@query("turn_snapshot", sql=with_ctes("turns", "citations", "docs") + """
    SELECT t.turn_id AS feedback_id, (SELECT count(*) FROM (SELECT 1 FROM turns p WHERE p.conversation_id = t.conversation_id AND p.turn_id < t.turn_id LIMIT 6)) AS prior,
           (SELECT count(*) FROM citations c JOIN docs d USING (document_id) WHERE c.turn_id = t.turn_id) AS sources FROM turns t""")
def turn_snapshot(spark, sf):
    """Snapshots as if every turn had feedback."""
    f = Frames(spark, sf)
    every = f.turns().select(F.col("turn_id").alias("feedback_id"), "turn_id")
    rows = rv.feedback_snapshot(every, f.turns(), f.citations(), f.documents())
    return rows.select("feedback_id", F.coalesce(F.size("prior_turns"), F.lit(0)).cast("long").alias("prior"),
                       F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("sources"))


def submissions(f: Frames):
    """One submitted review per turn; statuses, notes, sources and hashes vary with the turn."""
    k = F.col("turn_id")
    n = F.floor(k / 2) + F.floor(k / 1000000)
    fb = every_turn_feedback(f)
    source = F.array(F.struct(F.lit(1).alias("document_id"), F.lit(2).alias("chunk_id")))
    none = F.array().cast("array<struct<document_id:int,chunk_id:int>>")
    return fb.withColumn("n", n).select(
        "feedback_id", "n", F.when(F.col("n") % 7 == 0, F.lit("0" * 64)).otherwise(rv.fingerprint(*rv.FEEDBACK_FIELDS)).alias("feedback_hash"),
        F.lit(0).alias("expected_review_id"), F.element_at(F.array(*[F.lit(s) for s in rv.STATES]), (F.col("n") % 4 + 1).cast("int")).alias("status"),
        F.when(F.col("n") % 3 == 0, "").otherwise("ok").alias("expected_answer"), F.when(F.col("n") % 5 == 0, " ").otherwise("done").alias("note"),
        F.when(F.col("n") % 2 == 0, source).otherwise(none).alias("expected_sources"), F.lit("q").alias("replay_question"),
        (F.col("n") % 4 == 1).alias("replay_confirmed"), F.lit(False).alias("should_refuse"))


def every_turn_feedback(f: Frames):
    return f.turns().select(F.col("turn_id").alias("feedback_id"), "turn_id", "user_id", "question", "answer",
                            F.when(F.col("turn_id") % 4 == 0, "helpful").otherwise("wrong").alias("rating"), F.lit("c").alias("comment"))


@query("validate_reviews", sql=with_ctes("turns") + """,
    s AS (SELECT turn_id, turn_id // 2 + turn_id // 1000000 AS n FROM turns),
    e AS (SELECT turn_id, n, array_to_string(list_filter([
        CASE WHEN n % 4 IN (1, 2) AND n % 3 = 0 THEN 'expected_answer_missing' END, CASE WHEN n % 4 IN (2, 3) AND n % 5 = 0 THEN 'note_missing' END,
        CASE WHEN n % 4 = 1 AND n % 2 <> 0 THEN 'sources_missing' END], lambda x: x IS NOT NULL), '|') AS errors FROM s)
    SELECT turn_id AS feedback_id, errors, CASE WHEN errors <> '' THEN 'invalid' WHEN turn_id % 4 = 0 THEN 'not_required'
           WHEN n % 7 = 0 THEN 'conflict' ELSE 'accepted' END AS outcome FROM e""")
def validate_reviews(spark, sf):
    f = Frames(spark, sf)
    rows = rv.validate_reviews(submissions(f), every_turn_feedback(f), f.reviews().where("false"))
    return rows.select("feedback_id", F.array_join("errors", "|").alias("errors"), "outcome")


def identified(f: Frames):
    return f.documents().withColumn("applicability", F.concat(F.lit("for "), "device"))


@query("document_manifest", sql=with_ctes("docs") + """
    SELECT document_id, filename, sha256, version, count(*) OVER (PARTITION BY sha256, device) > 0 AS has_digest FROM docs
    WHERE status = 'ready' AND lifecycle = 'active'""")
def document_manifest(spark, sf):
    f = Frames(spark, sf)
    rows = rv.document_manifest(identified(f), f.chunks())
    return rows.select("document_id", "filename", "sha256", "version", (F.length("index_sha256") == 64).alias("has_digest"))


@query("manifest_drift", sql=with_ctes("docs", "chunks") + """
    SELECT document_id % 10 AS review_id, count(*) AS changed_documents FROM docs WHERE status = 'ready' AND lifecycle = 'active'
      AND (version = '1.2' OR EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = docs.document_id AND c.chunk_id % 50 = 7)) GROUP BY 1""")
def manifest_drift(spark, sf):
    """Ten reviews froze the corpus; since then versions and chunk texts have changed."""
    f = Frames(spark, sf)
    frozen = rv.document_manifest(identified(f), f.chunks()).withColumn("review_id", F.col("document_id") % 10)
    docs = identified(f).withColumn("version", F.when(F.col("version") == "1.2", "2.0").otherwise(F.col("version")))
    chunks = f.chunks().withColumn("content", F.when(F.col("chunk_id") % 50 == 7, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    return rv.manifest_changes(frozen, rv.document_manifest(docs, chunks))


def originals(f: Frames):
    """Original scopes of all turns: lost, whole corpus, or the three cited documents."""
    k = F.col("turn_id")
    cited = f.citations().groupBy("turn_id").agg(F.array_sort(F.collect_set("document_id")).alias("_cited"))
    empty = F.array().cast("array<bigint>")
    return f.turns().join(cited, "turn_id").select(
        k.alias("review_id"), "user_id", F.when(k % 5 == 4, F.lit(None).cast("array<bigint>")).when(k % 10 == 0, empty).otherwise(F.col("_cited")).alias("document_ids"))


define("eval_errors", """
    SELECT t.turn_id AS review_id, CASE WHEN t.turn_id % 5 = 4 THEN 'scope_lost' WHEN NOT coalesce(u.is_active, false) THEN 'user_inactive'
             WHEN t.turn_id % 10 <> 0 AND EXISTS (SELECT 1 FROM citations c WHERE c.turn_id = t.turn_id AND NOT EXISTS (
                  SELECT 1 FROM visible v WHERE v.user_id = t.user_id AND v.document_id = c.document_id)) THEN 'access_revoked'
             WHEN t.turn_id % 10 = 0 AND (SELECT count(*) FROM docs WHERE status = 'ready' AND lifecycle = 'active' AND visibility = 'shared') > 100 THEN 'too_many_documents' END AS error
    FROM turns t LEFT JOIN users u USING (user_id)""", "turns", "users", "citations", "visible", "docs")


@query("eval_scope", sql=with_ctes("eval_errors") + """
    SELECT DISTINCT e.review_id, c.document_id FROM eval_errors e JOIN citations c ON c.turn_id = e.review_id WHERE e.error IS NULL AND e.review_id % 10 <> 0""")
def eval_scope(spark, sf):
    f = Frames(spark, sf)
    return rv.eval_scope(originals(f), f.users(), f.documents(), f.grants(), f.members())[0]


@query("eval_scope_errors", sql=with_ctes("eval_errors") + "SELECT review_id, error FROM eval_errors WHERE error IS NOT NULL")
def eval_scope_errors(spark, sf):
    f = Frames(spark, sf)
    return rv.eval_scope(originals(f), f.users(), f.documents(), f.grants(), f.members())[1]


def selected_sources(f: Frames):
    """Every cited document offers its first chunk as expected source; some identities went stale."""
    chunks = f.chunks().where("seq = 0").select("chunk_id", "document_id", "content")
    rows = f.citations().join(chunks, "document_id").join(identified(f).select("document_id", *rv.IDENTITY), "document_id")
    k = F.col("citation_id")
    return rows.select(
        F.col("turn_id").alias("review_id"), "document_id", F.when(k % 13 == 0, -F.col("chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(k % 7 == 0, F.lit("never said so")).otherwise(F.substring("content", 1, 12)).alias("excerpt"), F.sha2("content", 256).alias("chunk_content_sha256"),
        "sha256", F.when(k % 5 == 0, "old").otherwise(F.col("version")).alias("version"), "lifecycle", "applicability").dropDuplicates(["review_id", "document_id"])


define("picked", """
    SELECT c.turn_id AS review_id, c.document_id, min(c.citation_id) AS citation_id FROM citations c JOIN lines l ON l.document_id = c.document_id AND l.seq = 0
    GROUP BY 1, 2""", "citations", "lines")


@query("validate_expected_sources", sql=with_ctes("picked", "docs") + """
    SELECT p.review_id, p.document_id, array_to_string(list_filter([
        CASE WHEN gone THEN 'source_missing' END, CASE WHEN NOT gone AND citation_id % 5 = 0 THEN 'source_changed' END,
        CASE WHEN NOT gone AND citation_id % 7 = 0 THEN 'excerpt_not_in_source' END,
        CASE WHEN NOT gone AND lifecycle <> 'active' THEN 'source_archived' END], lambda x: x IS NOT NULL), '|') AS reasons
    FROM (SELECT p.*, d.lifecycle, p.citation_id % 13 = 0 AND p.document_id <> 0 OR d.status <> 'ready' AS gone FROM picked p JOIN docs d USING (document_id)) p""")
def validate_expected_sources(spark, sf):
    f = Frames(spark, sf)
    rows = rv.validate_expected_sources(selected_sources(f), f.chunks(), identified(f))
    return rows.select("review_id", "document_id", F.array_join("reasons", "|").alias("reasons"))


def cases(f: Frames):
    """Reviews of all turns with stored sources and a frozen scope of the cited documents."""
    k = F.col("turn_id")
    reviews = f.turns().select(k.alias("review_id"), F.when(k % 9 == 0, "pending").otherwise("confirmed").alias("review_status"), (k % 8 != 0).alias("replay_confirmed"),
                               F.lit("q").alias("replay_question"), (k % 6 == 0).alias("should_refuse"), F.lit("a").alias("expected_answer"))
    selected = selected_sources(f)
    current = rv.document_manifest(identified(f), f.chunks())
    frozen = selected.select("review_id", "document_id").join(current, "document_id")
    revoked = rv.eval_scope(originals(f), f.users(), f.documents(), f.grants(), f.members())[1].where("error IN ('access_revoked', 'user_inactive')")
    return rv.case_validity(reviews, selected, f.chunks(), identified(f), frozen, current, revoked)


@query("case_validity")
def case_validity(spark, sf):
    return cases(Frames(spark, sf)).select("review_id", F.array_join("reasons", "|").alias("reasons"), "ready")


@query("export_candidates", sql=with_ctes("fstatus") + """
    SELECT 'feedback-' || feedback_id || '-review-' || review_id AS case_id, s_question AS question, expected_answer, should_refuse, status AS review_status, false AS runnable
    FROM fstatus WHERE status IN ('confirmed', 'resolved')""")
def export_candidates(spark, sf):
    return rv.export_candidates(status_rows(Frames(spark, sf)))


@query("export_cases")
def export_cases(spark, sf):
    f = Frames(spark, sf)
    status = status_rows(f)
    validity = cases(f).select((F.col("review_id") / 1000000).cast("long").alias("feedback_id"), "ready").groupBy("feedback_id").agg(F.max("ready").alias("ready"))
    ready = status.join(validity, "feedback_id").select("review_id", "ready")
    return rv.export_cases(status, ready)


@query("export_valid_cases", sql=with_ctes("fstatus") + """
    SELECT 'feedback-' || feedback_id || '-review-' || review_id AS case_id, s_question AS question, expected_answer, should_refuse, status AS review_status, true AS runnable
    FROM fstatus WHERE status IN ('confirmed', 'resolved') AND feedback_id % 3 <> 0""")
def export_valid_cases(spark, sf):
    """Reviews of two thirds of the feedback are valid; only they become runnable cases."""
    status = status_rows(Frames(spark, sf))
    return rv.export_cases(status, status.select("review_id", (F.col("feedback_id") % 3 != 0).alias("ready")))


# --- evidence packets ---------------------------------------------------------------------------


def packets(f: Frames):
    """One request per document over its chunks; every seventh document repeats a chunk."""
    chunks = f.chunks().join(f.documents().select("document_id", "version", "sha256"), "document_id")
    d = F.col("document_id")
    return chunks.select(d.alias("request_id"), F.col("seq").alias("position"), F.when((d % 7 == 0) & (F.col("seq") == 1), d * 1000000).otherwise(
        F.col("chunk_id")).alias("chunk_id"), (d + 1).alias("document_id"), "filename", F.when(d % 11 == 0, " ").otherwise(F.col("version")).alias("version"), "sha256", "content", "page", "paragraph")


define("packet_state", """
    SELECT document_id AS request_id, count(*) AS chunks, CASE WHEN count(*) > 200 THEN 'too_many_sources' WHEN document_id = 0 THEN 'invalid_source_identity'
           WHEN document_id % 11 = 0 THEN 'missing_document_identity' WHEN document_id % 7 = 0 AND count(*) > 1 THEN 'duplicate_chunk_id' END AS error
    FROM lines GROUP BY document_id""", "lines")


@query("bind_evidence", sql=with_ctes("packet_state") + "SELECT request_id, chunks, error, error IS NULL AS bound FROM packet_state")
def bind_evidence(spark, sf):
    return rv.bind_evidence(packets(Frames(spark, sf))).select("request_id", "chunks", "error", F.col("digest").isNotNull().alias("bound"))


@query("rebind_evidence", sql=with_ctes("packet_state") + """
    SELECT request_id, CASE WHEN error IS NOT NULL THEN error WHEN request_id % 4 = 0 THEN 'source_changed' ELSE 'ok' END AS status FROM packet_state""")
def rebind_evidence(spark, sf):
    rows = packets(Frames(spark, sf))
    now = rows.withColumn("content", F.when(F.col("request_id") % 4 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    return rv.rebind_evidence(rv.bind_evidence(rows), now)


def selections(f: Frames):
    """Each packet is asked for an excerpt of its first chunk and for a current value; some choose a foreign chunk."""
    d = F.col("document_id")
    purpose = F.explode(F.array(F.lit("source_excerpt"), F.lit("current_value"))).alias("purpose")
    chosen = F.when(d % 9 == 0, F.array(F.lit(-1).cast("bigint"))).when(d % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(d * 1000000))
    return f.documents().select(d.alias("request_id"), chosen.alias("chunk_ids"), purpose)


@query("render_selection", sql=with_ctes("docs", "lines") + """
    SELECT d.document_id AS request_id, p AS purpose, CASE WHEN d.document_id % 9 = 0 THEN 'invalid' WHEN p = 'current_value' OR d.document_id % 5 = 0 THEN 'insufficient'
           ELSE 'source_excerpt' END AS status, CASE WHEN d.document_id % 9 <> 0 AND p <> 'current_value' AND d.document_id % 5 <> 0 THEN '[1] ' || l.content END AS text
    FROM docs d JOIN lines l ON l.document_id = d.document_id AND l.seq = 0, (SELECT unnest(['source_excerpt', 'current_value']) AS p)""")
def render_selection(spark, sf):
    f = Frames(spark, sf)
    rows = f.chunks().select(F.col("document_id").alias("request_id"), F.col("seq").alias("position"), "chunk_id", "content")
    return rv.render_selection(rows, selections(f)).select("request_id", "purpose", "status", "text")


@query("render_selection_ends", sql=with_ctes("lines") + """,
    n AS (SELECT document_id, count(*) AS n, max(seq) AS last FROM lines GROUP BY document_id)
    SELECT a.document_id AS request_id, 'source_excerpt' AS status, CASE WHEN n = 1 THEN '[1] ' || a.content
           ELSE '[1] ' || a.content || chr(10) || chr(10) || '[' || n || '] ' || z.content END AS text
    FROM n JOIN lines a ON a.document_id = n.document_id AND a.seq = 0 JOIN lines z ON z.document_id = n.document_id AND z.seq = n.last""")
def render_selection_ends(spark, sf):
    """Each packet, a whole document, is asked for its last and its first chunk; they come in the order of the packet."""
    rows = Frames(spark, sf).chunks().select(F.col("document_id").alias("request_id"), F.col("seq").alias("position"), "chunk_id", "content")
    ends = F.array_distinct(F.array(F.max("chunk_id"), F.min("chunk_id"))).alias("chunk_ids")
    asked = rows.groupBy("request_id").agg(ends).withColumn("purpose", F.lit("source_excerpt"))
    return rv.render_selection(rows, asked).select("request_id", "status", "text")


@query("overall_status", sql=with_ctes("docs") + """
    SELECT document_id AS request_id, 2 AS purposes, CASE WHEN document_id % 9 = 0 THEN 'invalid' WHEN document_id % 5 = 0 THEN 'insufficient' ELSE 'partial' END AS status FROM docs""")
def overall_status(spark, sf):
    f = Frames(spark, sf)
    rows = f.chunks().select(F.col("document_id").alias("request_id"), F.col("seq").alias("position"), "chunk_id", "content")
    return rv.overall_status(rv.render_selection(rows, selections(f)))
