"""Queries over the questions and answers log."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import conversations as cv
from docweave.plans.catalog import query
from docweave.plans.ctes import define, with_ctes
from docweave.plans.frames import Frames
from docweave.plans.governance import redacted


def log_rows(f: Frames):
    return f.turns().withColumn("order", F.col("turn"))


def heads(f: Frames):
    return cv.assign_turns(log_rows(f))[1]


define("heads", """
    SELECT conversation_id, arg_min(user_id, turn) AS user_id, arg_min(question, turn)[1:30] AS title,
           min(created_epoch) AS created_epoch, max(created_epoch) AS updated_epoch FROM turns GROUP BY conversation_id""", "turns")


@query("conversation_list", sql=with_ctes("heads", "turns") + """
    SELECT h.conversation_id, h.title, h.updated_epoch, count(t.turn_id) AS turn_count, coalesce(bool_or(t.status = 'error'), false) AS has_error
    FROM heads h LEFT JOIN turns t USING (conversation_id) GROUP BY ALL""")
def conversation_list(spark, sf):
    f = Frames(spark, sf)
    return cv.conversation_list(heads(f), f.turns()).select("conversation_id", "title", "updated_epoch", "turn_count", "has_error")


@query("conversation_page", sql=with_ctes("heads") + """
    SELECT conversation_id, title FROM heads ORDER BY updated_epoch DESC, conversation_id DESC LIMIT 20 OFFSET 10""")
def conversation_page(spark, sf):
    f = Frames(spark, sf)
    return cv.page_of(cv.conversation_list(heads(f), f.turns()), 20, 10).select("conversation_id", "title")


@query("assign_turns", sql=with_ctes("turns") + """
    SELECT turn_id, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS turn_index FROM turns""")
def assign_turns(spark, sf):
    return cv.assign_turns(log_rows(Frames(spark, sf)))[0].select("turn_id", "conversation_id", "turn_index")


@query("assign_event_numbers", sql="SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS event_no FROM events")
def assign_event_numbers(spark, sf):
    """The same numbering over events, whose keys are hot: a user is ranked bucket by bucket."""
    from docweave.runtime import ranked
    events = Frames(spark, sf).table("events").select("user_id", "event_id")
    return ranked(events, ["user_id"], F.floor(F.col("event_id") / 1024), [F.col("event_id")], "event_no")


@query("assign_turns_conversations", sql=with_ctes("heads") + "SELECT * FROM heads")
def assign_turns_conversations(spark, sf):
    return heads(Frames(spark, sf))


@query("history_context")
def history_context(spark, sf):
    f = Frames(spark, sf)
    hidden = redacted(f)[0].where("redacted")
    return cv.history_context(f.turns(), hidden)


def followups(f: Frames):
    """Every second turn of a conversation supplements the one before it; some contexts are damaged."""
    turns = f.turns().withColumn("status", F.lit("ok"))
    first = turns.where("turn <= 1").select("conversation_id", F.col("turn_id").alias("parent_id"), F.col("question").alias("_q0")).groupBy("conversation_id").agg(
        F.min("parent_id").alias("parent_id"), F.min_by("_q0", "parent_id").alias("_q0"))
    rows = turns.join(first, "conversation_id", "left")
    text = F.concat(F.lit("原问题："), "_q0", F.lit("\n补充1："), "question")
    shown = F.when(F.col("turn_id") % 5 == 0, F.concat(text, F.lit("!"))).otherwise(text)
    parent = F.when(F.col("turn_id") % 7 == 0, F.col("parent_id") + 500).otherwise(F.col("parent_id"))
    context = F.to_json(F.struct(F.lit(1).alias("format"), parent.alias("parent_chat_id"), F.array(parent).alias("chat_ids"), shown.alias("effective_question")))
    later = F.col("turn_id") > F.col("parent_id")
    return rows.withColumn("followup_context", F.when(later, F.when(F.col("turn_id") % 3 == 0, F.lit('{"format": 1}')).otherwise(context))).drop("parent_id", "_q0")


@query("followup_chain", sql=with_ctes("turns") + """,
    r AS (SELECT t.*, p.turn_id AS pid, '原问题：' || p.question || chr(10) || '补充1：' || t.question AS text FROM turns t
          JOIN (SELECT conversation_id, min(turn_id) AS turn_id, arg_min(question, turn_id) AS question FROM turns WHERE turn <= 1 GROUP BY conversation_id) p
            USING (conversation_id) WHERE t.turn_id > p.turn_id),
    s AS (SELECT turn_id, text, CASE WHEN turn_id % 3 = 0 OR (pid = 0 AND turn_id % 7 <> 0) THEN 'invalid_context'
             WHEN length(text) + CASE WHEN turn_id % 5 = 0 THEN 1 ELSE 0 END > 2000 THEN 'invalid_context'
             WHEN turn_id % 7 = 0 THEN CASE WHEN pid + 500 >= turn_id THEN 'invalid_order' ELSE 'missing_ancestor' END
             WHEN turn_id % 5 = 0 THEN 'changed_text' ELSE 'valid' END AS status FROM r)
    SELECT turn_id, status, CASE WHEN status = 'valid' THEN text END AS effective_question FROM s""")
def followup_chain(spark, sf):
    turns = followups(Frames(spark, sf))
    return cv.followup_chain(turns, turns.where("false").select("turn_id"))


@query("build_followup", sql=with_ctes("turns") + """
    SELECT turn_id AS request_id, CASE WHEN length('原问题：' || question || chr(10) || '补充1：why?') > 2000 THEN 'too_long' ELSE 'ok' END AS status FROM turns WHERE status = 'ok'
    UNION ALL SELECT turn_id, 'not_found' FROM turns WHERE status <> 'ok'""")
def build_followup(spark, sf):
    turns = Frames(spark, sf).turns().withColumn("followup_context", F.lit(None).cast("string"))
    requests = turns.select(F.col("turn_id").alias("request_id"), F.col("turn_id").alias("parent_id"), F.lit("why?").alias("question"))
    return cv.build_followup(requests, turns).select("request_id", "status")


@query("turn_listing", sql=with_ctes("turns") + """
    SELECT turn_id, question, (SELECT count(*) FROM turns WHERE status = 'ok') AS total FROM turns WHERE status = 'ok' ORDER BY turn_id DESC LIMIT 50 OFFSET 20""")
def turn_listing(spark, sf):
    return cv.newest(Frames(spark, sf).turns(), "turn_id", 50, 20, status="ok").select("turn_id", "question", "total")


@query("user_turn_listing", sql=with_ctes("hidden_turns") + """
    SELECT turn_id, question, CASE WHEN turn_id NOT IN (SELECT turn_id FROM hidden_turns) THEN answer END AS answer,
           (SELECT count(*) FROM turns WHERE user_id = 5) AS total FROM turns WHERE user_id = 5 ORDER BY turn_id DESC LIMIT 200""")
def user_turn_listing(spark, sf):
    """A user's own history with the answers redacted by current visibility."""
    return cv.newest(redacted(Frames(spark, sf))[0], "turn_id", 200, 0, user_id=5).select("turn_id", "question", "answer", "total")


@query("audit_listing", sql="""
    SELECT event_id, user_id, event_type AS action, (SELECT count(*) FROM events WHERE event_type = 'signup') AS total
    FROM events WHERE event_type = 'signup' ORDER BY event_id DESC LIMIT 200""")
def audit_listing(spark, sf):
    rows = Frames(spark, sf).table("events").select("event_id", "user_id", F.col("event_type").alias("action"))
    return cv.newest(rows, "event_id", 200, 0, action="signup")


def _legacy(f: Frames):
    turns = f.turns().select("turn_id", F.when(F.col("turn_id") % 4 != 0, F.col("conversation_id")).alias("conversation_id"), "user_id", "question", "created_epoch")
    return cv.wrap_legacy_turns(turns, f.turns().select("conversation_id"))


@query("wrap_legacy_turns", sql=with_ctes("turns") + """
    SELECT turn_id, CASE WHEN turn_id % 4 <> 0 THEN conversation_id ELSE (SELECT max(conversation_id) FROM turns) + turn_id END AS conversation_id FROM turns""")
def wrap_legacy_turns(spark, sf):
    return _legacy(Frames(spark, sf))[0].select("turn_id", "conversation_id")


@query("wrap_legacy_conversations", sql=with_ctes("turns") + """
    SELECT (SELECT max(conversation_id) FROM turns) + turn_id AS conversation_id, user_id, question[1:30] AS title, created_epoch AS updated_epoch
    FROM turns WHERE turn_id % 4 = 0""")
def wrap_legacy_conversations(spark, sf):
    return _legacy(Frames(spark, sf))[1].select("conversation_id", "user_id", "title", "updated_epoch")


def frozen(f: Frames):
    docs = f.documents().withColumns({"effective_date": F.col("created_on"), "applicability": F.lit("all"), "source_metadata": F.when(
        F.col("document_id") % 9 == 0, F.lit("damaged"))})
    return cv.freeze_sources(f.citations(), docs)


@query("freeze_sources", sql=with_ctes("citations", "docs") + """
    SELECT c.citation_id, CASE WHEN d.document_id % 9 = 0 THEN NULL ELSE d.filename END AS filename,
           CASE WHEN d.document_id % 9 = 0 THEN NULL ELSE d.sha256 END AS sha, CASE WHEN d.document_id % 9 = 0 THEN 0 WHEN d.document_id IS NULL THEN NULL ELSE 1 END AS format
    FROM citations c LEFT JOIN docs d USING (document_id)""")
def freeze_sources(spark, sf):
    rows, raw = frozen(Frames(spark, sf)), F.col("source_snapshot")
    return rows.select("citation_id", F.get_json_object(raw, "$.filename").alias("filename"), F.get_json_object(raw, "$.document_sha256").alias("sha"),
                       F.get_json_object(raw, "$.format").cast("int").alias("format"))


@query("citation_status", sql=with_ctes("citations", "docs") + """
    SELECT c.citation_id, CASE WHEN d.document_id IS NULL THEN 'legacy_excerpt' WHEN d.document_id % 9 = 0 OR c.citation_id % 8 = 0 THEN 'snapshot_unavailable' ELSE 'full' END AS evidence_status
    FROM citations c LEFT JOIN docs d USING (document_id)""")
def citation_status(spark, sf):
    """Snapshots of some citations lost their file name."""
    rows = frozen(Frames(spark, sf))
    broken = F.regexp_replace("source_snapshot", '"filename":"[^"]*"', '"filename":" "')
    rows = rows.withColumn("source_snapshot", F.when(F.col("citation_id") % 8 == 0, broken).otherwise(F.col("source_snapshot")))
    return cv.citation_status(rows).select("citation_id", "evidence_status")
