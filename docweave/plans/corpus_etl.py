"""Queries over sources, ingest and change application."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

from docweave.operators import ingest
from docweave.plans.catalog import query
from docweave.plans.ctes import with_ctes
from docweave.plans.frames import Frames
from docweave.sources import metadata, readers

def doc():
    return F.col("document_id")


@query("decode_text", sql="SELECT doc_id AS document_id, sha256(text) AS decoded_sha, CAST(length(text) AS BIGINT) AS chars FROM documents")
def decode_text(spark, sf):
    """Every third document arrives as GB18030, the others as UTF-8 with or without a byte order mark."""
    docs = Frames(spark, sf).documents()
    utf8 = F.encode("text", "UTF-8")
    data = (F.when(doc() % 3 == 0, _gb18030("text"))
            .when(doc() % 3 == 1, F.concat(F.lit(readers.BOM_UTF8), utf8)).otherwise(utf8))
    rows = docs.select("document_id", readers.decode_text(data).alias("decoded"))
    return rows.select("document_id", F.sha2("decoded", 256).alias("decoded_sha"), F.length("decoded").cast("long").alias("chars"))


@F.pandas_udf(T.BinaryType())
def _gb18030(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t.encode("gb18030"))


def _uploads(spark, sf):
    return Frames(spark, sf).documents().select(
        "document_id",
        F.when(doc() % 29 == 0, F.concat("filename", F.lit(".exe"))).otherwise(F.concat(F.lit("C:\\up\\"), "filename")).alias("filename"),
        F.when(doc() % 31 == 0, "image/gif").otherwise(F.concat("content_type", F.lit("; charset=utf-8"))).alias("content_type"),
        F.when(doc() % 41 == 0, 0).otherwise(F.col("size_bytes")).cast("long").alias("size_bytes"),
        F.when(doc() % 37 == 0, "no good!").otherwise(F.col("version")).alias("version"),
        F.when(doc() % 43 == 0, "2024-02-30").otherwise(F.col("created_on")).alias("effective_date"))


@query("validate_documents", sql=with_ctes("docs") + """
    SELECT document_id, CASE WHEN document_id % 29 = 0 THEN filename || '.exe' ELSE filename END AS filename,
           CASE WHEN document_id % 41 = 0 THEN 'empty_file' WHEN size_bytes > 26214400 THEN 'too_large'
                WHEN document_id % 29 = 0 THEN 'unsupported_ext' WHEN document_id % 31 = 0 THEN 'bad_mime'
                WHEN document_id % 37 = 0 THEN 'bad_version' WHEN document_id % 43 = 0 THEN 'bad_date' END AS error_code
    FROM docs""")
def validate_documents(spark, sf):
    return ingest.validate_documents(_uploads(spark, sf)).select("document_id", "filename", "error_code")


@query("unit_budget_errors", sql=with_ctes("lines") + """
    SELECT document_id, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) AS units,
           CASE WHEN sum(length(content)) > 5000 THEN 'text_too_large' ELSE 'too_many_units' END AS error_code
    FROM lines GROUP BY document_id HAVING sum(length(content)) > 5000 OR count(*) > 15""")
def unit_budget_errors(spark, sf):
    units = Frames(spark, sf).chunks().select("document_id", F.col("content").alias("text"))
    return ingest.unit_budget_errors(units, max_chars=5000, max_units=15)


@query("chunk_budget_errors", sql=with_ctes("lines") + """
    SELECT document_id, count(*) AS chunks, 'too_many_chunks' AS error_code
    FROM lines GROUP BY document_id HAVING count(*) > 25""")
def chunk_budget_errors(spark, sf):
    return ingest.chunk_budget_errors(Frames(spark, sf).chunks(), max_chunks=25)


@query("dedup_exact", sql=with_ctes("docs") + """
    SELECT document_id, sha256, min(document_id) OVER (PARTITION BY sha256) AS survivor_id,
           min(document_id) OVER (PARTITION BY sha256) <> document_id AS is_duplicate FROM docs""")
def dedup_exact(spark, sf):
    docs = Frames(spark, sf).documents().select("document_id", "sha256")
    return ingest.dedup_exact(docs).select("document_id", "sha256", "survivor_id", "is_duplicate")


@query("dedup_against_existing", sql=with_ctes("docs") + """,
    known AS (SELECT sha256, min(document_id) AS known_winner FROM docs WHERE status = 'failed' GROUP BY sha256)
    SELECT d.document_id, coalesce(k.known_winner, min(d.document_id) OVER (PARTITION BY d.sha256)) AS survivor_id
    FROM docs d LEFT JOIN known k USING (sha256) WHERE d.status = 'ready'""")
def dedup_against_existing(spark, sf):
    docs = Frames(spark, sf).documents()
    result = ingest.dedup_exact(docs.where("status = 'ready'").select("document_id", "sha256"), docs.where("status = 'failed'"))
    return result.select("document_id", "survivor_id")


@query("replace_document_chunks", sql=with_ctes("chunks") + """
    SELECT chunk_id, document_id, content FROM chunks WHERE document_id % 7 <> 0
    UNION ALL
    SELECT chunk_id, document_id, content || '!' FROM chunks WHERE document_id % 7 = 0 AND document_id % 14 <> 0""")
def replace_document_chunks(spark, sf):
    """Every seventh document is rebuilt; every second rebuild fails."""
    return _replaced(spark, sf)[0]


@query("replace_document_status", sql=with_ctes("lines") + """
    SELECT document_id, CASE WHEN document_id % 14 = 0 THEN 'failed' ELSE 'ready' END AS status,
           CASE WHEN document_id % 14 = 0 THEN repeat('x', 500) END AS error,
           CASE WHEN document_id % 14 = 0 THEN 0 ELSE count(*) END AS num_chunks
    FROM lines WHERE document_id % 7 = 0 GROUP BY document_id""")
def replace_document_status(spark, sf):
    return _replaced(spark, sf)[1]


def _replaced(spark, sf):
    chunks = Frames(spark, sf).chunks().select("chunk_id", "document_id", "content")
    touched = chunks.where(doc() % 7 == 0)
    outcomes = touched.select("document_id").distinct().withColumn(
        "error", F.when(doc() % 14 == 0, F.repeat(F.lit("x"), F.lit(600))))
    return ingest.replace_document_chunks(chunks, touched.withColumn("content", F.concat("content", F.lit("!"))), outcomes)


@query("delete_documents", sql=with_ctes("docs") + """
    SELECT document_id, CASE WHEN replacement_document_id % 13 = 0
             AND replacement_document_id IN (SELECT document_id FROM docs) THEN NULL ELSE replacement_document_id END
           AS replacement_document_id
    FROM docs WHERE document_id % 13 <> 0""")
def delete_documents(spark, sf):
    f = Frames(spark, sf)
    docs = f.documents()
    return ingest.delete_documents(docs.where(doc() % 13 == 0), docs, {})["documents"].select("document_id", "replacement_document_id")


@query("delete_documents_cascade", sql=with_ctes("chunks", "grants") + """
    SELECT 'chunks' AS child, document_id, count(*) AS n FROM chunks WHERE document_id % 13 <> 0 GROUP BY document_id
    UNION ALL
    SELECT 'grants', document_id, count(*) FROM grants WHERE document_id % 13 <> 0 GROUP BY document_id""")
def delete_documents_cascade(spark, sf):
    f = Frames(spark, sf)
    docs = f.documents()
    left = ingest.delete_documents(docs.where(doc() % 13 == 0), docs, {"chunks": f.chunks(), "grants": f.grants()})
    parts = [left[name].groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("child"), "document_id", "n")
             for name in ("chunks", "grants")]
    return parts[0].unionByName(parts[1])


@query("delete_turns", sql=with_ctes("turns") + """
    SELECT conversation_id, max(created_epoch) AS updated_epoch FROM turns WHERE (conversation_id + turn) % 4 <> 0
    GROUP BY conversation_id""")
def delete_turns(spark, sf):
    turns = Frames(spark, sf).turns()
    gone = turns.where((F.col("conversation_id") + F.col("turn")) % 4 == 0)
    conversations = turns.groupBy("conversation_id").agg(F.max("created_epoch").alias("updated_epoch"))
    return ingest.delete_turns(turns, gone, conversations)[1].select("conversation_id", "updated_epoch")


@query("upsert_latest", sql=with_ctes("reviews") + """
    SELECT feedback_id, review_id, review_status FROM reviews
    QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY review_id DESC) = 1""")
def upsert_latest(spark, sf):
    rows = Frames(spark, sf).reviews().select("feedback_id", "review_id", "review_status")
    return ingest.upsert_latest(rows, ["feedback_id"], ["review_id"])


@query("upsert_event_settings", sql="""
    SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_event_settings(spark, sf):
    rows = Frames(spark, sf).table("events").select("user_id", "event_type", "event_id", "value", "ts")
    return ingest.upsert_latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("insert_or_ignore", sql=with_ctes("grants") + """
    SELECT DISTINCT document_id, subject_type, subject_id FROM grants
    UNION
    SELECT document_id, 'user', uploaded_by FROM docs""")
def insert_or_ignore(spark, sf):
    """Uploaders become readers of their documents unless they already are."""
    f = Frames(spark, sf)
    keys = ["document_id", "subject_type", "subject_id"]
    owners = f.documents().select("document_id", F.lit("user").alias("subject_type"), F.col("uploaded_by").alias("subject_id"))
    return ingest.insert_or_ignore(f.grants().distinct(), owners, keys)


@query("replace_whole", sql=with_ctes("grants") + """
    SELECT document_id, subject_type, subject_id FROM grants WHERE document_id % 10 <> 0
    UNION ALL
    SELECT DISTINCT document_id, 'user', subject_id + 1 FROM grants WHERE document_id % 10 = 0""")
def replace_whole(spark, sf):
    grants = Frames(spark, sf).grants()
    fresh = grants.where(doc() % 10 == 0).select("document_id", F.lit("user").alias("subject_type"), (F.col("subject_id") + 1).alias("subject_id"))
    return ingest.replace_whole(grants, fresh, "document_id")


def metadata_json():
    """Web, log, damaged and missing metadata by document id."""
    sha = F.col("sha256")
    web = F.concat(F.lit('{"format": 1, "kind": "web", "url": "https://example.org/'), doc().cast("string"),
                   F.lit('", "title": "T'), doc().cast("string"), F.lit('", "fetched_at": "2024-01-01T00:00:00+00:00", "sha256": "'), sha,
                   F.when(doc() % 12 == 1, '", "status": "lost"').otherwise('", "status": "partial"'),
                   F.lit(', "warnings": ["a"], "image_count": 1, "block_count": 2}'))
    log = F.concat(F.lit('{"format":1,"kind":"log","sha256":"'), sha, F.lit('","encoding":"utf-8","line_count":'),
                   F.when(doc() % 12 == 2, '"3"').otherwise("3"), F.lit(',"newline":"lf"}'))
    return F.when(doc() % 6 == 1, web).when(doc() % 6 == 2, log).when(doc() % 6 == 3, F.lit('{"format": 1'))


@query("source_type", sql=with_ctes("docs") + """
    SELECT document_id, CASE WHEN document_id % 6 = 1 THEN 'web' WHEN document_id % 6 = 2 THEN 'log'
           WHEN document_id % 10 = 0 OR document_id % 15 = 0 THEN 'image' ELSE 'file' END AS source_type FROM docs""")
def source_type(spark, sf):
    name = F.when(doc() % 10 == 0, F.concat("filename", F.lit(".PNG"))).otherwise(F.col("filename"))
    mime = F.when(doc() % 15 == 0, "Image/JPEG").otherwise(F.col("content_type"))
    return Frames(spark, sf).documents().select("document_id", metadata.source_type(metadata_json(), mime, name).alias("source_type"))


@query("parse_source_metadata", sql=with_ctes("docs") + """
    SELECT document_id, CASE WHEN document_id % 6 = 1 AND document_id % 12 <> 1 THEN 'web'
                             WHEN document_id % 6 = 2 AND document_id % 12 <> 2 THEN 'log' END AS kind,
           CASE WHEN document_id % 6 = 1 AND document_id % 12 <> 1 THEN 'https://example.org/' || document_id END AS url,
           CASE WHEN document_id % 6 = 2 AND document_id % 12 <> 2 THEN 3 END AS line_count
    FROM docs""")
def parse_source_metadata(spark, sf):
    rows = Frames(spark, sf).documents().withColumn("raw", metadata_json())
    rows = rows.select("document_id", metadata.parse_source_metadata("raw").alias("m"))
    return rows.select("document_id", "m.kind", "m.url", F.col("m.line_count").alias("line_count"))


@query("normalize_url", sql="""
    SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[A-Za-z0-9.-]+\\.[a-z]+(/[^#]*)?(#.*)?$') THEN
           lower(regexp_extract(url, '^(https?://[^/?#]*)', 1))
           || CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/'
                   ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END
           || regexp_extract(url, '(\\?[^#]*)', 1) END AS normal_url
    FROM pages""")
def normalize_url(spark, sf):
    return Frames(spark, sf).table("pages").select("page_id", metadata.normalize_url("url").alias("normal_url"))


@query("reindex_plan", sql=with_ctes("docs") + """,
    m AS (SELECT document_id, CASE
             WHEN document_id % 6 = 3 OR (document_id % 6 = 1 AND document_id % 12 = 1)
               OR (document_id % 6 = 2 AND document_id % 12 = 2) THEN 'source_metadata_invalid'
             WHEN document_id % 6 IN (1, 2) AND document_id % 17 = 0 THEN
               CASE WHEN document_id % 6 = 1 THEN 'web' ELSE 'log' END || '_source_missing'
             WHEN document_id % 6 IN (1, 2) AND document_id % 19 = 0 THEN
               CASE WHEN document_id % 6 = 1 THEN 'web' ELSE 'log' END || '_source_changed'
             WHEN document_id % 6 IN (1, 2) THEN NULL
             WHEN document_id % 9 = 0 THEN 'web_metadata_invalid'
             WHEN document_id % 10 = 0 THEN 'image_text_reindex_blocked'
             WHEN document_id % 25 = 4 THEN 'ocr_reindex_blocked'
             WHEN document_id % 17 = 0 THEN 'source_missing' END AS reason FROM docs)
    SELECT document_id, reason, CASE WHEN reason IS NULL THEN
             CASE WHEN document_id % 6 = 1 THEN 'web' WHEN document_id % 6 = 2 THEN 'log' ELSE 'plain' END END AS route FROM m""")
def reindex_plan(spark, sf):
    docs = Frames(spark, sf).documents()
    tags = F.when(doc() % 9 == 0, F.array(F.lit("web_page"))).when(doc() % 10 == 0, F.array(F.lit("image_text_direct"))).otherwise(
        F.array(F.lit("plain")))
    planned = docs.select("document_id", F.col("filename").alias("stored_name"), "sha256", metadata_json().alias("source_metadata"),
                          tags.alias("tags"), (doc() % 25 == 4).alias("has_ocr_job"))
    originals = docs.where(doc() % 17 != 0).select(
        "document_id", F.when(doc() % 19 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))
    return ingest.reindex_plan(planned, originals)


@query("audit_log", sql="""
    SELECT user_id, 'user' || user_id AS username, event_type AS action, 'event:' || event_id AS detail,
           strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM events""")
def audit_log(spark, sf):
    events = Frames(spark, sf).table("events").select(
        "user_id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"), F.col("event_type").alias("action"),
        F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("detail"), F.lit(None).cast("string").alias("ip"), F.col("ts").alias("at"))
    return ingest.audit_rows(events).select("user_id", "username", "action", "detail", "created_at")


@query("apply_if_unchanged", sql=with_ctes("docs") + """
    SELECT document_id, CASE WHEN document_id % 23 = 0 THEN 'busy' WHEN document_id % 4 = 0 THEN 'conflict' ELSE 'applied' END AS outcome,
           CASE WHEN document_id % 23 = 0 OR document_id % 4 = 0 THEN device ELSE 'LP' END AS device
    FROM docs""")
def apply_if_unchanged(spark, sf):
    docs = Frames(spark, sf).documents()
    current = docs.select("document_id", "device", F.when(F.col("status") == "failed", "parsing").otherwise("ready").alias("status"))
    changes = docs.select("document_id", F.when(doc() % 4 == 0, "stale").otherwise(F.col("device")).alias("expected_device"), F.lit("LP").alias("new_device"))
    return ingest.apply_if_unchanged(changes, current, "document_id", ["device"])
