"""Queries over visibility, scopes, listings, keyword search, inspection and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.operators import access, corpus, substrings
from docweave.plans.catalog import query
from docweave.plans.ctes import define, with_ctes
from docweave.plans.frames import Frames
from docweave.plans.retrieval import scope_of
from docweave.runtime import materialize, shared_dir

K = 20


@query("granted_documents", sql=with_ctes("users", "members", "grants") + """
    SELECT DISTINCT u.user_id, g.document_id FROM users u JOIN grants g ON g.subject_type = 'user' AND g.subject_id = u.user_id
    UNION SELECT m.user_id, g.document_id FROM members m JOIN grants g ON g.subject_type = 'group' AND g.subject_id = m.group_id""")
def granted_documents(spark, sf):
    f = Frames(spark, sf)
    return access.granted_documents(f.users(), f.grants(), f.members())


@query("visible_documents", sql=with_ctes("visible", "users") + """
    SELECT u.user_id, u.role <> 'user' AS unrestricted, count(v.document_id) AS visible_documents
    FROM users u LEFT JOIN visible v USING (user_id) GROUP BY ALL""")
def visible_documents(spark, sf):
    f = Frames(spark, sf)
    return access.visible_counts(f.users(), f.documents(), f.grants(), f.members())


def cited_pairs(f: Frames):
    """Documents cited in each user's turns."""
    return f.citations().join(f.turns().select("turn_id", "user_id"), "turn_id").select("turn_id", "user_id", "document_id").distinct()


define("cited_pairs", "SELECT DISTINCT turn_id, user_id, document_id FROM citations JOIN turns USING (turn_id)", "citations", "turns")


@query("check_access", sql=with_ctes("cited_pairs", "visible") + """
    SELECT c.turn_id, c.user_id, c.document_id, v.user_id IS NOT NULL AS visible
    FROM cited_pairs c LEFT JOIN visible v USING (user_id, document_id)""")
def check_access(spark, sf):
    f = Frames(spark, sf)
    return access.check_access(cited_pairs(f), f.users(), f.documents(), f.grants(), f.members())


@query("effective_scope", sql=with_ctes("scope", "questions") + """
    SELECT query_id, document_id FROM scope JOIN questions USING (query_id) WHERE NOT unrestricted""")
def effective_scope(spark, sf):
    return access.requested_scope(scope_of(Frames(spark, sf)))


@query("effective_scope_hits", sql=with_ctes("scope", "ready_chunks") + """
    SELECT s.query_id, c.chunk_id, c.document_id FROM scope s JOIN ready_chunks c ON c.document_id = s.document_id AND c.document_id = s.query_id""")
def effective_scope_hits(spark, sf):
    """Chunks of the document numbered like the question, kept only inside its scope."""
    f = Frames(spark, sf)
    hits = f.ready_chunks().select(F.col("document_id").alias("query_id"), "chunk_id", "document_id")
    return scope_of(f).keep(hits)


@query("conversation_scope", sql=with_ctes("turns") + """,
    r AS (SELECT turn_id, conversation_id, turn, CASE WHEN conversation_id % 3 = 0 THEN 'a' || (turn // 4) WHEN turn = 0 THEN 'b' ELSE '' END AS asked FROM turns)
    SELECT turn_id, first_value(asked) OVER (PARTITION BY conversation_id ORDER BY turn) AS scope_key,
           asked <> '' AND asked <> first_value(asked) OVER (PARTITION BY conversation_id ORDER BY turn) AS conflict FROM r""")
def conversation_scope(spark, sf):
    """Some conversations ask for other documents later on, some leave the scope out."""
    conv, turn = F.col("conversation_id"), F.col("turn")
    empty = F.array().cast("array<bigint>")
    requested = F.when(conv % 3 == 0, F.array(F.floor(turn / 4) + 100)).when(turn == 0, F.array(F.lit(7).cast("bigint"))).otherwise(empty)
    rows = access.conversation_scope(Frames(spark, sf).turns().withColumn("requested", requested))
    first = F.get("scope", F.lit(0))
    key = F.when(F.size("scope") == 0, "").when(first >= 100, F.concat(F.lit("a"), (first - 100).cast("string"))).otherwise("b")
    return rows.select("turn_id", key.alias("scope_key"), "conflict")


@query("active_scope", sql=with_ctes("requested", "questions", "visible", "docs") + """
    SELECT r.query_id, r.document_id, CASE WHEN v.document_id IS NULL OR d.document_id IS NULL THEN 'not_found'
           WHEN d.status <> 'ready' OR d.lifecycle <> 'active' THEN 'not_ready' ELSE 'ok' END AS status
    FROM requested r JOIN questions q USING (query_id) LEFT JOIN visible v ON v.user_id = q.user_id AND v.document_id = r.document_id
    LEFT JOIN docs d ON d.document_id = r.document_id""")
def active_scope(spark, sf):
    f = Frames(spark, sf)
    docs = f.documents()
    requests = f.requested().join(f.questions().select("query_id", "user_id"), "query_id")
    return access.active_scope(f.requested(), docs, access.check_access(requests, f.users(), docs, f.grants(), f.members()))


def redacted(f: Frames):
    checked = access.check_access(f.citations().join(f.turns().select("turn_id", "user_id"), "turn_id"), f.users(), f.documents(), f.grants(), f.members())
    return access.redact_history(f.turns(), checked)


define("hidden_turns", """
    SELECT DISTINCT c.turn_id FROM cited_pairs c LEFT JOIN visible v USING (user_id, document_id) WHERE v.document_id IS NULL""", "cited_pairs", "visible")


@query("redact_history", sql=with_ctes("hidden_turns") + """
    SELECT turn_id, turn_id IN (SELECT turn_id FROM hidden_turns) AS redacted,
           CASE WHEN turn_id NOT IN (SELECT turn_id FROM hidden_turns) THEN answer END AS answer FROM turns""")
def redact_history(spark, sf):
    return redacted(Frames(spark, sf))[0].select("turn_id", "redacted", "answer")


@query("redact_citations", sql=with_ctes("citations", "turns", "visible") + """
    SELECT c.citation_id, c.document_id FROM citations c JOIN turns t USING (turn_id) JOIN visible v ON v.user_id = t.user_id AND v.document_id = c.document_id""")
def redact_citations(spark, sf):
    return redacted(Frames(spark, sf))[1].select("citation_id", "document_id")


@query("document_listing", sql=with_ctes("docs", "users", "grants") + """
    SELECT d.document_id, d.filename, d.visibility, u.username AS uploaded_by_name,
           count(*) FILTER (WHERE g.subject_type = 'user') AS granted_user_count,
           count(*) FILTER (WHERE g.subject_type = 'group') AS granted_group_count
    FROM docs d LEFT JOIN users u ON u.user_id = d.uploaded_by LEFT JOIN grants g USING (document_id) GROUP BY ALL""")
def document_listing(spark, sf):
    f = Frames(spark, sf)
    return access.document_listing(f.documents(), f.users(), f.grants()).select(
        "document_id", "filename", "visibility", "uploaded_by_name", "granted_user_count", "granted_group_count")


@query("document_listing_filtered", sql=with_ctes("docs") + """
    SELECT document_id, version, device, created_on FROM docs
    WHERE version = '1.1' AND device IN ('LP', '通用') AND created_on BETWEEN '2024-01-10' AND '2024-02-10'""")
def document_listing_filtered(spark, sf):
    f = Frames(spark, sf)
    return access.document_listing(f.documents(), f.users(), f.grants(), None, "1.1", "LP", "2024-01-10", "2024-02-10", "file").select(
        "document_id", "version", "device", "created_on")


@query("user_listing", sql=with_ctes("cited_pairs", "visible", "docs") + """
    SELECT DISTINCT c.user_id, c.document_id, d.filename FROM cited_pairs c JOIN visible v USING (user_id, document_id)
    JOIN docs d USING (document_id) WHERE d.status = 'ready' AND d.lifecycle = 'active'""")
def user_listing(spark, sf):
    f = Frames(spark, sf)
    pairs = cited_pairs(f).select("user_id", "document_id").distinct()
    checked = access.check_access(pairs, f.users(), f.documents(), f.grants(), f.members())
    return access.user_listing(checked, f.documents()).select("user_id", "document_id", "filename")


@query("group_overview", sql=with_ctes("members", "grants") + """
    SELECT m.group_id, count(DISTINCT m.user_id) AS member_count, min(m.user_id) AS first_member, max(m.user_id) AS last_member,
           (SELECT count(DISTINCT g.document_id) FROM grants g WHERE g.subject_type = 'group' AND g.subject_id = m.group_id) AS document_count
    FROM members m GROUP BY m.group_id""")
def group_overview(spark, sf):
    f = Frames(spark, sf)
    return access.group_overview(f.members(), f.grants())


@query("group_members", sql=with_ctes("members") + """
    SELECT group_id, user_id, row_number() OVER (PARTITION BY group_id ORDER BY user_id) AS position FROM (SELECT DISTINCT group_id, user_id FROM members)""")
def group_members(spark, sf):
    return access.group_members(Frames(spark, sf).members())


@query("group_listing", sql=with_ctes("members", "grants") + """
    SELECT g.group_id, g.name, (SELECT count(DISTINCT m.user_id) FROM members m WHERE m.group_id = g.group_id) AS member_count,
           (SELECT count(DISTINCT a.document_id) FROM grants a WHERE a.subject_type = 'group' AND a.subject_id = g.group_id) AS document_count
    FROM (SELECT DISTINCT nationkey AS group_id, name FROM (SELECT n_nationkey AS nationkey, n_name AS name FROM nation)) g""")
def group_listing(spark, sf):
    """Groups named by the nations; those without a member or a grant are listed, too."""
    f = Frames(spark, sf)
    groups = f.table("nation").select(F.col("n_nationkey").cast("long").alias("group_id"), F.col("n_name").alias("name"))
    return access.group_listing(groups, f.members(), f.grants())


@query("grantable_users", sql=with_ctes("users") + "SELECT user_id, username, role, is_active FROM users WHERE role <> 'root'")
def grantable_users(spark, sf):
    return access.grantable_users(Frames(spark, sf).users())


@query("user_groups", sql=with_ctes("members") + """
    SELECT user_id, string_agg(DISTINCT CAST(group_id AS VARCHAR), ',') AS groups FROM members GROUP BY user_id""")
def user_groups(spark, sf):
    groups = access.user_groups(Frames(spark, sf).members())
    return groups.select("user_id", F.array_join(F.transform("group_ids", lambda g: g.cast("string")), ",").alias("groups"))


@query("set_lifecycle", sql=with_ctes("docs") + """,
    c AS (SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'active' ELSE 'archived' END AS lifecycle,
                 CASE WHEN document_id % 2 = 0 THEN document_id + CASE WHEN document_id % 8 = 0 THEN 0 ELSE 1 END END AS link FROM docs)
    SELECT c.document_id, CASE WHEN c.lifecycle = 'active' AND link IS NOT NULL THEN 'active_has_replacement'
             WHEN link = c.document_id THEN 'self_replacement'
             WHEN link IS NOT NULL AND (t.document_id IS NULL OR t.status <> 'ready' OR t.lifecycle <> 'active') THEN 'replacement_not_usable' END AS reason
    FROM c LEFT JOIN docs t ON t.document_id = c.link""")
def set_lifecycle(spark, sf):
    docs, d = Frames(spark, sf).documents(), F.col("document_id")
    changes = docs.select(d, F.when(d % 3 == 0, "active").otherwise("archived").alias("lifecycle"),
                          F.when(d % 2 == 0, d + F.when(d % 8 == 0, 0).otherwise(1)).alias("replacement_document_id"))
    return access.set_lifecycle(changes, docs).select("document_id", "reason")


# --- keyword search -----------------------------------------------------------------------------

define("keywords", """
    SELECT item_id AS query_id, array_to_string(list_slice(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 2), ' ') AS text,
           item_id % 4 = 0 AS include_archived FROM benchmark""")
define("keyword_hits", """
    SELECT k.query_id, c.chunk_id, c.document_id, c.filename, c.seq FROM keywords k JOIN chunks c
      ON c.status = 'ready' AND (c.lifecycle = 'active' OR k.include_archived)
      AND list_bool_and(list_transform(string_split(k.text, ' '), lambda w: contains(
          translate(c.content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))))""", "keywords", "chunks")


def keywords(f: Frames):
    """The first two words of every question."""
    words = F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 1, 2)
    return f.table("benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"),
                                       (F.col("item_id") % 4 == 0).alias("include_archived"))


@query("keyword_search", sql=with_ctes("keyword_hits") + f"""
    SELECT query_id, chunk_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY lower(filename), document_id, seq) AS rank
    FROM keyword_hits QUALIFY rank BETWEEN 6 AND {K + 5}""")
def keyword_search(spark, sf):
    f = Frames(spark, sf)
    return corpus.search_page(corpus.keyword_matches(keywords(f), f.chunks()), K, 5).select("query_id", "chunk_id", "document_id", "rank")


@query("keyword_search_filtered", sql=with_ctes("keyword_hits", "docs", "scope") + """
    SELECT h.query_id, h.chunk_id, h.document_id FROM keyword_hits h JOIN docs d USING (document_id) JOIN chunks c USING (chunk_id)
    JOIN scope s ON s.query_id = h.query_id AND s.document_id = h.document_id
    WHERE d.device IN ('LP', '通用') AND (h.query_id % 2 = 0 OR c.page = 1)""")
def keyword_search_filtered(spark, sf):
    """Device, page and scope filters."""
    f = Frames(spark, sf)
    asked = keywords(f).withColumns({"device": F.lit("LP"), "page": F.when(F.col("query_id") % 2 != 0, F.lit(1))})
    chunks = f.chunks().join(f.documents().select("document_id", "device"), "document_id")
    return corpus.keyword_matches(asked, chunks, scope_of(f)).select("query_id", "chunk_id", "document_id")


def gram_index(spark, chunks):
    """Substring index of the chunks, written to the shared folder and read back."""
    path = f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}"
    substrings.write_index(chunks, path)
    return substrings.read_index(spark, path)


@query("keyword_search_indexed", sql=with_ctes("chunks") + """,
    asked AS (SELECT item_id AS query_id, item_id % 4 = 0 AS include_archived, list_filter(regexp_split_to_array(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+'), lambda w: w <> '') AS terms FROM benchmark),
    lowered AS (SELECT *, translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM chunks WHERE status = 'ready')
    SELECT a.query_id, c.chunk_id, c.document_id FROM asked a JOIN lowered c
      ON len(a.terms) > 0 AND (c.lifecycle = 'active' OR a.include_archived) AND list_bool_and(list_transform(a.terms, lambda w: contains(c.low, w)))""")
def keyword_search_indexed(spark, sf):
    """All words of whole questions, through the substring index."""
    f = Frames(spark, sf)
    asked = f.table("benchmark").select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") % 4 == 0).alias("include_archived"))
    chunks = materialize(f.chunks())
    return corpus.indexed_keyword_matches(asked, chunks, gram_index(spark, chunks)).select("query_id", "chunk_id", "document_id")


@query("substring_frequencies", sql=with_ctes("chunks") + """,
    words AS (SELECT DISTINCT unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+')) AS term FROM benchmark),
    terms AS (SELECT term FROM words WHERE length(term) BETWEEN 1 AND 4 UNION SELECT term[1:1] FROM words WHERE term <> '')
    SELECT term, count(*) AS chunks FROM terms JOIN chunks
      ON contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), term) GROUP BY term""")
def substring_frequencies(spark, sf):
    """Chunks that hold each short word of the questions, and each sign that begins a word."""
    f = Frames(spark, sf)
    words = f.table("benchmark").select(F.explode(corpus.search_terms("text")).alias("term"))
    terms = words.where(F.length("term") <= 4).unionByName(words.select(F.substring("term", 1, 1).alias("term")))
    chunks = materialize(f.chunks())
    return substrings.found_terms(terms, gram_index(spark, chunks), chunks).groupBy("term").agg(F.count(F.lit(1)).alias("chunks"))


@query("search_totals", sql=with_ctes("keyword_hits") + "SELECT query_id, count(*) AS total FROM keyword_hits GROUP BY query_id")
def search_totals(spark, sf):
    f = Frames(spark, sf)
    return corpus.search_totals(corpus.keyword_matches(keywords(f), f.chunks()))


def sourced(documents):
    """Documents of all source types: some come from the web, some are logs, some are images."""
    d = F.col("document_id")
    return documents.withColumns({
        "source_metadata": F.when(d % 6 == 0, '{"kind": "web"}').when(d % 7 == 0, '{"kind":"log"}'),
        "content_type": F.when(d % 13 == 0, "image/png").otherwise(F.col("content_type"))})


define("facets", """
    SELECT query_id, document_id, any_value(d.filename) AS filename, any_value(d.device) AS device, count(*) AS hits,
           CASE WHEN document_id % 6 = 0 THEN 'web' WHEN document_id % 7 = 0 THEN 'log' WHEN document_id % 13 = 0 THEN 'image' ELSE 'file' END AS source_type
    FROM keyword_hits JOIN docs d USING (document_id) GROUP BY query_id, document_id""", "keyword_hits", "docs")


@query("search_facets", sql=with_ctes("facets") + "SELECT * FROM facets")
def search_facets(spark, sf):
    f = Frames(spark, sf)
    return corpus.search_facets(corpus.keyword_matches(keywords(f), f.chunks()), sourced(f.documents()))


@query("search_facets_page", sql=with_ctes("facets") + """
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, lower(filename), document_id) AS rank FROM facets QUALIFY rank <= 5""")
def search_facets_page(spark, sf):
    """The five documents with most hits of every question."""
    f = Frames(spark, sf)
    return corpus.search_facets(corpus.keyword_matches(keywords(f), f.chunks()), sourced(f.documents()), 5)


# --- inspection ---------------------------------------------------------------------------------


def damaged(f: Frames):
    """Chunks with blank texts and lost locations; documents whose records differ."""
    c, d = F.col("chunk_id"), F.col("document_id")
    chunks = f.chunks().select("chunk_id", "document_id", F.when(c % 97 == 0, F.lit(" \t\n")).otherwise(F.col("content")).alias("content"),
                               F.when(c % 89 != 0, F.col("page")).alias("page"), F.when(c % 89 != 0, F.col("paragraph")).alias("paragraph"))
    counts = f.chunks().groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    tags = F.when(d % 14 == 0, F.array(F.lit("ocr_failed_pages=1,2"), F.lit("ocr_suspect_pages=3"))).when(
        d % 14 == 1, F.array(F.lit("ocr_suspect_pages=1"))).otherwise(F.array().cast("array<string>"))
    docs = f.documents().join(counts, "document_id").select(
        "document_id", "filename", "status", (F.col("n") + F.when(d % 31 == 0, 1).otherwise(0)).alias("num_chunks"), tags.alias("tags"),
        F.lit(None).cast("string").alias("source_metadata"), F.when(d % 41 == 0, "review").when(d % 43 == 0, "failed").alias("job_state"),
        (d % 2 == 0).alias("direct_image"), (d % 4 + 1).alias("page_count"))
    return docs, chunks


define("damaged", """
    SELECT chunk_id, document_id, CASE WHEN chunk_id % 97 = 0 THEN ' ' || chr(9) || chr(10) ELSE content END AS content,
           CASE WHEN chunk_id % 89 <> 0 THEN page END AS page, CASE WHEN chunk_id % 89 <> 0 THEN paragraph END AS paragraph FROM chunks""", "chunks")


@query("inspection_summary", sql=with_ctes("damaged", "docs") + """,
    n AS (SELECT document_id, count(*) FILTER (WHERE chunk_id % 97 = 0) AS blank, count(*) FILTER (WHERE page IS NULL AND paragraph IS NULL) AS lost
          FROM damaged GROUP BY document_id),
    r AS (SELECT d.document_id, d.filename, array_to_string(list_filter([
        CASE WHEN status <> 'ready' THEN '处理未就绪' END, CASE WHEN document_id % 31 = 0 THEN '记录片段数与实际不一致' END,
        CASE WHEN blank > 0 THEN '存在空白片段' END, CASE WHEN lost > 0 AND document_id % 2 <> 0 THEN '部分片段缺少位置' END,
        CASE WHEN document_id % 14 IN (0, 1) THEN 'OCR 存在可疑页' END, CASE WHEN document_id % 14 = 0 THEN 'OCR 存在失败页' END,
        CASE WHEN document_id % 41 = 0 THEN 'OCR 文字待核对' END,
        CASE WHEN document_id % 43 = 0 AND document_id % 41 <> 0 AND document_id % 14 <> 0 THEN 'OCR 处理失败' END],
        lambda x: x IS NOT NULL), '|') AS reasons FROM docs d JOIN n USING (document_id))
    SELECT * FROM r WHERE reasons <> ''""")
def inspection_summary(spark, sf):
    docs, chunks = damaged(Frames(spark, sf))
    return corpus.inspection_summary(docs, chunks).select("document_id", "filename", F.array_join("reasons", "|").alias("reasons"))


@query("inspect_document", sql=with_ctes("damaged") + """
    SELECT document_id, count(*) AS chunk_count, CAST(sum(length(content)) AS BIGINT) AS text_chars,
           count(*) FILTER (WHERE chunk_id % 97 = 0) AS empty_chunk_count, count(DISTINCT paragraph) AS paragraph_count,
           count(*) FILTER (WHERE page IS NULL AND paragraph IS NULL) AS chunks_without_location,
           count(DISTINCT CASE WHEN chunk_id % 97 <> 0 THEN page END) AS indexed_pages,
           count(DISTINCT CASE WHEN chunk_id % 97 <> 0 AND document_id % 14 = 0 AND page IN (1, 2) THEN page END) AS failed_pages_indexed,
           count(DISTINCT CASE WHEN chunk_id % 97 <> 0 AND page > document_id % 4 + 1 THEN page END) AS pages_out_of_range,
           document_id % 31 = 0 AS count_differs FROM damaged GROUP BY document_id""")
def inspect_document(spark, sf):
    return corpus.inspect_document(*damaged(Frames(spark, sf)))


@query("missing_pages", sql=with_ctes("damaged", "docs") + """
    SELECT document_id, p AS page FROM docs, range(1, 5) r(p) WHERE p <= document_id % 4 + 1
      AND NOT EXISTS (SELECT 1 FROM damaged x WHERE x.document_id = docs.document_id AND x.page = p AND x.chunk_id % 97 <> 0)""")
def missing_pages(spark, sf):
    return corpus.missing_pages(*damaged(Frames(spark, sf)))


# --- metrics ------------------------------------------------------------------------------------



@query("latency_summary", sql=with_ctes("turns") + """,
    t AS (SELECT *, CASE WHEN status <> 'error' THEN latency_ms END AS m, CASE WHEN status <> 'error' AND latency_ms IS NOT NULL THEN completion_tokens END AS k
          FROM turns ORDER BY turn_id DESC LIMIT 500),
    p AS (SELECT list_sort(list(m) FILTER (WHERE m IS NOT NULL)) AS ms, list_sort(list(retrieval_ms)) AS rs, list_sort(list(k) FILTER (WHERE k IS NOT NULL)) AS ks FROM t)
    SELECT count(*) AS turns, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status <> 'error' AND latency_ms IS NULL) AS refusals,
           count(m) AS model_ms_samples, max(m) AS model_ms_max, any_value(ms[CAST(ceil(0.5 * len(ms)) AS BIGINT)]) AS model_ms_p50, any_value(ms[CAST(ceil(0.95 * len(ms)) AS BIGINT)]) AS model_ms_p95,
           count(retrieval_ms) AS retrieval_samples, max(retrieval_ms) AS retrieval_max, any_value(rs[CAST(ceil(0.5 * len(rs)) AS BIGINT)]) AS retrieval_p50, any_value(rs[CAST(ceil(0.95 * len(rs)) AS BIGINT)]) AS retrieval_p95,
           count(k) AS tokens_samples, max(k) AS tokens_max, any_value(ks[CAST(ceil(0.5 * len(ks)) AS BIGINT)]) AS tokens_p50, any_value(ks[CAST(ceil(0.95 * len(ks)) AS BIGINT)]) AS tokens_p95,
           min(created_epoch) AS first_epoch, max(created_epoch) AS last_epoch FROM t, p""")
def latency_summary(spark, sf):
    return corpus.latency_summary(Frames(spark, sf).turns())


@query("overview", sql=with_ctes("users", "docs", "chunks", "turns") + """
    SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM docs) AS documents, (SELECT sum(size_bytes)::BIGINT FROM docs) AS uploads_bytes,
           (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM turns) AS chats,
           (SELECT count(*) FROM turns WHERE created_epoch >= 1704240000) AS chats_today""")
def overview(spark, sf):
    f = Frames(spark, sf)
    return corpus.overview(f.users(), f.documents(), f.chunks(), f.turns(), 1704240000)
