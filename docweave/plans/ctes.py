"""The entity frames of ``frames.py`` as SQL common table expressions."""

from __future__ import annotations

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), """
        SELECT doc_id AS document_id,
               source || '_' || doc_id || (['.pdf','.txt','.md','.xlsx'])[doc_id % 4 + 1] AS filename,
               (['application/pdf','text/plain','text/markdown','application/octet-stream'])[doc_id % 4 + 1] AS content_type,
               strlen(text) AS size_bytes, sha256(text) AS sha256,
               CASE WHEN doc_id % 23 = 0 THEN 'failed' ELSE 'ready' END AS status,
               CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS lifecycle,
               CASE WHEN doc_id % 5 = 0 THEN 'restricted' ELSE 'shared' END AS visibility,
               '1.' || (doc_id % 3) AS version,
               (['PLM','Plus_500','Plus_Pro','LP','通用'])[doc_id % 5 + 1] AS device,
               strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') AS created_on,
               doc_id % 150 AS uploaded_by,
               CASE WHEN doc_id % 11 = 0 THEN (doc_id * 3 + 1) % 1000 END AS replacement_document_id,
               lang, text
        FROM documents"""),
    "lines": ((), """
        SELECT doc_id AS document_id, unnest(l) AS content, generate_subscripts(l, 1) - 1 AS seq
        FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
                                         lambda x: x <> '') AS l FROM documents)"""),
    "chunks": (("docs", "lines"), """
        SELECT l.document_id * 1000000 + l.seq AS chunk_id, l.document_id, l.seq, d.filename, d.status, d.lifecycle,
               CASE WHEN d.document_id % 4 = 0 THEN l.seq // 5 + 1 END AS page,
               CASE WHEN d.document_id % 4 <> 0 THEN l.seq + 1 END AS paragraph, l.content
        FROM lines l JOIN docs d USING (document_id)"""),
    "ready_chunks": (("chunks",), "SELECT * FROM chunks WHERE status = 'ready' AND lifecycle = 'active'"),
    "users": ((), """
        SELECT user_id, 'user' || user_id AS username,
               CASE WHEN user_id % 50 = 0 THEN 'root' WHEN user_id % 25 = 0 THEN 'kb_admin' ELSE 'user' END AS role,
               user_id % 17 <> 0 AS is_active
        FROM (SELECT DISTINCT user_id FROM events)"""),
    "members": (("users",), "SELECT user_id % 7 AS group_id, user_id FROM users"),
    "grants": (("docs",), """
        SELECT document_id, 'user' AS subject_type, (document_id * 7) % 150 AS subject_id FROM docs WHERE visibility = 'restricted'
        UNION ALL
        SELECT document_id, 'user', (document_id * 7 + 31) % 150 FROM docs WHERE visibility = 'restricted'
        UNION ALL
        SELECT document_id, 'group', document_id % 7 FROM docs WHERE visibility = 'restricted'"""),
    "visible": (("docs", "users", "members", "grants"), """
        SELECT u.user_id, d.document_id FROM users u JOIN docs d ON u.role = 'user' AND d.visibility = 'shared'
        UNION
        SELECT u.user_id, g.document_id FROM users u JOIN grants g ON g.subject_type = 'user' AND g.subject_id = u.user_id
        WHERE u.role = 'user'
        UNION
        SELECT u.user_id, g.document_id FROM users u JOIN members m USING (user_id)
        JOIN grants g ON g.subject_type = 'group' AND g.subject_id = m.group_id WHERE u.role = 'user'
        UNION
        SELECT u.user_id, d.document_id FROM users u JOIN docs d ON u.role <> 'user'"""),
    "questions": ((), """
        SELECT item_id AS query_id, text, item_id % 150 AS user_id, item_id % 3 <> 0 AS unrestricted FROM benchmark"""),
    "requested": (("questions",), """
        SELECT DISTINCT query_id, (query_id * 37 + i * 11) % 1000 AS document_id
        FROM questions, range(40) r(i) WHERE NOT unrestricted"""),
    "turns": ((), """
        SELECT q.conv_id * 1000000 + q.turn AS turn_id, q.conv_id AS conversation_id, q.turn,
               q.conv_id % 150 AS user_id, q.text AS question, coalesce(a.text, '') AS answer,
               CASE WHEN q.conv_id % 19 = 0 THEN 'error' ELSE 'ok' END AS status,
               CAST(length(a.text) * 7 AS BIGINT) AS latency_ms, CAST(length(q.text) AS BIGINT) AS retrieval_ms,
               CASE WHEN a.text IS NOT NULL THEN length(a.text) // 4 END AS completion_tokens,
               1704067200 + q.conv_id * 3600 + q.turn * 60 AS created_epoch
        FROM conversations q LEFT JOIN conversations a
          ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
        WHERE q.role = 'user'"""),
    "citations": (("turns",), """
        SELECT turn_id * 10 + i AS citation_id, turn_id, i AS position,
               (conversation_id * 7 + turn * 3 + i) % 1000 AS document_id
        FROM turns, range(3) r(i)"""),
    "feedback": (("turns",), """
        SELECT t.conversation_id AS feedback_id, t.turn_id, t.user_id, t.question, t.answer,
               CASE WHEN l.quality = 1 THEN 'helpful' WHEN l.toxic = 1 THEN 'wrong' ELSE 'incomplete' END AS rating,
               'note ' || t.conversation_id AS comment
        FROM turns t JOIN labels l ON l.doc_id = t.conversation_id WHERE t.turn = 0"""),
    "reviews": (("feedback",), """
        SELECT feedback_id * 10 + i AS review_id, feedback_id,
               CASE WHEN i = 0 THEN 'confirmed' ELSE 'resolved' END AS review_status,
               rating AS s_rating, comment AS s_comment, question AS s_question,
               CASE WHEN feedback_id % 4 = 0 THEN 'old ' || answer ELSE answer END AS s_answer,
               CASE WHEN feedback_id % 5 = 0 THEN '' ELSE 'expected text' END AS expected_answer,
               feedback_id % 6 = 0 AS should_refuse
        FROM feedback, range(2) r(i) WHERE i < feedback_id % 3"""),
    "part_rows": ((), """
        SELECT 1 AS document_id, p_brand AS sheet, p_partkey + 2 AS "row",
               [CAST(p_partkey AS VARCHAR), p_name, p_type, CAST(p_size AS VARCHAR)] AS vals FROM part
        UNION ALL
        SELECT DISTINCT 1, p_brand, 1, ['Index', 'Name', 'Description', 'Value'] FROM part"""),
    "log_files": ((), """
        SELECT doc_id AS file_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
               CASE WHEN (i - 1) % 3 = 0 THEN '2024-01-01 00:00:' || lpad(CAST((i - 1) % 60 AS VARCHAR), 2, '0')
                 || CASE WHEN (i - 1) % 2 = 0 THEN ' WARNING timer T' ELSE ' INFO step ' END
                 || CAST((i - 1) % 5 AS VARCHAR) || ' Timeout. ' || line ELSE line END), chr(10)) AS content
        FROM documents"""),
    "scanned_lines": ((), """
        SELECT document_id, line_no // 4 + 1 AS page, line_no, text, (length(text) % 97) / 96.0::DOUBLE AS score
        FROM (SELECT doc_id AS document_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line_no
              FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))"""),
    "vectors": ((), """
        SELECT vec_id AS chunk_id, vec_id % 100 AS document_id, embedding::DOUBLE[] AS vector FROM embeddings"""),
    "terms": (("ready_chunks",), """
        SELECT chunk_id, document_id, unnest(list_distinct(regexp_extract_all(lower(content),
               '[a-z][a-z0-9]*(?:[_.-][a-z0-9]+)*'))) AS term
        FROM ready_chunks"""),
}


def define(name: str, sql: str, *needs: str) -> None:
    _CTES[name] = (needs, sql)


def with_ctes(*names: str) -> str:
    """``WITH`` clause holding the named expressions and everything they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS ({_CTES[name][1]})" for name in ordered) + "\n"
