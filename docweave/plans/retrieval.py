"""Queries over lexical search, vectors, fusion and reranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import access, cells, impact, index, retrieval, segments, vectors
from docweave.plans.catalog import query
from docweave.plans.ctes import define, with_ctes
from docweave.plans.frames import Frames
from docweave.runtime import materialize, persist, shared_dir

K = 10
QUERY_CHUNK = "query_id, chunk_id"


def scope_of(f: Frames) -> access.Scope:
    """What each question's user may see, cut to the requested documents."""
    docs = f.documents()
    return access.effective_scope(f.questions(), f.users(), docs, f.grants(), f.members(), f.requested())


define("scope", """
    SELECT q.query_id, v.document_id FROM questions q JOIN visible v USING (user_id)
    WHERE q.unrestricted OR EXISTS (SELECT 1 FROM requested r WHERE r.query_id = q.query_id AND r.document_id = v.document_id)""",
       "visible", "questions", "requested")
define("scoped_shares", "SELECT s.* FROM shares s JOIN scope c USING (query_id, document_id)", "shares", "scope")


def _ranked(source: str, k: int = K) -> str:
    return f"""SELECT query_id, chunk_id, document_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
        FROM {source} QUALIFY rank <= {k}"""


def _lexical(f: Frames):
    built = index.build_index(f.ready_chunks())
    built.postings = materialize(built.postings)
    built.frequencies = index.term_frequencies(built.postings)
    built.stats = materialize(built.stats)
    return built


@query("bm25_search", sql=with_ctes("shares") + ", s AS (SELECT query_id, chunk_id, document_id, sum(share) AS score FROM shares GROUP BY ALL) "
       + _ranked("s"))
def bm25_search(spark, sf):
    f = Frames(spark, sf)
    return index.bm25_search(index.or_terms(f.questions(), tx.technical_terms("text")), _lexical(f), K)


@query("block_max_search", sql=with_ctes("shares") + ", s AS (SELECT query_id, chunk_id, document_id, sum(share) AS score FROM shares GROUP BY ALL) "
       + _ranked("s"))
def block_max_search(spark, sf):
    """The rows of ``bm25_search`` from impact blocks."""
    f = Frames(spark, sf)
    return impact.block_max_search(index.or_terms(f.questions(), tx.technical_terms("text")), impact.build_impact_index(f.ready_chunks()), K)


@query("bm25_search_scoped", sql=with_ctes("scoped_shares")
       + ", s AS (SELECT query_id, chunk_id, document_id, sum(share) AS score FROM scoped_shares GROUP BY ALL) " + _ranked("s"))
def bm25_search_scoped(spark, sf):
    f = Frames(spark, sf)
    return index.bm25_search(index.or_terms(f.questions(), tx.technical_terms("text")), _lexical(f), K, scope_of(f))


# Short identifier questions: the three longest words of each chunk opening a document.
define("id_questions", """
    SELECT document_id AS query_id, array_to_string(list_slice(list_reverse_sort(list_distinct(list_transform(
               regexp_extract_all(lower(content), '[a-z][a-z0-9]*(?:[_.-][a-z0-9]+)*'), lambda t: lpad(CAST(length(t) AS VARCHAR), 3, '0') || t))), 1, 3), ' ') AS packed
    FROM chunks WHERE seq = 0""", "chunks")
define("id_terms", """
    SELECT query_id, substr(unnest(string_split(packed, ' ')), 4) AS term FROM id_questions WHERE packed <> ''""", "id_questions")
define("id_shares", """
    SELECT q.query_id, t.chunk_id, t.document_id, t.term,
           (CASE WHEN ln((s.n_chunks - f.df + 0.5) / (f.df + 0.5)) > 0 THEN ln((s.n_chunks - f.df + 0.5) / (f.df + 0.5)) ELSE 1e-6 END)
           * 2.2 / (1 + 1.2 * (0.25 + 0.75 * t.length / s.avg_length)) AS share
    FROM id_terms q JOIN terms t USING (term) JOIN frequencies f USING (term), index_stats s""", "id_terms", "frequencies", "index_stats")
define("id_live", "SELECT query_id, count(DISTINCT term) AS n_live FROM id_shares GROUP BY query_id", "id_shares")
define("id_full", """
    SELECT s.query_id, s.chunk_id, s.document_id, sum(share) AS score FROM id_shares s JOIN id_live USING (query_id)
    GROUP BY s.query_id, s.chunk_id, s.document_id, n_live HAVING count(*) = n_live""", "id_shares", "id_live")


def id_questions(f: Frames):
    """One identifier question per document: the three longest words of its first line."""
    words = F.transform(tx.technical_terms("content"), lambda t: F.concat(F.lpad(F.length(t).cast("string"), 3, "0"), t))
    top = F.slice(F.reverse(F.array_sort(words)), 1, 3)
    return f.chunks().where("seq = 0").select(
        F.col("document_id").alias("query_id"), F.array_join(F.transform(top, lambda w: F.substr(w, F.lit(4))), " ").alias("text"))


@query("identifier_search", sql=with_ctes("id_full") + _ranked("id_full"))
def identifier_search(spark, sf):
    f = Frames(spark, sf)
    return index.identifier_search(index.identifier_terms(id_questions(f)), _lexical(f), K)


@query("live_terms", sql=with_ctes("id_shares") + "SELECT DISTINCT query_id, term FROM id_shares")
def live_terms(spark, sf):
    f = Frames(spark, sf)
    return index.live_question_terms(index.identifier_terms(id_questions(f)), _lexical(f))


@query("broad_title_guard", sql=with_ctes("docs") + """
    SELECT source AS word, count(*) AS titles FROM (SELECT substr(filename, 1, position('_' IN filename) - 1) AS source FROM docs)
    GROUP BY source HAVING count(*) > 1""")
def broad_title_guard(spark, sf):
    """Each source name as a question: it is broad when several titles hold it."""
    f = Frames(spark, sf)
    docs = f.documents().withColumn("title", F.regexp_replace("filename", "_", " "))
    titles = docs.select("document_id", F.explode(tx.technical_terms("title")).alias("term"))
    source = F.split("filename", "_")[0]
    words = docs.select(F.xxhash64(source).alias("query_id"), source.alias("term")).distinct()
    broad = index.broad_title_questions(words, titles)
    return words.join(broad, "query_id").select(F.col("term").alias("word"), "titles")


@query("title_fallback")
def title_fallback(spark, sf):
    """Identifier questions that also name their file."""
    f = Frames(spark, sf)
    docs = f.documents()
    asked = id_questions(f).join(docs.select(F.col("document_id").alias("query_id"), tx.stem("filename").alias("title")), "query_id").select(
        "query_id", F.concat_ws(" ", "title", "text").alias("text"))
    return index.identifier_search(index.identifier_terms(asked), _lexical(f), K, None, index.filename_index(
        docs.where("status = 'ready' AND lifecycle = 'active'")))


@query("query_alias_rules", sql=with_ctes("questions", "query_terms") + """
    SELECT query_id, string_agg(term, ' ' ORDER BY term) AS terms FROM (
      SELECT query_id, CASE WHEN term = 'tp' THEN 'tp#timer' ELSE term END AS term FROM query_terms
      UNION SELECT query_id, unnest(['tp#timer', 'e84', 'log']) FROM questions) GROUP BY query_id""")
def query_alias_rules(spark, sf):
    f = Frames(spark, sf)
    asked = f.questions().withColumn("text", F.concat(F.lit("E84 日志 TP "), "text"))
    terms = index.apply_alias_rules("text", tx.technical_terms("text"))
    return asked.select("query_id", F.array_join(F.array_sort(terms), " ").alias("terms"))


@query("filename_scope", sql=with_ctes("scope", "docs") + """,
    named AS (SELECT query_id, CASE WHEN query_id % 4 = 3 THEN 'unknown.pdf' ELSE filename END AS name, query_id % 4 AS form
              FROM questions JOIN docs ON docs.document_id = questions.query_id)
    SELECT s.query_id, s.document_id FROM scope s JOIN named n USING (query_id) JOIN docs d USING (document_id)
    JOIN questions q ON q.query_id = s.query_id
    WHERE (n.form = 2 AND NOT q.unrestricted) OR (n.form IN (0, 1) AND d.filename = n.name)""")
def filename_scope(spark, sf):
    """Questions name their file, quote it, exclude it, or name an unknown one."""
    f = Frames(spark, sf)
    docs = f.documents()
    form = F.col("query_id") % 4
    named = f.questions().join(docs.select(F.col("document_id").alias("query_id"), "filename"), "query_id")
    text = (F.when(form == 0, F.concat(F.lit("《"), "filename", F.lit("》 里写了什么")))
            .when(form == 1, F.concat(F.lit("请根据 "), F.upper("filename"), F.lit(" 回答")))
            .when(form == 2, F.concat(F.lit("不要根据《"), "filename", F.lit("》回答"))).otherwise("《unknown.pdf》 里写了什么"))
    scope = index.filename_scope(named.withColumn("text", text), scope_of(f), docs)
    return access.requested_scope(scope)


# --- vectors ------------------------------------------------------------------------------------

define("pairs", """
    SELECT q.chunk_id AS query_id, c.chunk_id, c.document_id, round(list_dot_product(q.vector, c.vector), 9) AS score
    FROM vectors q, vectors c WHERE q.chunk_id % 20 = 0""", "vectors")
define("semantic", """
    SELECT query_id, chunk_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM pairs WHERE score >= 0.25 QUALIFY rank <= 20""", "pairs")


def _vector_questions(f: Frames):
    """The rows whose id is divisible by 20 ask, all rows are searched."""
    return f.vectors().where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "vector")


@query("embed", sql="SELECT doc_id AS document_id, 64 AS dim, 1.0::DOUBLE AS norm FROM documents")
def embed(spark, sf):
    rows = vectors.embed(Frames(spark, sf).documents().select("document_id", "text"), make_encoder=lambda: vectors.HashEncoder(64))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("document_id", F.size("vector").alias("dim"), F.round(norm, 4).alias("norm"))


@query("valid_vectors", sql=with_ctes("vectors") + "SELECT chunk_id, len(vector) AS dim FROM vectors WHERE chunk_id % 9 NOT IN (1, 2, 3, 4)")
def valid_vectors(spark, sf):
    """Missing, empty, short and non-finite vectors among the given ones."""
    case, nan = F.col("chunk_id") % 9, F.array(F.lit(float("nan")).cast("float"))
    damaged = (F.when(case == 1, F.lit(None).cast("array<float>")).when(case == 2, F.array().cast("array<float>"))
               .when(case == 3, F.slice("vector", 1, 10)).when(case == 4, F.concat(F.slice("vector", 2, 63), nan)).otherwise(F.col("vector")))
    rows = vectors.valid_vectors(Frames(spark, sf).vectors().withColumn("vector", damaged), 64)
    return rows.select("chunk_id", F.size("vector").alias("dim"))


@query("cosine_topk", sql=with_ctes("semantic") + "SELECT query_id, chunk_id, document_id, score, rank FROM semantic")
def cosine_topk(spark, sf):
    f = Frames(spark, sf)
    return vectors.cosine_topk(_vector_questions(f), f.vectors(), 20)


@query("pruned_topk", sql=with_ctes("semantic") + "SELECT query_id, chunk_id, document_id, score, rank FROM semantic")
def pruned_topk(spark, sf):
    """The rows of ``cosine_topk`` from the cells that can hold them."""
    f = Frames(spark, sf)
    return cells.pruned_topk(_vector_questions(f), cells.build_cells(f.vectors()), 20)


define("vector_scope", """
    SELECT q.chunk_id AS query_id, d.document_id FROM vectors q, (SELECT DISTINCT document_id FROM vectors) d
    WHERE (d.document_id % 5 <> 0 OR q.chunk_id % 50 = 0 OR (q.chunk_id * 3) % 100 = d.document_id)
      AND (q.chunk_id % 3 <> 0 OR (q.chunk_id * 7 % 100) = d.document_id OR ((q.chunk_id * 7 + 5) % 100) = d.document_id)""", "vectors")


@query("cosine_topk_scoped", sql=with_ctes("pairs", "vector_scope") + """
    SELECT query_id, chunk_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM pairs JOIN vector_scope USING (query_id, document_id) QUALIFY rank <= 5""")
def cosine_topk_scoped(spark, sf):
    f = Frames(spark, sf)
    q = F.col("query_id")
    asked = _vector_questions(f)
    requested = asked.where(q % 3 == 0).select("query_id", F.explode(F.array(q * 7 % 100, (q * 7 + 5) % 100)).alias("document_id"))
    scope = access.Scope(asked.select("query_id", (q % 50 == 0).alias("see_all"), (q % 3 == 0).alias("has_request")),
                         f.vectors().select("document_id", (F.col("document_id") % 5 != 0).alias("shared")).distinct(),
                         asked.select("query_id", (q * 3 % 100).alias("document_id")), requested)
    return vectors.cosine_topk(asked, f.vectors(), 5, None, scope)


define("history", """
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.chunk_id AS query_id, c.chunk_id, round(list_dot_product(p.vector, c.vector), 9) AS score
      FROM vectors q JOIN vectors p ON p.chunk_id = q.chunk_id - 1, vectors c WHERE q.chunk_id % 20 = 0) WHERE score >= 0.25 QUALIFY rank <= 20""", "vectors")


@query("history_fusion", sql=with_ctes("semantic", "history") + """,
    parts AS (SELECT query_id, chunk_id, 2.0::DOUBLE / (60 + rank) AS part, rank AS current_rank FROM semantic
              UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank), NULL FROM history),
    fused AS (SELECT query_id, chunk_id, sum(part) AS rrf, min(current_rank) AS current_rank FROM parts GROUP BY ALL)
    SELECT query_id, chunk_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, current_rank NULLS LAST, chunk_id) AS rank
    FROM fused QUALIFY rank <= 20""")
def history_fusion(spark, sf):
    """The previous question of a vector question is the one numbered before it."""
    f = Frames(spark, sf)
    asked = _vector_questions(f)
    before = f.vectors().select((F.col("chunk_id") + 1).alias("query_id"), "vector").join(asked.select("query_id"), "query_id", "left_semi")
    return vectors.history_fusion(vectors.cosine_topk(asked, f.vectors(), 20), vectors.cosine_topk(before, f.vectors(), 20), 20)


def _channels(f: Frames):
    """A semantic, a technical and a general ranking over the given vectors."""
    semantic = persist(vectors.cosine_topk(_vector_questions(f), f.vectors(), 20))
    technical = index.top_per_query(semantic.where((F.col("chunk_id") + F.col("query_id")) % 3 == 0).drop("rank"), 10, F.col("chunk_id"))
    general = index.top_per_query(semantic.where((F.col("chunk_id") + F.col("query_id")) % 4 == 0).drop("rank"), 10, F.col("chunk_id").desc())
    return semantic, technical, general


define("technical_channel", """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS trank FROM semantic
    WHERE (chunk_id + query_id) % 3 = 0 QUALIFY trank <= 10""", "semantic")
define("general_channel", """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) AS grank FROM semantic
    WHERE (chunk_id + query_id) % 4 = 0 QUALIFY grank <= 10""", "semantic")
define("fused", """
    SELECT query_id, chunk_id, rrf, technical_hit, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, technical_hit DESC, chunk_id) AS rank FROM (
      SELECT query_id, chunk_id, sum(part) AS rrf, max(t) AS technical_hit FROM (
        SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS part, 0 AS t FROM semantic
        UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + trank), 1 FROM technical_channel
        UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + grank), 0 FROM general_channel) GROUP BY ALL) QUALIFY rank <= 20""",
       "technical_channel", "general_channel")


@query("rrf_fuse", sql=with_ctes("fused") + "SELECT query_id, chunk_id, rrf, technical_hit, rank FROM fused")
def rrf_fuse(spark, sf):
    f = Frames(spark, sf)
    return vectors.rrf_fuse(*_channels(f), 20, f.vectors())


@query("search_trace", sql=with_ctes("fused") + """
    SELECT s.query_id, s.chunk_id, s.rank AS semantic_rank, s.score AS semantic_score, t.trank AS technical_rank, t.score AS technical_score,
           g.grank AS general_rank, g.score AS general_score, f.rank AS fused_rank, f.rrf
    FROM semantic s LEFT JOIN technical_channel t USING (query_id, chunk_id) LEFT JOIN general_channel g USING (query_id, chunk_id)
    LEFT JOIN fused f USING (query_id, chunk_id)""")
def search_trace(spark, sf):
    semantic, technical, general = _channels(Frames(spark, sf))
    fused = vectors.rrf_fuse(semantic, technical, general, 20)
    return vectors.search_trace({"semantic": semantic, "technical": technical, "general": general}, fused)


def bm25_candidates(f: Frames, k: int = 60):
    """BM25 hits of the questions as candidates of the selection rules."""
    questions = f.questions()
    hits = index.bm25_search(index.or_terms(questions, tx.technical_terms("text")), _lexical(f), k)
    body = f.ready_chunks().select("chunk_id", "seq", "filename", "page", "paragraph", "content")
    return (hits.select("query_id", "chunk_id", "document_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("position"))
            .join(body, "chunk_id").join(questions.select("query_id", F.col("text").alias("question")), "query_id"))


@query("rerank_windows")
def rerank_windows(spark, sf):
    return vectors.rerank_windows(bm25_candidates(Frames(spark, sf), 20)).select("query_id", "chunk_id", "window", F.length("passage").alias("chars"))


@query("rerank")
def rerank(spark, sf):
    return vectors.rerank(bm25_candidates(Frames(spark, sf), 20)).select("query_id", "chunk_id", "position", "rerank_score", "rerank_rank", "rerank_error")


@query("image_hint_search")
def image_hint_search(spark, sf):
    """Documents described by their first line, asked for by the three longest words of a line."""
    f = Frames(spark, sf)
    encoder = lambda: vectors.HashEncoder(64)
    lines = f.chunks().where("seq = 0").select("document_id", F.col("content").alias("search_text"))
    hints = vectors.embed(lines, "search_text", encoder)
    asked = vectors.embed(id_questions(f), "text", encoder)
    # The hash encoder knows no similarity, so a question borrows the vector of its own line.
    own = hints.select(F.col("document_id").alias("query_id"), F.col("vector").alias("own"))
    asked = asked.join(own, "query_id").select("query_id", "text", F.col("own").alias("vector"))
    return vectors.image_hint_search(asked, hints)


@query("hybrid_search")
def hybrid_search(spark, sf):
    f = Frames(spark, sf)
    corpus = retrieval.build_corpus(f.documents(), materialize(f.ready_chunks()), lambda: vectors.HashEncoder(64))
    channels = retrieval.hybrid_search(f.questions(), corpus, 60, scope_of(f), None, lambda: vectors.HashEncoder(64))
    return channels["fused"].select("query_id", "chunk_id", "rrf", "technical_hit", "rank")


@query("retrieve")
def retrieve(spark, sf):
    """Flagship: cited sources of every question within the scope of its user."""
    f = Frames(spark, sf)
    encoder = lambda: vectors.HashEncoder(64)
    corpus = retrieval.build_corpus(f.documents(), materialize(f.ready_chunks()), encoder)
    found = retrieval.retrieve(f.questions(), corpus, 3, scope_of(f), None, encoder)
    return found.select("query_id", "slot", "chunk_id", "document_id", "filename", "relation", "source_no", "score", "content", "reason")


def revised_index(f: Frames) -> segments.SegmentedIndex:
    """The ready chunks after a history of batches: half of the documents come first in an older, shorter form, strangers come and go, then two batches replace or add."""
    chunks = materialize(f.ready_chunks().select("chunk_id", "document_id", "seq", "content"))
    built = segments.SegmentedIndex(f.spark, f"{shared_dir(f.spark)}/segments-{uuid.uuid4().hex}", fan=3)
    odd = F.pmod(F.xxhash64("document_id"), F.lit(4))
    built.apply(chunks.where((odd < 2) & (F.col("seq") % 2 == 0)))
    strangers = chunks.where(odd == 3).select((-1 - F.col("chunk_id")).alias("chunk_id"), (-1 - F.col("document_id")).alias("document_id"), "content")
    built.apply(strangers.unionByName(chunks.where(odd == 2).select("chunk_id", "document_id", "content")))
    built.apply(chunks.where(odd.isin(0, 3)))
    built.apply(chunks.where(odd == 1), strangers.select("document_id"))
    return built


@query("segmented_search", sql=with_ctes("shares") + ", s AS (SELECT query_id, chunk_id, document_id, sum(share) AS score FROM shares GROUP BY ALL) "
       + _ranked("s"))
def segmented_search(spark, sf):
    """Search over segments, tombstones and signed statistics: the rows of a fresh build."""
    f = Frames(spark, sf)
    return index.bm25_search(index.or_terms(f.questions(), tx.technical_terms("text")), revised_index(f).lexical(), K)


@query("segment_frequencies", sql=with_ctes("frequencies", "index_stats") + "SELECT term, df, n_chunks, round(avg_length, 9) AS avg_length FROM frequencies, index_stats")
def segment_frequencies(spark, sf):
    """Statistics after all full tiers were merged."""
    built = revised_index(Frames(spark, sf))
    built.compact()
    found = built.lexical()
    stats = found.stats.first()
    return found.frequencies.select("term", "df", F.lit(stats["n_chunks"]).alias("n_chunks"), F.round(F.lit(stats["avg_length"]), 9).alias("avg_length"))
