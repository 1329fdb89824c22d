"""Queries over candidate selection and context completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import completion, selection, units
from docweave.plans.catalog import query
from docweave.plans.chunk_index import caption_index, captioned
from docweave.plans.ctes import define, with_ctes
from docweave.plans.frames import Frames
from docweave.plans.governance import gram_index
from docweave.plans.retrieval import bm25_candidates
from docweave.runtime import materialize, persist
from docweave.sources import html


def doubled(f: Frames):
    """Candidates with an exact copy, a shortened copy and a blank copy of some of them."""
    rows = persist(bm25_candidates(f, 20))
    key = F.col("chunk_id")

    def copy(step: int, content, condition):
        return rows.where(condition).withColumn("chunk_id", -(key * 10 + step)).withColumn(
            "position", F.col("position") + 100 * step).withColumn("content", content)

    return (rows.unionByName(copy(1, F.col("content"), key % 3 == 0))
            .unionByName(copy(2, F.expr("substring(content, 3, length(content) - 6)"), key % 4 == 0))
            .unionByName(copy(3, F.lit("  "), key % 5 == 0)))


define("candidates", """
    SELECT b.query_id, b.chunk_id, b.document_id, b.rank AS position, r.page, r.paragraph, r.content FROM
      (SELECT query_id, chunk_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
       FROM (SELECT query_id, chunk_id, document_id, sum(share) AS score FROM shares GROUP BY ALL) QUALIFY rank <= 20) b
    JOIN ready_chunks r USING (chunk_id)""", "shares", "ready_chunks")
define("doubled", """
    SELECT * FROM candidates
    UNION ALL SELECT query_id, -(chunk_id * 10 + 1), document_id, position + 100, page, paragraph, content FROM candidates WHERE chunk_id % 3 = 0
    UNION ALL SELECT query_id, -(chunk_id * 10 + 2), document_id, position + 200, page, paragraph,
                     substr(content, 3, CAST(greatest(length(content) - 6, 0) AS BIGINT)) FROM candidates WHERE chunk_id % 4 = 0
    UNION ALL SELECT query_id, -(chunk_id * 10 + 3), document_id, position + 300, page, paragraph, '  ' FROM candidates WHERE chunk_id % 5 = 0""", "candidates")


@query("dedup_same_location", sql=with_ctes("doubled") + """
    SELECT query_id, chunk_id, trim(content) <> '' AND row_number() OVER (
             PARTITION BY query_id, document_id, page, paragraph, content ORDER BY position) = 1 AS kept FROM doubled""")
def dedup_same_location(spark, sf):
    return selection.dedup_same_location(doubled(Frames(spark, sf))).select("query_id", "chunk_id", "kept")


@query("dedup_contained", sql=with_ctes("doubled") + """
    , t AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS text FROM doubled)
    SELECT query_id, chunk_id, text <> '' AND NOT EXISTS (SELECT 1 FROM t o WHERE o.query_id = t.query_id AND o.document_id = t.document_id
             AND (length(o.content) > length(t.content) OR (length(o.content) = length(t.content) AND o.position < t.position))
             AND contains(o.text, t.text)) AS kept FROM t""")
def dedup_contained(spark, sf):
    return selection.dedup_contained(doubled(Frames(spark, sf))).select("query_id", "chunk_id", "kept")


@query("verified_continuation")
def verified_continuation(spark, sf):
    """Overlapping windows of long lines: each verifies the next one of its document."""
    from docweave.operators import chunking
    rows = chunking.chunk_documents(Frames(spark, sf).documents(), max_tokens=100, overlap=30)[0]
    candidates = rows.select(F.lit(0).alias("query_id"), (F.col("document_id") * 100000 + F.col("seq")).alias("chunk_id"),
                             "document_id", "seq", "page", "paragraph", "content")
    return selection.verified_continuations(candidates)


@query("select_ranked")
def select_ranked(spark, sf):
    return selection.select_ranked(doubled(Frames(spark, sf)), 5)


def worded(f: Frames):
    """Candidates whose question and text carry Chinese words, field values and word forms."""
    n = F.col("chunk_id") % 7
    added = F.concat(F.lit("\n设备通讯"), F.when(n < 2, "参数设置步骤").when(n < 4, "参数").otherwise("记录"),
                     F.when(n == 5, " MODE=3 loading").otherwise(" MODE=13"))
    return (persist(bm25_candidates(f, 40)).withColumn("question", F.concat("question", F.lit(" 设备通讯参数设置 mode=3 load")))
            .withColumn("content", F.concat("content", added)))


@query("bigram_promotion")
def bigram_promotion(spark, sf):
    rows = selection.bigram_promotion(selection.with_features(worded(Frames(spark, sf))), 3)
    return rows.select("query_id", "chunk_id", "position", "promoted")



@query("field_value_match", sql=with_ctes("chunks") + """
    SELECT chunk_id, CASE WHEN seq % 10 = 3 OR document_id % 4 = 1 THEN 'mode=3' ELSE '' END AS matches FROM chunks""")
def field_value_match(spark, sf):
    """``MODE=n`` in the text, or an enum line in the block of that field."""
    n = F.col("seq") % 10
    block = F.when(F.col("document_id") % 4 == 1, "\nMODE Format: U 1\n 3 = run\n 13 = stop\nWhere used: S1F1").otherwise(
        "\nKIND Format: U 1\n 3 = run\nWhere used: S1F1")
    content = F.concat("content", F.lit("\nXMODE=3 MODE="), n.cast("string"), F.lit(" MODE=30 "), block)
    rows = Frames(spark, sf).chunks().select("chunk_id", selection.field_value_matches(F.lit("mode=3 是什么"), content, "filename").alias("m"))
    return rows.select("chunk_id", F.array_join("m", " ").alias("matches"))


@query("wordform_match")
def wordform_match(spark, sf):
    rows = selection.with_features(worded(Frames(spark, sf)))
    forms = selection.wordform_matches("_asked", "_words", "_present", "_title")
    return rows.select("query_id", "chunk_id", F.array_join(forms, " ").alias("matches"))


@query("priority_order")
def priority_order(spark, sf):
    return selection.order_candidates(worded(Frames(spark, sf)), 3).select(
        "query_id", "chunk_id", "position", "promoted", F.size("field_matches").alias("fields"), F.size("word_matches").alias("words"))


@query("select_sources")
def select_sources(spark, sf):
    return selection.select_sources(worded(Frames(spark, sf)), 3)


# --- completion ---------------------------------------------------------------------------------


@query("section_boundary", sql=with_ctes("chunks") + """
    SELECT chunk_id, CASE seq % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true
           WHEN 4 THEN false WHEN 5 THEN false WHEN 6 THEN true ELSE false END AS boundary FROM chunks""")
def section_boundary(spark, sf):
    """Chapter, enumerated, markdown, numbered, unit, decimal, dotted and plain lines."""
    n, text = F.col("seq") % 8, F.col("content")
    line = (F.when(n == 0, F.concat(F.lit("第 3 章 "), text)).when(n == 1, F.concat(F.lit("二、"), text)).when(n == 2, F.concat(F.lit("## "), text))
            .when(n == 3, F.concat(F.lit("4. Title "), text)).when(n == 4, F.concat(F.lit("5. seconds "), text))
            .when(n == 5, F.lit("0.5")).when(n == 6, F.concat(F.lit("1.2 Title "), text)).otherwise(F.concat(F.lit("- "), text)))
    return Frames(spark, sf).chunks().select("chunk_id", completion.section_boundary(line).alias("boundary"))


def _sources(f: Frames, k: int = 5):
    rows = persist(bm25_candidates(f, k))
    return rows.withColumnRenamed("position", "slot")


@query("attach_continuations")
def attach_continuations(spark, sf):
    """Every third chunk lost its final stop, so its text goes on in the next one."""
    f = Frames(spark, sf)
    torn = lambda df: df.withColumn("content", F.when(F.col("chunk_id") % 3 == 0, F.regexp_replace("content", r"\.$", "")).otherwise(F.col("content")))
    return completion.attach_continuations(torn(_sources(f)), torn(f.ready_chunks())).select(
        "query_id", "after_slot", "chunk_id", "continuation_of", "trimmed_at_section", F.length("content").alias("chars"))


def literal_questions(f: Frames):
    """Every document asks for the phrase of its own second to fourth words and for two codes."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w.rlike("^[A-Za-z]{4,}$"))
    phrase = F.array_join(F.slice(words, 1, 1), " ")
    return f.documents().select(F.col("document_id").alias("query_id"), F.concat(
        F.lit("报警 2, "), (F.col("document_id") % 30).cast("string"), F.lit(" 与 0x1F 的 bit4 和 “"), phrase, F.lit("” 是什么")).alias("text"))


@query("question_literals", sql="""
    SELECT doc_id AS query_id, '2,' || (doc_id % 30) || '|0x1F|bit4' || CASE WHEN length(w) >= 2 AND w <> 'bit4' AND w <> '0x1F' THEN '|' || w ELSE '' END AS literals FROM (
      SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_full_match(w, '[A-Za-z]{4,}'))[1], '') AS w FROM documents)""")
def question_literals(spark, sf):
    asked = literal_questions(Frames(spark, sf))
    return asked.select("query_id", F.array_join(completion.question_literals("text"), "|").alias("literals"))


define("phrase_literals", """
    SELECT doc_id AS query_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_full_match(w, '[A-Za-z]{7,}'))[1] AS literal
    FROM documents""")


def _literals(f: Frames):
    """One literal per document: its first long word."""
    word = F.get(F.filter(F.split("text", r"\s+"), lambda w: w.rlike("^[A-Za-z]{7,}$")), F.lit(0))
    return f.documents().select(F.col("document_id").alias("query_id"), F.lit(0).alias("literal_no"), word.alias("literal")).where(
        F.col("literal").isNotNull())


@query("literal_candidates", sql=with_ctes("ready_chunks", "phrase_literals") + """,
    hits AS (SELECT p.query_id, p.literal, c.document_id, c.chunk_id FROM phrase_literals p JOIN ready_chunks c
             ON contains(translate(c.content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         translate(p.literal, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) WHERE p.literal IS NOT NULL),
    near AS (SELECT query_id, document_id FROM (SELECT DISTINCT query_id, document_id FROM hits)
             QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY document_id) <= 24)
    SELECT query_id, literal, document_id, chunk_id, row_number() OVER (PARTITION BY query_id, document_id ORDER BY chunk_id) AS row_no
    FROM hits SEMI JOIN near USING (query_id, document_id) QUALIFY row_no <= 2""")
def literal_candidates(spark, sf):
    f = Frames(spark, sf)
    return completion.literal_candidates(_literals(f), f.ready_chunks()).select("query_id", "literal", "document_id", "chunk_id", "row_no")


@query("literal_matches", sql=with_ctes("ready_chunks", "phrase_literals") + """
    SELECT p.query_id, p.literal, c.document_id, c.chunk_id FROM phrase_literals p JOIN ready_chunks c
      ON contains(translate(c.content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  translate(p.literal, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) WHERE p.literal IS NOT NULL""")
def literal_matches(spark, sf):
    """Every chunk that states a literal, of all documents, through the substring index."""
    f = Frames(spark, sf)
    chunks = materialize(f.ready_chunks())
    hits = completion.literal_hits(_literals(f), chunks, index=gram_index(spark, chunks))
    return hits.where("exact").select("query_id", "literal", "document_id", "chunk_id")


@query("attach_literals")
def attach_literals(spark, sf):
    f = Frames(spark, sf)
    asked = f.questions().select("query_id", F.posexplode(F.slice(F.filter(F.split("text", r"\s+"), lambda w: w.rlike("^[A-Za-z]{5,}$")), 1, 6)).alias(
        "literal_no", "literal"))
    return completion.attach_literals(_sources(f), completion.literal_candidates(asked, f.ready_chunks()))


def table_chunks(f: Frames):
    """The part table as chunks of one spreadsheet, a row per chunk."""
    rows = units.row_units(f.part_rows())
    return rows.select(F.pmod(F.xxhash64("sheet", "paragraph"), F.lit(1 << 50)).alias("chunk_id"), "document_id", F.col("paragraph").alias("seq"),
                       F.lit("Parts.xlsx").alias("filename"), F.lit(None).cast("long").alias("page"), "paragraph", F.col("text").alias("content"))


def row_questions(f: Frames):
    return f.table("part").select(F.col("p_partkey").alias("query_id"), F.concat(
        F.lit("《parts.XLSX》 的《"), "p_brand", F.lit("》第 "), (F.col("p_partkey") + 2).cast("string"), F.lit(" 行是什么")).alias("text"))


@query("table_row_address", sql="""
    SELECT p_partkey AS query_id, '工作表《' || p_brand || '》第 ' || (p_partkey + 2) || ' 行：A' || (p_partkey + 2) || '=' || p_partkey
           || '；B' || (p_partkey + 2) || '=' || p_name || '；C' || (p_partkey + 2) || '=' || p_type || '；D' || (p_partkey + 2) || '=' || p_size AS content,
           1.0::DOUBLE AS score FROM part""")
def table_row_address(spark, sf):
    f = Frames(spark, sf)
    documents = spark.createDataFrame([(1, "Parts.xlsx")], "document_id long, filename string")
    found = completion.table_row_address(row_questions(f), documents, table_chunks(f), 3)
    return found.select("query_id", "content", "score")


@query("header_rows", sql="SELECT DISTINCT 1 AS document_id, p_brand AS sheet, 1 AS \"row\" FROM part")
def header_rows(spark, sf):
    return completion.header_rows(table_chunks(Frames(spark, sf))).select("document_id", "sheet", "row")


@query("attach_table_headers", sql="SELECT p_partkey AS query_id, p_brand AS sheet, 1 AS extra_no FROM part")
def attach_table_headers(spark, sf):
    f = Frames(spark, sf)
    chunks = table_chunks(f)
    sources = completion.table_row_address(row_questions(f), spark.createDataFrame([(1, "Parts.xlsx")], "document_id long, filename string"), chunks, 3)
    return completion.attach_table_headers(sources, completion.header_rows(chunks)).select("query_id", "sheet", "extra_no")


@query("attach_row_continuation")
def attach_row_continuation(spark, sf):
    """Long cells split into overlapping chunks of one row."""
    from docweave.operators import chunking
    docs = Frames(spark, sf).documents().select("document_id", F.concat(F.lit("工作表《S》第 2 行：A2="), F.regexp_replace("text", "\n", " ")).alias("text"))
    rows = chunking.chunk_documents(docs, max_tokens=100, overlap=30)[0]
    chunks = rows.select((F.col("document_id") * 100000 + F.col("seq")).alias("chunk_id"), "document_id", "seq", F.lit("t.xlsx").alias("filename"),
                         "page", "paragraph", "content")
    first = chunks.where("seq = 0").select(F.col("document_id").alias("query_id"), F.lit(1).alias("slot"), "*")
    return completion.attach_row_continuation(first, chunks).select("query_id", "chunk_id", "continuation_of")


@query("attach_figures")
def attach_figures(spark, sf):
    """Every page shows one figure by adjacency; its image is a document of its own."""
    pages = Frames(spark, sf).table("pages")
    extra = '<p>见下图</p><p><img src="/near.png"></p></article>'
    parsed = html.articles(pages.withColumn("html", F.regexp_replace("html", "</article>", extra)))
    links = html.figure_links(parsed)
    articles = parsed.select(F.col("page_id").alias("document_id"), "url", "sha256")
    images = links.select((F.xxhash64("image_url", "sha256")).alias("document_id"), F.col("url").alias("article_url"),
                          F.col("sha256").alias("article_sha256"), "image_url").distinct()
    blocks = parsed.select("page_id", F.inline("blocks")).groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda b: b["text"]), " ").alias("content"))
    sources = blocks.select(F.col("page_id").alias("query_id"), F.lit(1).alias("slot"), F.col("page_id").alias("document_id"), "content")
    return completion.attach_figures(sources, articles, links, images)


@query("attach_captions")
def attach_captions(spark, sf):
    """Image questions that selected the image text only; every eleventh image lost a caption chunk."""
    docs, chunks = caption_index(captioned(spark, sf))
    chunks = chunks.withColumn("chunk_id", F.col("document_id") * 100000 + F.col("seq")).where(
        ~((F.col("document_id") % 11 == 0) & (F.col("seq") == 0)))
    last = chunks.groupBy("document_id").agg(F.max("seq").alias("seq"))
    sources = chunks.join(last, ["document_id", "seq"]).select((F.col("document_id") % 50).alias("query_id"), "document_id", "chunk_id")
    return completion.attach_captions(sources, docs, chunks)
