"""Queries over chunking, term extraction and index tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import chunking, index
from docweave.plans.catalog import query
from docweave.plans.ctes import define, with_ctes
from docweave.plans.frames import Frames
from docweave.sources import html, logs

SEPARATOR = "\n"


@query("token_count", sql="""
    SELECT doc_id AS document_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1,
           (length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) + 1) // 2
           + (length(regexp_replace(text, '[\\x{4E00}-\\x{9FFF}]', '', 'g')) + 3) // 4) END AS tokens FROM documents""")
def token_count(spark, sf):
    return Frames(spark, sf).documents().select("document_id", tx.token_count("text").alias("tokens"))


@query("split_long")
def split_long(spark, sf):
    return chunking.split_texts(Frames(spark, sf).documents(), "document_id")


@query("chunk_documents")
def chunk_documents(spark, sf):
    return chunking.chunk_documents(Frames(spark, sf).documents(), separator=SEPARATOR)[0]


@query("chunk_units")
def chunk_units(spark, sf):
    """Lines of pdf documents carry pages, the others paragraphs."""
    rows = Frames(spark, sf).chunks().select("document_id", F.col("seq").alias("unit_no"), "page", "paragraph", F.col("content").alias("text"))
    return chunking.chunk_units(rows)[0]


@query("chunk_table_rows")
def chunk_table_rows(spark, sf):
    """Word table rows, each with its header, stand alone."""
    from docweave.operators import units
    rows = units.row_units_with_header(Frames(spark, sf).part_rows().withColumnRenamed("sheet", "table_no"))
    numbered = rows.select(F.pmod(F.xxhash64("table_no"), F.lit(1 << 40)).alias("document_id"), F.col("paragraph").alias("unit_no"),
                           F.lit(None).cast("long").alias("page"), "paragraph", "text")
    return chunking.chunk_units(numbered)[0]


@query("chunk_log")
def chunk_log(spark, sf):
    """Lines beyond one chunk make a file an error row instead of a cut line."""
    files = logs.log_files(Frames(spark, sf).log_files())
    pieces, errors = chunking.chunk_log(files, max_tokens=800, overlap=120)
    return pieces.select("file_id", "seq", "line_start", "line_end", "token_count", F.lit(None).cast("string").alias("error_code")).unionByName(
        errors.select("file_id", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("line_start"),
                      F.lit(None).cast("long").alias("line_end"), F.lit(None).cast("long").alias("token_count"), "error_code"))


@query("chunk_blocks")
def chunk_blocks(spark, sf):
    return chunking.chunk_blocks(html.articles(Frames(spark, sf).table("pages")))[0]


def captioned(spark, sf):
    """Documents as described images: the description is the first line."""
    docs = Frames(spark, sf).documents()
    return docs.select("document_id", F.concat(F.lit("说明： "), tx.lines_of("text")[0]).alias("caption"),
                       (F.col("document_id") % 2 == 0).alias("caption_only"), "text")


def caption_index(docs):
    """Stored chunks of the described images: caption pieces, then noted image text."""
    captions, _ = chunking.caption_chunks(docs)
    texts = chunking.image_text_chunks(docs.where(~F.col("caption_only")).select("document_id", "text"))
    counts = captions.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    shifted = texts.join(counts, "document_id").withColumn("seq", F.col("seq") + F.col("_n")).drop("_n")
    chunks = captions.unionByName(shifted)
    sizes = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("num_chunks"))
    return docs.drop("text").join(sizes, "document_id"), chunks


@query("caption_chunks")
def caption_chunks(spark, sf):
    return chunking.caption_chunks(captioned(spark, sf))[0]


@query("image_text_chunks")
def image_text_chunks(spark, sf):
    return chunking.image_text_chunks(Frames(spark, sf).documents())


def _replaced(spark, sf):
    docs, chunks = caption_index(captioned(spark, sf))
    key = F.col("document_id")
    changes = docs.select("document_id", F.when(key % 7 == 0, "stale").otherwise(F.col("caption")).alias("expected_caption"),
                          F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("new "), F.col("caption"))).alias("new_caption"))
    damaged = chunks.where(~((key % 11 == 0) & (F.col("seq") == 0)))
    return chunking.replace_caption(docs, damaged, changes)


@query("replace_caption")
def replace_caption(spark, sf):
    return _replaced(spark, sf)[0]


@query("replace_caption_outcome")
def replace_caption_outcome(spark, sf):
    return _replaced(spark, sf)[1]


# --- terms ------------------------------------------------------------------------------------


@query("technical_terms", sql=with_ctes("chunks") + """
    SELECT chunk_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(content), '[a-z][a-z0-9]*(?:[_.-][a-z0-9]+)*'))), ' ') AS terms
    FROM chunks""")
def technical_terms(spark, sf):
    return Frames(spark, sf).chunks().select("chunk_id", F.array_join(F.array_sort(tx.technical_terms("content")), " ").alias("terms"))


@query("lexical_terms", sql=with_ctes("chunks") + """,
    texts AS (SELECT chunk_id, '编号' || seq || ' 第' || document_id || '号 设备参数 ' || (seq * 0.5)::DECIMAL(10,1) || ' ok' AS t FROM chunks),
    parts AS (
        SELECT chunk_id, 'n' || lower(hex(x)) AS term FROM (
            SELECT chunk_id, unnest(list_filter(string_split(t, ' '), lambda w: regexp_full_match(w, '[0-9]+[.][0-9]'))) AS x FROM texts)
        UNION ALL
        SELECT chunk_id, 'n' || lower(hex(CAST(seq AS VARCHAR))) FROM chunks
        UNION ALL
        SELECT chunk_id, 'n' || lower(hex(CAST(document_id AS VARCHAR))) FROM chunks
        UNION ALL
        SELECT chunk_id, unnest([ 'z2' || lower(hex('编号')), 'z1' || lower(hex('编')), 'z1' || lower(hex('号')), 'z1' || lower(hex('第')),
               'z2' || lower(hex('设备')), 'z2' || lower(hex('备参')), 'z2' || lower(hex('参数')),
               'z1' || lower(hex('设')), 'z1' || lower(hex('备')), 'z1' || lower(hex('参')), 'z1' || lower(hex('数'))]) FROM chunks)
    SELECT chunk_id, string_agg(DISTINCT term, ' ' ORDER BY term) AS terms FROM parts GROUP BY chunk_id""")
def lexical_terms(spark, sf):
    """A Chinese label with the chunk's numbers stands for each chunk."""
    half = F.format_string("%d.%d", F.floor(F.col("seq") / 2).cast("long"), ((F.col("seq") % 2) * 5).cast("long"))
    text = F.concat(F.lit("编号"), F.col("seq").cast("string"), F.lit(" 第"), F.col("document_id").cast("string"),
                    F.lit("号 设备参数 "), half, F.lit(" ok"))
    return Frames(spark, sf).chunks().select("chunk_id", F.array_join(F.array_sort(tx.lexical_terms(text)), " ").alias("terms"))


define("terms", """
    SELECT chunk_id, document_id, unnest(t) AS term, len(t) AS length FROM (
      SELECT chunk_id, document_id, list_distinct(list_concat(t,
               CASE WHEN len(list_filter(t, lambda x: regexp_full_match(x, 'tp[0-9]*'))) > 0 THEN ['tp#timer'] ELSE [] END,
               flatten(list_transform(list_filter(t, lambda x: regexp_full_match(x, '[a-z]+(-[a-z]+)+')), lambda x: string_split(x, '-'))))) AS t
      FROM (SELECT chunk_id, document_id, list_distinct(regexp_extract_all(lower(content), '[a-z][a-z0-9]*(?:[_.-][a-z0-9]+)*')) AS t
            FROM ready_chunks))""", "ready_chunks")
define("frequencies", "SELECT term, count(*) AS df FROM terms GROUP BY term", "terms")
define("index_stats", """
    SELECT count(*) AS n_chunks, avg(l) AS avg_length FROM
      (SELECT r.chunk_id, coalesce(max(t.length), 0) AS l FROM ready_chunks r LEFT JOIN terms t USING (chunk_id) GROUP BY r.chunk_id)""", "terms")
define("query_terms", """
    SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]*(?:[_.-][a-z0-9]+)*'))) AS term FROM questions""", "questions")
define("shares", """
    SELECT q.query_id, t.chunk_id, t.document_id, t.term,
           (CASE WHEN ln((s.n_chunks - f.df + 0.5) / (f.df + 0.5)) > 0 THEN ln((s.n_chunks - f.df + 0.5) / (f.df + 0.5)) ELSE 1e-6 END)
           * 2.2 / (1 + 1.2 * (0.25 + 0.75 * t.length / s.avg_length)) AS share
    FROM query_terms q JOIN terms t USING (term) JOIN frequencies f USING (term), index_stats s""",
       "query_terms", "terms", "frequencies", "index_stats")


@query("expand_terms")
def expand_terms(spark, sf):
    """Bodies with a stream code, a timer and a hyphen word added."""
    text = F.concat("content", F.lit(" S"), (F.col("seq") % 9).cast("string"), F.lit(" , F"), (F.col("document_id") % 13).cast("string"),
                    F.lit(" TP1 load-port"))
    return Frames(spark, sf).chunks().select("chunk_id", F.array_join(F.array_sort(tx.body_terms(text)), " ").alias("terms"))


@query("filename_terms", sql=with_ctes("docs") + """
    SELECT document_id, regexp_extract(lower(filename), '^[a-z][a-z0-9]*(?:[_.-][a-z0-9]+)*_[0-9]+') AS terms, lower(filename) AS name FROM docs""")
def filename_terms(spark, sf):
    return Frames(spark, sf).documents().select(
        "document_id", F.array_join(tx.filename_terms("filename"), " ").alias("terms"), tx.normal_filename("filename").alias("name"))


@query("build_index_postings", sql=with_ctes("terms") + "SELECT term, document_id, chunk_id, length FROM terms")
def build_index_postings(spark, sf):
    return index.build_index(Frames(spark, sf).ready_chunks()).postings.select("term", "document_id", "chunk_id", "length")


@query("build_index_frequencies", sql=with_ctes("frequencies") + "SELECT term, df FROM frequencies")
def build_index_frequencies(spark, sf):
    return index.build_index(Frames(spark, sf).ready_chunks()).frequencies


@query("build_index_stats", sql=with_ctes("index_stats") + "SELECT n_chunks, avg_length FROM index_stats")
def build_index_stats(spark, sf):
    return index.build_index(Frames(spark, sf).ready_chunks()).stats


@query("table_headers", sql="""
    SELECT p_partkey % 5 AS document_id, p_brand AS sheet, min(p_partkey) AS chunk_id, 'A=Type;B=Input;C=x' AS columns
    FROM part GROUP BY ALL""")
def table_headers(spark, sf):
    """A header row in every chunk: the first chunk of a sheet wins."""
    part = Frames(spark, sf).table("part")
    rows = part.select(F.col("p_partkey").alias("chunk_id"), (F.col("p_partkey") % 5).alias("document_id"), F.lit("t.xlsx").alias("filename"),
                       F.concat(F.lit("工作表《"), "p_brand", F.lit("》第 1 行：A1=Type；B1=Input；C1=x")).alias("content"))
    headers = index.table_headers(rows)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return headers.select("document_id", "sheet", "chunk_id", shown.alias("columns"))
