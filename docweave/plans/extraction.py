"""Queries over units, tables, web pages, logs and scanned pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import page_sets, units
from docweave.plans.catalog import query
from docweave.plans.ctes import define, with_ctes
from docweave.plans.frames import Frames
from docweave.sources import html, logs

CLEAN = (r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
    '\r\n|\r|\f', chr(10), 'g'), '　', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'),
    '[ \t]+', ' ', 'g'), ' ' || chr(10) || chr(9))""")


@query("clean_text", sql=f"SELECT doc_id AS document_id, sha256({CLEAN.format('text')}) AS clean_sha FROM documents")
def clean_text(spark, sf):
    return Frames(spark, sf).documents().select("document_id", F.sha2(tx.clean_text("text"), 256).alias("clean_sha"))


@query("paragraph_units", sql=f"""
    WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({CLEAN.format('text')}, chr(10)), lambda x: trim(x)),
                                          lambda x: x <> '') AS l FROM documents)
    SELECT doc_id AS document_id, generate_subscripts(l, 1) AS paragraph, unnest(l) AS text FROM p""")
def paragraph_units(spark, sf):
    """The given texts hold no blank lines, so a line is a paragraph here."""
    return units.paragraph_units(Frames(spark, sf).documents().select("document_id", "text"), separator="\n")


@query("row_units", sql=with_ctes("part_rows") + """
    SELECT document_id, sheet, "row" AS paragraph,
           '工作表《' || sheet || '》第 ' || "row" || ' 行：A' || "row" || '=' || vals[1] || '；B' || "row" || '=' || vals[2]
           || '；C' || "row" || '=' || vals[3] || '；D' || "row" || '=' || vals[4] AS text FROM part_rows""")
def row_units(spark, sf):
    return units.row_units(Frames(spark, sf).part_rows())


@query("row_units_sparse", sql="""
    SELECT o_custkey % 7 AS document_id, 'orders' AS sheet, o_orderkey AS paragraph,
           '工作表《orders》第 ' || o_orderkey || ' 行：'
           || CASE WHEN o_orderkey % 3 <> 0 THEN 'A' || o_orderkey || '=' || o_orderstatus || '；' ELSE '' END
           || 'C' || o_orderkey || '=' || o_custkey AS text FROM orders""")
def row_units_sparse(spark, sf):
    """Empty and NULL cells leave a gap in the column letters."""
    rows = Frames(spark, sf).table("orders").select(
        (F.col("o_custkey") % 7).alias("document_id"), F.lit("orders").alias("sheet"), F.col("o_orderkey").alias("row"),
        F.array(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")), F.lit("  "), F.col("o_custkey").cast("string")).alias("values"))
    return units.row_units(rows)


@query("row_units_with_header", sql=with_ctes("part_rows") + """,
    r AS (SELECT document_id, sheet AS table_no, "row", '文档表格《' || sheet || '》第 ' || "row" || ' 行：A' || "row" || '=' || vals[1]
           || '；B' || "row" || '=' || vals[2] || '；C' || "row" || '=' || vals[3] || '；D' || "row" || '=' || vals[4] AS text FROM part_rows)
    SELECT r.document_id, r.table_no, r."row" AS paragraph,
           CASE WHEN r."row" > 1 THEN h.text || chr(10) || r.text ELSE r.text END AS text
    FROM r JOIN r h ON h.table_no = r.table_no AND h."row" = 1""")
def row_units_with_header(spark, sf):
    return units.row_units_with_header(Frames(spark, sf).part_rows().withColumnRenamed("sheet", "table_no"))


@query("parse_rows", sql=with_ctes("part_rows") + """
    SELECT document_id, sheet, "row", unnest(['A','B','C','D']) AS "column", unnest(vals) AS value FROM part_rows""")
def parse_rows(spark, sf):
    """Rendering and parsing a table gives its cells back."""
    rendered = units.row_units(Frames(spark, sf).part_rows())
    return units.parse_rows(rendered.select("document_id", F.col("text").alias("content")))


# --- web pages --------------------------------------------------------------------------------


@query("html_articles")
def html_articles(spark, sf):
    parsed = html.articles(Frames(spark, sf).table("pages"))
    return parsed.select("page_id", "title", F.size("blocks").alias("blocks"), F.size("links").alias("links"),
                         F.size("images").alias("images"), "status", "sha256", "error_code")


@query("html_blocks")
def html_blocks(spark, sf):
    parsed = html.articles(Frames(spark, sf).table("pages"))
    return parsed.where(F.col("error_code").isNull()).select("page_id", F.inline("blocks"))


@query("heading_path")
def heading_path(spark, sf):
    parsed = html.articles(Frames(spark, sf).table("pages")).where(F.col("error_code").isNull())
    return units.explode_blocks(parsed.select("page_id", "blocks"))


def linked_pages(f: Frames):
    """Every article also links a neighbour and shows an image."""
    extra = F.concat(F.lit('<a href="/next/'), (F.col("page_id") % 7).cast("string"), F.lit('#top"> more </a><a href="mailto:x@y">m</a><img data-src="i.png" alt="pic"></article>'))
    return html.articles(f.table("pages").withColumn("html", F.regexp_replace("html", "</article>", extra)))


define("hosts", "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)') AS host, page_id % 7 AS k FROM pages")


@query("page_links", sql=with_ctes("hosts") + "SELECT page_id, 0 AS position, host || '/next/' || k || '#top' AS url, 'more' AS label FROM hosts")
def page_links(spark, sf):
    return html.page_links(linked_pages(Frames(spark, sf)))


@query("page_images")
def page_images(spark, sf):
    return html.page_images(linked_pages(Frames(spark, sf)))


@query("link_in_degree", sql=with_ctes("hosts") + """
    SELECT host || '/next/' || k || '#top' AS url, count(*) AS links, count(DISTINCT page_id) AS linking_pages FROM hosts GROUP BY 1""")
def link_in_degree(spark, sf):
    return html.link_in_degree(html.page_links(linked_pages(Frames(spark, sf))))


@query("figure_links")
def figure_links(spark, sf):
    """Every page also carries a figure built from its title, cited by number."""
    pages = Frames(spark, sf).table("pages")
    extra = F.concat(F.lit('<p>见下图</p><p><img src="/near.png"></p><figure><img src="/f.png"><figcaption>图 '),
                     (F.col("page_id") % 9 + 1).cast("string"), F.lit("</figcaption></figure><p>参见图"),
                     (F.col("page_id") % 9 + 1).cast("string"), F.lit("。</p></article>"))
    return html.figure_links(html.articles(pages.withColumn("html", F.regexp_replace("html", "</article>", extra))))


# --- logs -------------------------------------------------------------------------------------

define("log_lines", """
    SELECT file_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line
    FROM (SELECT file_id, string_split(content, chr(10)) AS l FROM log_files)""", "log_files")
define("log_records", """
    SELECT file_id, line_no, line, sum(CASE WHEN line_no = 1 OR regexp_matches(line, '^\\s*\\[?(\\d{4}[-/]\\d{2}[-/]\\d{2}[ T])?\\d{2}:\\d{2}:\\d{2}')
           THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS record_no
    FROM log_lines""", "log_lines")


@query("decode_log", sql="SELECT doc_id AS file_id, sha256(text) AS decoded_sha, "
       "(['utf-8','utf-16-le','utf-16-be','utf-8-sig'])[doc_id % 4 + 1] AS encoding FROM documents")
def decode_log(spark, sf):
    key, text = F.col("doc_id"), F.col("text")
    data = (F.when(key % 4 == 0, F.encode(text, "UTF-8"))
            .when(key % 4 == 1, F.concat(F.lit(b"\xff\xfe"), F.encode(text, "UTF-16LE")))
            .when(key % 4 == 2, F.concat(F.lit(b"\xfe\xff"), F.encode(text, "UTF-16BE")))
            .otherwise(F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(text, "UTF-8"))))
    rows = Frames(spark, sf).table("documents").select(key.alias("file_id"), logs.decode_log(data).alias("d"))
    return rows.select("file_id", F.sha2("d.text", 256).alias("decoded_sha"), "d.encoding")


@query("log_files", sql=with_ctes("log_lines") + """
    SELECT file_id, count(*) AS line_count, CASE WHEN count(*) > 1 THEN 'lf' ELSE 'none' END AS newline, NULL AS error_code
    FROM log_lines GROUP BY file_id""")
def log_files(spark, sf):
    return logs.log_files(Frames(spark, sf).log_files()).select("file_id", "line_count", "newline", "error_code")


@query("log_lines", sql=with_ctes("log_records") + "SELECT file_id, line_no, line, record_no FROM log_records")
def log_lines(spark, sf):
    return logs.log_lines(logs.log_files(Frames(spark, sf).log_files()))


@query("log_records", sql=with_ctes("log_records") + """
    SELECT file_id, record_no, min(line_no) AS first_line, max(line_no) AS last_line FROM log_records GROUP BY file_id, record_no""")
def log_records(spark, sf):
    rows = logs.log_lines(logs.log_files(Frames(spark, sf).log_files()))
    return rows.groupBy("file_id", "record_no").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


# --- scanned pages ----------------------------------------------------------------------------

define("pages_read", """
    SELECT document_id, page, round(avg(score), 4) AS mean_score, round(min(score), 4) AS min_score, count(*) AS line_count,
           sum(CASE WHEN score < 0.6 THEN 1 ELSE 0 END) AS low_lines, string_agg(text, chr(10) ORDER BY line_no) AS text
    FROM scanned_lines GROUP BY document_id, page""", "scanned_lines")
define("page_records", """
    SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS chars,
           CASE WHEN low_lines > 0 OR length(regexp_replace(text, '\\s', '', 'g')) < 10
                  OR length(regexp_replace(text, '[^\\x{FFFD}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\x{E000}-\\x{F8FF}]', '', 'g')) > 0.02 * length(text)
                  OR mean_score < 0.6 THEN 'suspect' ELSE 'ok' END AS quality_status FROM pages_read""", "pages_read")
define("ocr_pages", """
    SELECT document_id, page, text, CASE WHEN (document_id + page) % 5 = 0 THEN 'failed' ELSE quality_status END AS status
    FROM page_records""", "page_records")


@query("text_quality", sql="""
    WITH q AS (SELECT doc_id AS document_id, text, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) AS chars,
        length(regexp_replace(text, '[^\\x{FFFD}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\x{E000}-\\x{F8FF}]', '', 'g'))::DOUBLE
          / length(text) AS garble_ratio FROM documents)
    SELECT document_id, chars, garble_ratio, CASE WHEN chars = 0 THEN 'insufficient' WHEN garble_ratio > 0.02 THEN 'suspect'
           WHEN chars < 40 THEN 'insufficient' ELSE 'usable' END AS quality FROM q""")
def text_quality(spark, sf):
    return Frames(spark, sf).documents().select("document_id", tx.text_quality("text").alias("q")).select("document_id", "q.*")


@query("page_quality", sql=with_ctes("page_records") + """
    SELECT document_id, page, chars, line_count, mean_score, min_score, quality_status AS status FROM page_records""")
def page_quality(spark, sf):
    return page_sets.page_quality(Frames(spark, sf).scanned_lines()).select(
        "document_id", "page", "chars", "line_count", "mean_score", "min_score", "status")


@query("uncertain_lines", sql=with_ctes("scanned_lines") + """
    SELECT document_id, page, line_no - first + 1 AS line, text, score
    FROM (SELECT *, min(line_no) OVER (PARTITION BY document_id, page) AS first FROM scanned_lines) WHERE score < 0.6""")
def uncertain_lines(spark, sf):
    """Every low line of every page; the page records of the same tables list them all, too."""
    lines = Frames(spark, sf).scanned_lines()
    listed = page_sets.page_quality(lines).select("document_id", "page", F.explode("uncertain_lines").alias("line"))
    return page_sets.uncertain_lines(lines).join(listed, ["document_id", "page", "line"])


def _ocr_pages(spark, sf):
    pages = page_sets.page_quality(Frames(spark, sf).scanned_lines())
    return pages.select("document_id", "page", "text", F.when(
        (F.col("document_id") + F.col("page")) % 5 == 0, "failed").otherwise(F.col("status")).alias("status"))


@query("page_summary", sql=with_ctes("ocr_pages") + """
    SELECT document_id, count(*) AS pages, count(*) FILTER (WHERE status = 'ok') AS ok_pages,
           count(*) FILTER (WHERE status = 'suspect') AS suspect_pages, count(*) FILTER (WHERE status = 'failed') AS failed_pages,
           0 AS skipped_pages FROM ocr_pages GROUP BY document_id""")
def page_summary(spark, sf):
    return page_sets.page_summary(_ocr_pages(spark, sf))


@query("validate_page_set", sql=with_ctes("ocr_pages") + """,
    s AS (SELECT document_id, max(page) AS n, count(*) FILTER (WHERE NOT (document_id % 6 = 0 AND page = 2)) AS rows_left,
          count(*) FILTER (WHERE document_id % 7 = 0 AND status = 'ok' AND NOT (document_id % 6 = 0 AND page = 2)) AS blanks
          FROM ocr_pages GROUP BY document_id)
    SELECT document_id, n AS page_count, CASE WHEN n > 50 OR rows_left <> n THEN 'page_numbers_invalid'
           WHEN blanks > 0 THEN 'page_text_missing' END AS error_code FROM s""")
def validate_page_set(spark, sf):
    """Some documents lose page 2, some have blank good pages."""
    pages = _ocr_pages(spark, sf)
    expected = pages.groupBy("document_id").agg(F.max("page").alias("page_count"))
    damaged = pages.where(~((F.col("document_id") % 6 == 0) & (F.col("page") == 2))).withColumn(
        "text", F.when((F.col("document_id") % 7 == 0) & (F.col("status") == "ok"), " ").otherwise(F.col("text")))
    return page_sets.validate_page_set(damaged, expected)


@query("merge_page_retry", sql=with_ctes("ocr_pages") + """
    SELECT document_id, page, CASE WHEN status = 'failed' AND page % 3 <> 0 THEN 'ok' ELSE status END AS status,
           CASE WHEN status = 'failed' AND page % 3 <> 0 THEN 'retry ' || page ELSE text END AS text,
           CASE WHEN status = 'failed' AND page % 3 = 0 THEN 'retry_skipped' END AS error_code FROM ocr_pages""")
def merge_page_retry(spark, sf):
    """The retry covers every page; only failed ones may change."""
    old = _ocr_pages(spark, sf)
    new = old.select("document_id", "page", F.when(F.col("page") % 3 == 0, "skipped").otherwise("ok").alias("status"),
                     F.concat(F.lit("retry "), F.col("page").cast("string")).alias("text"))
    return page_sets.merge_page_retry(old, new)


@query("publish_pages", sql=with_ctes("ocr_pages") + """
    SELECT document_id, page, status, text FROM ocr_pages WHERE status = 'ok' OR (status = 'suspect' AND page % 2 = 0)""")
def publish_pages(spark, sf):
    pages = _ocr_pages(spark, sf)
    return page_sets.publish_pages(pages, pages.where(F.col("page") % 2 == 0))[0].select("document_id", "page", "status", "text")


define("page_tags", """
    SELECT document_id, status, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS numbers FROM ocr_pages GROUP BY document_id, status
    UNION ALL
    SELECT document_id, 'excluded_suspect', string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FROM ocr_pages
    WHERE status = 'suspect' AND page % 2 <> 0 GROUP BY document_id""", "ocr_pages")


@query("publish_page_tags", sql=with_ctes("page_tags") + """
    SELECT document_id, string_agg('ocr_' || status || '_pages=' || numbers, ' ' ORDER BY
           list_position(['ok','suspect','failed','excluded_suspect'], status)) AS tags FROM page_tags GROUP BY document_id""")
def publish_page_tags(spark, sf):
    pages = _ocr_pages(spark, sf)
    tags = page_sets.publish_pages(pages, pages.where(F.col("page") % 2 == 0))[1]
    return tags.select("document_id", F.array_join("tags", " ").alias("tags"))


@query("parse_page_tags", sql=with_ctes("ocr_pages") + "SELECT document_id, status, page FROM ocr_pages")
def parse_page_tags(spark, sf):
    pages = _ocr_pages(spark, sf)
    return page_sets.parse_page_tags(page_sets.publish_pages(pages, pages)[1])


@query("merge_layer_text", sql="""
    WITH d AS (SELECT doc_id AS document_id, trim(text, ' ' || chr(10)) AS t, string_split(trim(text, ' ' || chr(10)), chr(10))[1] AS head FROM documents)
    SELECT document_id, sha256(CASE WHEN document_id % 3 = 0 THEN t WHEN document_id % 3 = 1 THEN 'Page header' || chr(10) || t ELSE t END) AS merged_sha FROM d""")
def merge_layer_text(spark, sf):
    """The layer is the first line, a foreign header, or empty."""
    key = F.col("document_id")
    head = tx.lines_of(tx.strip("text"))[0]
    layer = F.when(key % 3 == 0, head).when(key % 3 == 1, F.lit("Page header")).otherwise(F.lit(" "))
    return Frames(spark, sf).documents().select("document_id", F.sha2(page_sets.merge_layer_text(layer, "text"), 256).alias("merged_sha"))
