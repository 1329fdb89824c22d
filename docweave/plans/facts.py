"""Queries over fact extraction with citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import facts, units
from docweave.operators.mentions import mentioned_names
from docweave.plans.catalog import query
from docweave.plans.ctes import with_ctes
from docweave.plans.evidence import table_chunks
from docweave.plans.frames import Frames
from docweave.sources import logs


def part_cells(f: Frames):
    return units.parse_rows(table_chunks(f).select("document_id", "chunk_id", "content"))


def texts(f: Frames, *pieces):
    """One chunk per document: its whole text, and behind it a pattern over its id that the operator has to find there."""
    return f.documents().select(F.col("document_id").alias("chunk_id"), "document_id", F.concat("text", F.lit("\n"), *pieces).alias("content"))


def number(modulus: int):
    return (F.col("document_id") % modulus).cast("string")


@query("bind_headers", sql="""
    SELECT DISTINCT p_brand AS sheet, unnest(['A','B','C','D']) AS "column", unnest(['Index','Name','Description','Value']) AS label,
           unnest(['index','name','description','value']) AS role FROM part""")
def bind_headers(spark, sf):
    return facts.bind_headers(part_cells(Frames(spark, sf))).select("sheet", "column", "label", "role")


@query("table_lookup", sql="""
    WITH q AS (SELECT p_name, min(p_partkey) AS query_id FROM part GROUP BY p_name),
    r AS (SELECT q.query_id, p.p_brand AS sheet, p.p_partkey + 2 AS "row", count(*) OVER (PARTITION BY q.query_id) > 1 AS differing,
                 unnest(['index','name','description','value']) AS role, unnest([CAST(p_partkey AS VARCHAR), p.p_name, p_type, CAST(p_size AS VARCHAR)]) AS value
          FROM part p JOIN q USING (p_name))
    SELECT query_id, 'answer' AS status, differing, sheet, "row", role, value FROM r""")
def table_lookup(spark, sf):
    """One question per part name."""
    f = Frames(spark, sf)
    asked = f.table("part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id")).select(
        "query_id", F.concat(F.lit("请问 "), F.upper("p_name"), F.lit(" 的 value 是多少")).alias("text"))
    return facts.table_lookup(asked, part_cells(f)).select("query_id", "status", "differing", "sheet", "row", "role", "value")


@query("names_in_documents", sql="""
    WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    asked AS (SELECT DISTINCT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')) AS term FROM benchmark),
    said AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z0-9_]+')) AS term FROM low)
    SELECT term, count(*) AS documents FROM said JOIN asked USING (term) WHERE length(term) >= 3 GROUP BY term""")
def names_in_documents(spark, sf):
    """Documents that state each word of the questions as a whole name."""
    f = Frames(spark, sf)
    names = f.table("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("term"))
    found = mentioned_names(f.documents(), "document_id", "text", names, shortest=3)
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


@query("table_lookup_by_index", sql="""
    SELECT p_partkey AS query_id, 'answer' AS status, unnest(['index','name','description','value']) AS role,
           unnest([CAST(p_partkey AS VARCHAR), p_name, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part WHERE p_partkey < 1000""")
def table_lookup_by_index(spark, sf):
    """``P<n>`` has at most three digits, so larger keys name no record."""
    f = Frames(spark, sf)
    asked = f.table("part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit(" 的 value")).alias("text"))
    return facts.table_lookup(asked, part_cells(f)).select("query_id", "status", "role", "value")


def byte_texts(f: Frames):
    """Two definitions per document, one folded over two lines; every ninth text is torn."""
    torn = F.when(F.col("document_id") % 9 == 0, "\nstray words").otherwise("\nNote: none")
    return texts(f, F.lit("Parameters:\nByte 1: open delay in tenths of a second (must be > 3; default\n "), number(50),
                 F.lit(")\nByte 2: hold time in ms (default "), number(90), F.lit(")"), torn)


@query("byte_blocks", sql="""
    SELECT doc_id AS chunk_id, 1 AS byte, 'open delay in tenths of a second (must be > 3; default ' || (doc_id % 50) || ')' AS definition FROM documents WHERE doc_id % 9 <> 0
    UNION ALL SELECT doc_id, 2, 'hold time in ms (default ' || (doc_id % 90) || ')' FROM documents WHERE doc_id % 9 <> 0""")
def byte_blocks(spark, sf):
    return facts.byte_blocks(byte_texts(Frames(spark, sf))).select("chunk_id", "byte", "definition")


@query("parameter_values", sql="""
    SELECT doc_id AS chunk_id, 1 AS byte, 'open delay' AS control, '3' AS limit_above, CAST(doc_id % 50 AS VARCHAR) AS default_value, 'tenths of a second' AS unit,
           CAST(((doc_id % 50) * 100) AS VARCHAR) AS default_ms FROM documents WHERE doc_id % 9 <> 0
    UNION ALL SELECT doc_id, 2, 'hold time', NULL, CAST(doc_id % 90 AS VARCHAR), 'ms', CAST(doc_id % 90 AS VARCHAR) FROM documents WHERE doc_id % 9 <> 0""")
def parameter_values(spark, sf):
    values = facts.parameter_values(facts.byte_blocks(byte_texts(Frames(spark, sf))))
    return values.select("chunk_id", "byte", "control", "limit_above", "default_value", "unit", "default_ms")


@query("parameter_lookup", sql="""
    SELECT item_id AS query_id, 1 AS byte, CASE WHEN n = 0 THEN 'none' ELSE 'several' END AS status, n AS records
    FROM benchmark, (SELECT count(*) AS n FROM documents WHERE doc_id % 9 <> 0)
    UNION ALL SELECT item_id, 7, 'none', 0 FROM benchmark""")
def parameter_lookup(spark, sf):
    f = Frames(spark, sf)
    asked = f.table("benchmark").select(F.col("item_id").alias("query_id"), F.lit("Byte 1 和 Byte 7 的默认值").alias("text"))
    found = facts.parameter_lookup(asked, facts.parameter_values(facts.byte_blocks(byte_texts(f))))
    return found.select("query_id", "byte", "status", "records").distinct()


@query("enum_fields", sql="""
    SELECT doc_id AS chunk_id, 'MODE' AS field, 'operating mode' AS definition, unnest([1, 2]) AS number,
           unnest(['run ' || (doc_id % 7), 'stop and hold']) AS value FROM documents WHERE doc_id % 5 <> 0""")
def enum_fields(spark, sf):
    """Every fifth text defines the field twice, so it is not unique there."""
    block = F.concat(F.lit("MODE\noperating\nmode Format: U 1\n 1 = run "), number(7), F.lit("\n 2 = stop\n and hold\nWhere used: S2F41\n"))
    rows = texts(Frames(spark, sf), block, F.when(F.col("document_id") % 5 == 0, block).otherwise(F.lit("end")))
    return facts.enum_fields(rows)


def label_sources(f: Frames):
    """Each document is asked about its own label; every fourth text states it twice."""
    label = F.concat(F.lit("LoadPort"), F.translate(number(10), "0123456789", "ABCDEFGHIJ"))
    statement = F.concat(label, F.lit(" 表示 装载口模式 "), number(13), F.lit("。"))
    rows = texts(f, F.lit("前文在此。"), statement, F.when(F.col("document_id") % 4 == 0, statement).otherwise(F.lit("后文在此。")))
    return rows.select(F.col("document_id").alias("query_id"), F.concat(label, F.lit(" 表示什么")).alias("question"), "chunk_id", "content")


@query("labelled_statements", sql="""
    SELECT doc_id AS query_id, 'LoadPort' || chr(CAST(65 + doc_id % 10 AS INTEGER)) AS label,
           'LoadPort' || chr(CAST(65 + doc_id % 10 AS INTEGER)) || ' 表示 装载口模式 ' || (doc_id % 13) || '。' AS statement FROM documents WHERE doc_id % 4 <> 0""")
def labelled_statements(spark, sf):
    return facts.labelled_statements(label_sources(Frames(spark, sf))).select("query_id", "label", "statement")


@query("id_pairs", sql="""
    SELECT doc_id AS query_id, '0x' || printf('%02X', 16 + doc_id % 90) AS command, '0x' || printf('%02X', 17 + doc_id % 90) AS reply FROM documents""")
def id_pairs(spark, sf):
    """Codes before and after the label; the next clause holds foreign codes."""
    code = lambda plus: F.concat(F.lit("0x"), F.lpad(F.hex(F.col("document_id") % 90 + plus), 2, "0"))
    rows = texts(Frames(spark, sf), F.lit("0x01 旧指令；0x02 "), code(16), F.lit(" OpenDoor 无 "), code(17), F.lit(" 0x03；0x04 CloseDoor 0x05"))
    return facts.id_pairs(rows.select(F.col("document_id").alias("query_id"), "chunk_id", "content", F.lit("OpenDoor").alias("label"))).select(
        "query_id", "command", "reply")


@query("timer_definitions", sql="""
    SELECT 'T' || k AS label, '回复超时' || k AS definition, count(*) AS chunks FROM (SELECT doc_id % 40 AS k FROM documents) GROUP BY k HAVING k % 2 = 0""")
def timer_definitions(spark, sf):
    """Odd timers are defined differently by different documents."""
    k = F.col("document_id") % 40
    differing = F.when(k % 2 == 0, k).otherwise(F.col("document_id"))
    rows = texts(Frames(spark, sf), F.lit("其中 T"), k.cast("string"), F.lit(" 用于 回复超时"), differing.cast("string"), F.lit(" 的设定。"))
    # An odd timer with a single document would be defined once; the pair below makes it differ everywhere.
    again = texts(Frames(spark, sf), F.lit("T"), k.cast("string"), F.lit(" 用于 "), F.when(k % 2 == 0, F.concat(F.lit("回复超时"), k.cast("string"))).otherwise("其它计时"), F.lit(" 的设定"))
    return facts.timer_definitions(rows.unionByName(again))


def test_cells(f: Frames):
    """A test sheet per brand: items named by the part, commands by its type; some rows hold two commands."""
    rows = f.parts().select(
        F.col("p_brand").alias("sheet"), (F.col("p_partkey") + 2).alias("row"), F.array(
            F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")), F.concat(F.lit("发送指令："), "p_type"), F.lit("READY"),
            F.when(F.col("p_partkey") % 6 == 0, "发送指令：OTHER").otherwise("无")).alias("values"))
    header = f.table("part").select(F.col("p_brand").alias("sheet")).distinct().select("sheet", F.lit(1).cast("long").alias("row"), F.array(
        *[F.lit(v) for v in ("测试项", "测试步骤", "前置条件", "验证")]).alias("values"))
    rendered = units.row_units(header.unionByName(rows).withColumn("document_id", F.lit(5).cast("long")))
    return units.parse_rows(rendered.select("document_id", F.col("paragraph").alias("chunk_id"), F.col("text").alias("content")))


@query("test_rows", sql="""
    SELECT p_brand AS sheet, p_partkey + 2 AS "row", p_name || ' ' || p_partkey AS item, 'READY' AS precondition,
           CASE WHEN p_partkey % 6 <> 0 THEN p_type END AS command FROM part""")
def test_rows(spark, sf):
    return facts.test_rows(test_cells(Frames(spark, sf))).select("sheet", "row", "item", "precondition", "command")


@query("test_commands")
def test_commands(spark, sf):
    f = Frames(spark, sf)
    asked = f.table("part").select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" 发送什么指令？")).alias("text"))
    return facts.test_commands(asked, facts.test_rows(test_cells(f))).select("query_id", "command", "sheet", "row", "status")


@query("numbered_sections", sql="""
    SELECT doc_id AS chunk_id, 'loading' AS subject, 2 AS steps FROM documents WHERE doc_id % 3 <> 0""")
def numbered_sections(spark, sf):
    """Every third text skips a step number."""
    second = F.when(F.col("document_id") % 3 == 0, "3、关闭。\n").otherwise("2、关闭。\n")
    rows = texts(Frames(spark, sf), F.lit("一、Loading 参数设置\n1、打开设备并进入菜单。\n（1）按键。\n（2）确认。\n"), second, F.lit("二、Other\n正文。"))
    return facts.numbered_sections(rows).select("chunk_id", "subject", "steps")


@query("log_alarms", sql=with_ctes("log_lines") + """
    SELECT file_id, 'timer T' || regexp_extract(line, 'WARNING timer T(\\d)', 1) || ' Timeout.' AS message, count(*) AS lines
    FROM log_lines WHERE regexp_matches(line, 'WARNING timer T\\d Timeout\\.') GROUP BY 1, 2""")
def log_alarms(spark, sf):
    return facts.log_alarms(logs.log_lines(logs.log_files(Frames(spark, sf).log_files())))


@query("row_record", sql="""
    SELECT min(p_partkey) OVER (PARTITION BY p_name) AS query_id, CAST(p_partkey AS VARCHAR) AS "index", p_type AS value, CAST(p_size AS VARCHAR) AS purpose,
           CASE WHEN count(*) OVER (PARTITION BY p_name) = 1 THEN 'answer' ELSE 'unresolved' END AS status FROM part""")
def row_record(spark, sf):
    """One question per part name; shared names stay unresolved."""
    f = Frames(spark, sf)
    asked = f.table("part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id")).select("query_id", F.col("p_name").alias("name"))
    return facts.row_record(asked, part_cells(f)).select("query_id", "index", "value", "purpose", "status")


@query("version_records", sql="SELECT s_suppkey + 1 AS \"row\", s_name AS label, 'Firmware: 1.' || (s_suppkey % 9) || '.' || (s_suppkey % 4) AS version FROM supplier")
def version_records(spark, sf):
    key = F.col("s_suppkey")
    rows = Frames(spark, sf).table("supplier").select(
        F.lit(3).cast("long").alias("document_id"), F.lit("测试环境").alias("sheet"), (key + 1).alias("row"),
        F.array(F.concat(key.cast("string"), F.lit("、"), "s_name"), F.concat(F.lit("Firmware: 1."), (key % 9).cast("string"), F.lit("."), (key % 4).cast("string"))).alias("values"))
    rendered = units.row_units(rows)
    cells = units.parse_rows(rendered.select("document_id", F.col("paragraph").alias("chunk_id"), F.col("text").alias("content")))
    return facts.version_records(cells).select("row", "label", "version")


@query("merge_citations", sql=with_ctes("citations") + """,
    r AS (SELECT turn_id AS query_id, 'text ' || (document_id % 2) AS text, position + 1 AS citation FROM citations)
    SELECT query_id, text, string_agg(DISTINCT CAST(citation AS VARCHAR), ',' ORDER BY CAST(citation AS VARCHAR)) AS citations,
           CASE WHEN (SELECT count(DISTINCT text) FROM r o WHERE o.query_id = r.query_id) = 1 THEN 'answer' ELSE 'unresolved' END AS status
    FROM r GROUP BY query_id, text""")
def merge_citations(spark, sf):
    rows = Frames(spark, sf).citations().select(
        F.col("turn_id").alias("query_id"), F.concat(F.lit("text "), (F.col("document_id") % 2).cast("string")).alias("text"), (F.col("position") + 1).alias("citation"))
    merged = facts.merge_citations(rows)
    return merged.select("query_id", "text", F.array_join(F.transform("citations", lambda c: c.cast("string")), ",").alias("citations"), "status")


@query("local_evidence", sql="""
    SELECT doc_id AS chunk_id, CASE WHEN doc_id % 6 = 0 OR regexp_matches(text, '(?i)(^|[^a-z0-9_])(on|off)([^a-z0-9_]|$)') THEN NULL
           ELSE 'Cmd_A.' || (doc_id % 9) || ' opens' END AS evidence FROM documents""")
def local_evidence(spark, sf):
    """Every sixth text names the identifier on two lines; texts about on or off are refused."""
    name = F.concat(F.lit("Cmd_A."), number(9))
    rows = texts(Frames(spark, sf), F.lit("first\n"), name, F.lit(" opens\nCmd_A.77 foreign"), F.when(F.col("document_id") % 6 == 0, F.concat(F.lit("\n"), name, F.lit(" again"))).otherwise(F.lit("\nlast")))
    return rows.select("chunk_id", facts.local_evidence(F.concat(F.lit("what does "), name, F.lit(" do")), "content").alias("evidence"))


@query("prompt_context")
def prompt_context(spark, sf):
    """Context text of the sources that each turn cites."""
    f = Frames(spark, sf)
    first = f.chunks().where("seq = 0").select("document_id", "filename", "page", "paragraph", "content")
    rows = f.citations().join(first, "document_id").join(f.turns().select("turn_id", "question"), "turn_id").select(
        F.col("turn_id").alias("query_id"), "question", (F.col("position") + 1).cast("long").alias("slot"), "document_id", "filename", "page", "paragraph", "content")
    return facts.prompt_context(rows)


@query("annotate_cells", sql="""
    SELECT p_partkey AS chunk_id, '工作表《' || p_brand || '》第 ' || (p_partkey + 2) || ' 行：A' || (p_partkey + 2) || '(Index)=' || p_partkey || '；B' || (p_partkey + 2) || '(Name)=' || p_name
           || '；C' || (p_partkey + 2) || '=' || p_type AS content FROM part""")
def annotate_cells(spark, sf):
    key = F.col("p_partkey")
    text = F.concat(F.lit("工作表《"), "p_brand", F.lit("》第 "), (key + 2).cast("string"), F.lit(" 行：A"), (key + 2).cast("string"), F.lit("="), key.cast("string"), F.lit("；B"),
                    (key + 2).cast("string"), F.lit("="), "p_name", F.lit("；C"), (key + 2).cast("string"), F.lit("="), "p_type")
    labels = F.create_map(F.lit("A"), F.lit("Index"), F.lit("B"), F.lit("Name"))
    return Frames(spark, sf).table("part").select(key.alias("chunk_id"), facts.annotate_cells(text, labels).alias("content"))


@query("check_citations", sql=with_ctes("turns") + """
    SELECT turn_id AS answer_id, CASE turn_id % 6 WHEN 0 THEN 'ok' WHEN 2 THEN 'bad_citation' WHEN 4 THEN 'ok' ELSE 'bad_citation' END AS status FROM turns""")
def check_citations(spark, sf):
    """Valid lists, foreign numbers, code spans and malformed lists appended to the answers."""
    k = F.col("turn_id") % 6
    tail = F.when(k == 0, " see [1] and [2，3]").when(k == 2, " see [4]").when(k == 4, " code `x[9]` and A[12]").otherwise(" see [1.2]")
    rows = Frames(spark, sf).turns().select(F.col("turn_id").alias("answer_id"), F.concat("answer", tail).alias("answer"), F.lit(3).alias("n_sources"))
    return facts.check_citations(rows).select("answer_id", "status")


@query("normalize_refusal", sql=with_ctes("turns") + """
    SELECT turn_id AS answer_id, CASE WHEN turn_id % 4 = 0 THEN '根据知识库现有内容无法回答该问题。' WHEN answer = '' AND turn_id % 4 = 2 THEN '根据知识库现有内容无法回答该问题。'
           ELSE trim(answer, ' ' || chr(10)) END AS answer FROM turns""")
def normalize_refusal(spark, sf):
    k = F.col("turn_id") % 4
    text = F.when(k == 0, F.concat(F.lit(facts.REFUSAL), F.lit(" [1]。"))).when(k == 2, F.concat("answer", F.lit(facts.REFUSAL))).otherwise(F.col("answer"))
    return Frames(spark, sf).turns().select(F.col("turn_id").alias("answer_id"), facts.normalize_refusal(text).alias("answer"))
