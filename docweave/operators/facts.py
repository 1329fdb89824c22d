"""Facts with citations from tables, definitions, logs and answers.

Conflicts are reported, never resolved by rank: outputs carry a status or drop the ambiguous key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweave.functions import text as tx
from docweave.functions.matching import contained_terms
from docweave.operators.mentions import mentioned_names
from docweave.runtime import BROADCAST_LIMIT_BYTES, computed, estimated_bytes, materialize, measured_side, salted_join

# Column labels per role, time units and patterns of the definitions.
COLUMN_LABELS = {
    "index": ("index", "索引"), "name": ("name", "名称"), "value": ("value",),
    "default": ("default", "default value", "defaultvalue", "默认", "默认值", "默認", "默認值"),
    "unit": ("unit", "单位"), "description": ("description", "描述", "说明"), "mark": ("mark", "备注"),
    "current": ("current value", "currentvalue", "actual value", "actualvalue", "当前值", "实际值", "实测值", "读取值", "现场当前值")}
REPEATABLE_ROLES = ("current", "default")
MAX_HEADER_ROW = 5
PARAMETER_NUMBER = r"(?i)(?<![A-Za-z0-9_.-])P\s*(\d{1,3})(?![A-Za-z0-9_.-])"
NUMBER = r"[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?)"
NEGATION = r"(?i)\b(?:not|no|never|without|neither|cannot)\b|n['’]t\b|不|非|未|无"
BYTE_MARK = r"(?i)(?<![A-Za-z0-9_])Byte\s*(\d+)\s*[:：]\s*"
SECTION_LINE = r"(?i)^(?:response|reply|result|notes?)\b|^[\w /-]+[:：]"
PARAMETERS_LINE = r"(?i)^Parameters?\s*[:：]$"
TIME_UNITS = r"tenths? of a second|tenths? of seconds|milliseconds?|seconds?|ms"
CLAUSE = r"((?:[^;；。!?！？.]|\.(?!\s|$))*?)"
LIMIT = rf"(?is){CLAUSE}\bmust\s+be\s*>\s*(\S+)(?=(.*)$)"
DEFAULT = rf"(?is){CLAUSE}\bdefault(?:\s+value)?\s*(?:of\s*)?(\S+)(?=(.*)$)"
REVERTS = r"(?i)\bif\s+(?:not|no)\s*,\s*(?:it\s+)?reverts\s+to\s*$"
UNIT = rf"(?i)\bin\s+({TIME_UNITS})\b"
TIMED_DEFAULT = (rf"(?i)^([^()\n;；:：.]+?)\s+in\s+({TIME_UNITS})\s*\(\s*(?:must\s+be\s*>\s*{NUMBER}\s*"
                 rf"(?:;|:\s*if\s+(?:not|no),\s*(?:it\s+)?reverts\s+to)\s*)?default(?:\s+value)?\s*(?:of\s*)?({NUMBER})\s*\)\.?$")
FIELD_BLOCK = (r"(?m)^[ \t]*([A-Za-z][A-Za-z0-9_]{2,31})[ \t]*\r?\n((?:(?!^[ \t]*[A-Z][A-Z0-9_]{2,}[ \t]*$)[\s\S]){0,160}?)"
               r"\bFormat\s*:\s*[A-Za-z]\s*\d+\s*((?:(?!\bFormat\s*:)[\s\S])*?)\bWhere\s+used\s*:")
ENUM_ENTRY = r"(?m)^[ \t]*(\d+)[ \t]*[-=][ \t]*((?s:.*?))(?=^[ \t]*\d+[ \t]*[-=]|\z)"
HEX_BYTE = r"(?i)\b0x[0-9a-f]{2}\b"
TIMER = r"(?i)(?<![A-Za-z0-9])([A-Za-z]\d+)(?![A-Za-z0-9])\s*用于\s*([^。；;，,\r\n]{2,60}?)\s*的?设定"
TIMER_TEXT = rf"^[{tx.CJK}A-Za-z0-9 _/-]{{2,60}}$"
NUMBERED_SECTION = (r"(?m)^[一二三四五六七八九十]+[、．.][ \t]*([A-Za-z]+)[ \t]*参数(?:设置|配置|调整)[ \t]*\r?\n"
                    r"((?s:.*?))(?=^[一二三四五六七八九十]+[、．.]|\z)")
COMMAND = r"(?s)^发送指令\s*[：:]?\s*(.+)$"
TEST_ROLES = {"item": ("测试项", "test item", "testitem"), "input": ("input", "测试步骤-输入"), "precondition": ("前置条件", "precondition"),
              "step": ("测试步骤",), "verification": ("验证", "期望回复")}
STRUCTURED_ID = r"[A-Za-z][A-Za-z0-9]*(?:[_.-][A-Za-z0-9]+)+"
SHORT_ID = r"(?<![A-Za-z0-9_.-])[A-Za-z]+[0-9]+(?![A-Za-z0-9_.-])"
ON_OFF = r"(?i)(?<![A-Za-z0-9_])(?:ON|OFF)(?![A-Za-z0-9_])"
CITATION_LENGTH = r"(?<![A-Za-z0-9])(?:A|B|L|[UI][1248]|F[48])\[\d+\]"
CITATION = r"\[(\d+(?:\s*[,，、.]\s*\d+)*)\]"
# Fixed value: the refusal sentence of an answer.
REFUSAL = "根据知识库现有内容无法回答该问题。"
MAX_ANNOTATION = 400


def label_of(value) -> Column:
    return F.lower(tx.squeeze(value))


def roles_of(value) -> Column:
    """Roles that a header label stands for."""
    label = label_of(value)
    return F.filter(F.array(*[F.when(label.isin(*labels), F.lit(role)) for role, labels in COLUMN_LABELS.items()]), lambda r: r.isNotNull())


def quoted(value) -> Column:
    return F.concat(F.lit(r"\Q"), tx.as_column(value), F.lit(r"\E"))


def bind_headers(cells: DataFrame) -> DataFrame:
    """(document_id, sheet, header_chunk, column, label, role): one confirmed header per sheet.

    A header is among the first five rows, has a name column and at least two roles. A sheet with a
    repeated role or with differing headers is ambiguous and dropped.
    """
    early = cells.where(F.col("row") <= MAX_HEADER_ROW).withColumn("role", F.get(roles_of("value"), F.lit(0)))
    keys = ["document_id", "sheet", "row", "chunk_id"]
    shape = F.to_json(F.array_sort(F.collect_list(F.struct("column", "value"))))
    per_role = F.collect_list("role")
    single = F.filter(per_role, lambda r: ~r.isin(*REPEATABLE_ROLES))
    rows = early.groupBy(*keys).agg(
        F.count_if(F.col("role") == "name").alias("_names"), F.countDistinct("role").alias("_roles"),
        (F.size(single) != F.size(F.array_distinct(single))).alias("_repeated"), shape.alias("_shape"))
    candidates = rows.where((F.col("_names") > 0) & (F.col("_roles") >= 2))
    good = candidates.groupBy("document_id", "sheet").agg(
        F.countDistinct("_shape").alias("_shapes"), F.max("_repeated").alias("_repeated"), F.min(F.struct("row", "chunk_id")).alias("_h")).where(
        (F.col("_shapes") == 1) & ~F.col("_repeated")).select("document_id", "sheet", "_h.row", "_h.chunk_id")
    return early.join(good, keys, "left_semi").select(
        "document_id", "sheet", F.col("row").alias("header_row"), F.col("chunk_id").alias("header_chunk"), "column", F.col("value").alias("label"), "role")


def table_records(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells of data rows with their role; the header row itself is left out."""
    bound = cells.join(headers, ["document_id", "sheet", "column"])
    return bound.where(F.col("row") != F.col("header_row")).select(
        "document_id", "sheet", "row", "chunk_id", "header_chunk", "column", "label", "role", "value")


def table_lookup(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """Role values of the records a question names, each with its citations.

    A record matches by its whole name (at least three characters), else by ``P<n>`` as its index.
    status: answer, or clarification when several names match or the index disagrees; ``differing``
    marks records that do not agree, all of which are listed.
    """
    cells = materialize(cells)
    records = materialize(table_records(cells, bind_headers(cells)))
    row_key = ["document_id", "sheet", "row", "chunk_id"]
    names = records.where("role = 'name'").select(*row_key, tx.ascii_lower(F.trim("value")).alias("term"), F.trim("value").alias("_name")).where(F.length("term") >= 3)
    number = F.array_distinct(tx.extract_all("text", PARAMETER_NUMBER, 1))
    asked = questions.select("query_id", "text", number.alias("_numbers"))
    mentioned = mentioned_names(asked, "query_id", "text", names.select("term"), shortest=3).join(asked, "query_id")
    by_name = salted_join(mentioned, names, ["term"], "inner", "query_id")
    index = records.where("role = 'index'").select(*row_key, F.trim("value").alias("_index"))
    by_name = by_name.join(index, row_key, "left")
    verdict = by_name.groupBy("query_id").agg(
        F.countDistinct("term").alias("_names"), F.max(F.size("_numbers")).alias("_n"),
        F.max((F.size("_numbers") > 0) & ~F.array_contains("_numbers", F.coalesce("_index", F.lit("")))).alias("_disagrees"))
    status = F.when((F.col("_names") > 1) | F.col("_disagrees") | (F.col("_n") > 1), "clarification").otherwise("answer")
    named = by_name.select("query_id", *row_key).join(verdict.select("query_id", status.alias("status")), "query_id")
    single = asked.where(F.size("_numbers") == 1).join(verdict.select("query_id"), "query_id", "left_anti").select("query_id", F.col("_numbers")[0].alias("_index"))
    numbered = index.join(single, "_index").select("query_id", *row_key, F.lit("answer").alias("status"))
    matched = named.unionByName(numbered)
    shapes = records.groupBy(*row_key).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("column", "value")))), 256).alias("_shape"))
    differing = matched.join(shapes, row_key).groupBy("query_id").agg((F.countDistinct("_shape") > 1).alias("differing"))
    return (matched.join(records.where(F.col("role").isNotNull()), row_key).join(differing, "query_id")
            .select("query_id", "status", "differing", "document_id", "sheet", "row", "role", "column", "label", "value",
                    F.col("chunk_id").alias("row_citation"), F.col("header_chunk").alias("header_citation")))


# --- byte definitions ---------------------------------------------------------------------------


def _unbalanced(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\(")) > F.regexp_count(text, F.lit(r"\)"))


def byte_blocks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, position, byte, definition) of ``Byte n:`` blocks.

    Lines fold inside the chunk row: an open bracket continues a block, blank and section lines close
    it, and a line that fits neither voids the chunk.
    """
    block = "struct<byte:int,text:string>"
    state_type = f"struct<blocks:array<{block}>,open:boolean,void:boolean>"
    lines = F.transform(F.split(F.regexp_replace("content", r"\x00", ""), r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"), tx.strip)

    def state(blocks, is_open, void):
        return F.struct(blocks.cast(f"array<{block}>").alias("blocks"), is_open.alias("open"), void.alias("void")).cast(state_type)

    def joined(acc, text):
        last = F.element_at(acc["blocks"], -1)
        merged = F.struct(last["byte"].alias("byte"), F.concat_ws(" ", last["text"], text).alias("text"))
        return F.concat(F.slice(acc["blocks"], F.lit(1), F.size(acc["blocks"]) - 1), F.array(merged))

    def trimmed(text):
        return F.regexp_replace(text, r"^[ ;；]+|[ ;；]+$", "")

    def step(acc, line):
        numbers = F.regexp_extract_all(line, F.lit(BYTE_MARK), F.lit(1))
        parts = F.split(line, BYTE_MARK)
        prefix = trimmed(F.get(parts, F.lit(0)))
        fresh = F.zip_with(numbers, F.slice(parts, F.lit(2), F.size(numbers)), lambda n, t: F.struct(n.cast("int").alias("byte"), trimmed(t).alias("text")))
        yes, no = F.lit(True), F.lit(False)
        waiting = acc["open"] & _unbalanced(F.element_at(acc["blocks"], -1)["text"])
        plain = (prefix == "") | prefix.rlike(PARAMETERS_LINE)
        with_mark = (F.when(plain, state(F.concat(acc["blocks"], fresh), yes, acc["void"]))
                     .when(~acc["open"] | prefix.rlike(SECTION_LINE), state(acc["blocks"], no, acc["void"]))
                     .when(waiting, state(F.concat(joined(acc, prefix), fresh), yes, acc["void"]))
                     .otherwise(state(acc["blocks"], acc["open"], yes)))
        without = (F.when((line == "") | line.rlike(SECTION_LINE), state(acc["blocks"], no, acc["void"]))
                   .when(~acc["open"], acc).when(waiting | line.startswith("("), state(joined(acc, line), yes, acc["void"]))
                   .otherwise(state(acc["blocks"], acc["open"], yes)))
        return F.when(acc["void"], acc).when(F.size(numbers) > 0, with_mark).otherwise(without)

    start = state(F.array(), F.lit(False), F.lit(False))
    hinted = chunks.where(F.col("content").rlike(BYTE_MARK))
    folded = computed(hinted.select("chunk_id", "content"), "_s", F.aggregate(lines, start, step)).where(~F.col("_s.void"))
    return folded.select("chunk_id", F.posexplode("_s.blocks").alias("position", "_b")).select(
        "chunk_id", "position", F.col("_b.byte").alias("byte"), F.col("_b.text").alias("definition"))


def _single_number(rows: DataFrame, name: str, text: Column, pattern: str, drop_revert: bool = False) -> DataFrame:
    """Adds the one value all matches agree on; NULL when negated, open-ended or different. Matches and their values are found once a row."""
    matches = F.arrays_zip(tx.extract_all(text, pattern, 1).alias("clause"), tx.extract_all(text, pattern, 2).alias("token"),
                           tx.extract_all(text, pattern, 3).alias("rest"))

    def value(m):
        clause = F.regexp_replace(m["clause"], REVERTS, "") if drop_revert else m["clause"]
        ended = (tx.strip(m["rest"]) == "") | m["token"].rlike(r"[);；。.:：]$")
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(m["token"], "[);；，:：。]+$", ""), r"\.$", ""), "[);；，:：。]+$", "")
        return F.when(~clause.rlike(NEGATION) & ended & bare.rlike(f"^{NUMBER}$"), bare)

    found = computed(computed(rows, "_matches", matches), "_values", F.transform("_matches", value))
    values = F.col("_values")
    agreed = (F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull()) & (F.size(F.array_distinct(values)) == 1)
    return computed(found, name, F.when(agreed, values[0])).drop("_matches", "_values")


def parameter_values(blocks: DataFrame) -> DataFrame:
    """Limit, default, unit and the exact default in seconds and milliseconds per definition."""
    text = F.col("definition")
    units = tx.extract_all(text, UNIT, 1)
    before = F.regexp_extract(text, rf"(?is)^(.*?)\bin\s+(?:{TIME_UNITS})\b", 1)
    unit = F.when((F.size(units) == 1) & ~before.rlike(r"(?i)\b(?:not|no|never|without)\b|不|非"), units[0])
    name, timed = F.regexp_extract(text, TIMED_DEFAULT, 1), F.lower(F.regexp_extract(text, TIMED_DEFAULT, 2))
    known = F.col("_literal")
    number = F.when(known.rlike("(?i)0x"), F.conv(F.regexp_replace(known, "(?i)^[+]?0x", ""), 16, 10)).otherwise(known)
    exact = F.expr("try_cast(_number AS decimal(38,18))")
    factor = F.when(timed.startswith("tenth"), 0.1).when(timed.isin("ms") | timed.startswith("millisecond"), 0.001).otherwise(1.0).cast("decimal(6,4)")
    convertible = (F.size(units) == 1) & text.rlike(TIMED_DEFAULT) & ~name.rlike(NEGATION) & (F.length(known) <= 32) & ~known.startswith("-")
    control = F.regexp_replace(F.regexp_replace(text, rf"(?is)\s+in\s+(?:{TIME_UNITS})\b.*$", ""), r"(?is)\s*\(must\s+be.*$", "")
    numbered = _single_number(_single_number(blocks, "_literal", text, DEFAULT, True), "_limit", text, LIMIT)
    rows = numbered.withColumns({"control": F.regexp_replace(control, r"^[ .;；]+|[ .;；]+$", ""), "limit_above": F.col("_limit"),
                               "default_value": F.col("_literal"), "unit": unit, "_number": F.when(convertible, number), "_factor": factor})
    seconds = (exact * F.col("_factor")).cast("decimal(38,12)")
    plain = lambda value: F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return rows.withColumn("default_seconds", plain(seconds)).withColumn("default_ms", plain((seconds * 1000).cast("decimal(38,9)"))).drop("_number", "_factor", "_literal", "_limit")


def parameter_lookup(questions: DataFrame, values: DataFrame) -> DataFrame:
    """Definitions of the bytes a question asks for; several records are all listed."""
    asked = questions.select("query_id", F.explode(F.array_distinct(tx.extract_all(
        "text", r"(?i)(?<![A-Za-z0-9_])Byte\s*(\d+)(?![A-Za-z0-9_.])", 1))).alias("_b")).select("query_id", F.col("_b").cast("int").alias("byte"))
    # The patterns behind the definitions are the costly part, so they are read once. Records are counted per byte, and per question only the bytes it names; a question and a definition meet where the definition is.
    values = materialize(values)
    sizes = values.groupBy("byte").agg(F.count("definition").alias("_definitions"), F.count(F.lit(1)).alias("_rows"))
    times = asked.where("query_id IS NOT NULL AND byte IS NOT NULL").groupBy("query_id", "byte").agg(F.count(F.lit(1)).alias("_times"))
    # A handful of bytes holds all definitions and all questions, so the join of counts is salted by question.
    counted = materialize(salted_join(times, sizes, ["byte"], "left", "query_id"))
    records = F.col("_times") * F.coalesce("_definitions", F.lit(0))
    status = F.when(F.col("records") == 0, "none").when(F.col("records") > 1, "several").otherwise("answer")
    counted = counted.withColumn("records", records).withColumn("status", status).withColumn("query_id", F.explode(F.array_repeat("query_id", F.col("_times").cast("int"))))
    told = ["byte", "query_id", *(c for c in values.columns if c != "byte"), "records", "status"]
    known = materialize(counted.where("_rows IS NOT NULL").select("byte", "query_id", "records", "status"))
    if estimated_bytes(known) <= BROADCAST_LIMIT_BYTES:
        found = values.join(F.broadcast(known), "byte")
    else:
        found = salted_join(values, known, ["byte"], "inner", "definition", salts=64)
    unknown = counted.where("_rows IS NULL").select("byte", "query_id", *(F.lit(None).cast(values.schema[c].dataType).alias(c) for c in values.columns if c != "byte"), "records", "status")
    return found.select(*told).unionByName(unknown).select("query_id", "byte", *told[2:])


# --- definitions in running text ----------------------------------------------------------------


def enum_fields(chunks: DataFrame) -> DataFrame:
    """(chunk_id, field, definition, number, value) of closed field blocks that are unique in their chunk."""
    rows = chunks.where(F.col("content").rlike(r"\bFormat\s*:")).select("chunk_id", F.explode(F.arrays_zip(
        tx.extract_all("content", FIELD_BLOCK, 1).alias("field"), tx.extract_all("content", FIELD_BLOCK, 2).alias("definition"),
        tx.extract_all("content", FIELD_BLOCK, 3).alias("body"))).alias("_b")).select("chunk_id", "_b.*")
    unique = F.count(F.lit(1)).over(Window.partitionBy("chunk_id", F.lower("field"))) == 1
    rows = rows.withColumn("_unique", unique).where("_unique")
    numbers, values = tx.extract_all("body", ENUM_ENTRY, 1), tx.extract_all("body", ENUM_ENTRY, 2)
    sound = (F.size(numbers) > 0) & (F.size(F.array_distinct(numbers)) == F.size(numbers)) & F.forall(values, lambda v: tx.strip(v) != "")
    return rows.where(sound).select("chunk_id", "field", tx.squeeze("definition").alias("definition"), F.explode(
        F.arrays_zip(numbers.alias("number"), values.alias("value"))).alias("_e")).select(
        "chunk_id", "field", "definition", F.col("_e.number").cast("int").alias("number"), tx.squeeze("_e.value").alias("value"))


def flatten_text(value) -> Column:
    """White space folded and hexadecimal bytes rejoined."""
    return F.regexp_replace(tx.squeeze(value), r"(?i)\b0\s*x\s*([0-9a-f]{1,2})\b", "0x$1")


def question_label(question) -> Column:
    """The single mixed-case label of a question, else NULL."""
    words = F.array_distinct(F.filter(tx.extract_all(question, "[A-Za-z][A-Za-z0-9]*"), lambda w: (
        F.length(w).between(4, 32) & (w != F.upper(w)) & (w != F.lower(w)))))
    return F.when(F.size(words) == 1, words[0])


def compact(value) -> Column:
    return F.regexp_replace(F.lower(tx.as_column(value)), rf"[^0-9a-z{tx.CJK}]+", "")


def bigram_score(question, text) -> Column:
    """Distinct character pairs of the question that the text holds. Both are made compact once, not for every pair."""
    def score(query, body):
        pairs = F.when(F.length(query) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(query) - 1), lambda i: F.substring(query, i, F.lit(2)))))
        return F.coalesce(F.size(F.filter(pairs, lambda p: body.contains(p))), F.lit(0))

    both = F.array(F.struct(compact(question).alias("query"), compact(text).alias("body")))
    return F.transform(both, lambda x: score(x["query"], x["body"]))[0]


def _edge(label: Column) -> Column:
    return F.concat(F.lit(r"(?<![A-Za-z0-9_.-])"), quoted(label), F.lit(r"(?![A-Za-z0-9_.-])"))


def labelled_statements(sources: DataFrame) -> DataFrame:
    """The single sentence about the label of each question; none when several qualify.

    Sources: query_id, question, chunk_id, content.
    """
    rows = sources.withColumn("label", question_label("question")).where(F.col("label").isNotNull())
    sentence = F.explode(F.split(flatten_text("content"), "(?<=[。；])"))
    rows = rows.select("query_id", "question", "label", "chunk_id", sentence.alias("_s"))
    rows = rows.withColumn("statement", tx.strip(F.regexp_replace(tx.strip("_s"), r"^[\x{f06c}•●]+", ""))).where(
        F.length("statement").between(10, 500) & F.regexp_like("statement", _edge(F.col("label"))))
    scored = rows.withColumn("score", bigram_score("question", "statement"))
    counted = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("label", "chunk_id", "statement", "score")).alias("_r"))
    return counted.where((F.col("_n") == 1) & (F.col("_r.score") >= 1)).select("query_id", "_r.*")


def id_pairs(sources: DataFrame, label: str = "label") -> DataFrame:
    """(query_id, chunk_id, command, reply): last code before and first code after the label in its clause."""
    flat = sources.withColumn("_t", flatten_text("content"))
    # Cut at the label: what stands next to a cut, up to the clause's end, holds the codes of its occurrence.
    parts = F.split("_t", F.concat(F.lit("(?i)"), _edge(F.col(label))))

    def around(place):
        after = F.array_join(F.slice(parts, place + 2, F.size(parts)), " ")
        return F.struct(F.regexp_extract(F.right(F.get(parts, place), F.lit(80)), "([^；;。]*)$", 1).alias("before"),
                        F.regexp_extract(F.left(after, F.lit(80)), "^([^；;。]*)", 1).alias("after"))

    pairs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 2), around))
    rows = flat.select("query_id", "chunk_id", F.explode(pairs).alias("_p"))
    command, reply = F.element_at(tx.extract_all("_p.before", HEX_BYTE), -1), F.get(tx.extract_all("_p.after", HEX_BYTE), F.lit(0))
    found = F.size(tx.extract_all("_p.before", HEX_BYTE)) > 0
    return rows.where(found).select("query_id", "chunk_id", command.alias("command"), reply.alias("reply")).where(F.col("reply").isNotNull())


def timer_definitions(chunks: DataFrame) -> DataFrame:
    """(label, definition, chunk count) of timers whose definitions agree everywhere."""
    flat = tx.squeeze("content")
    rows = chunks.where(F.col("content").contains("用于")).select("chunk_id", F.explode(F.arrays_zip(
        tx.extract_all(flat, TIMER, 1).alias("label"), tx.extract_all(flat, TIMER, 2).alias("definition"))).alias("_d")).select(
        "chunk_id", F.upper("_d.label").alias("label"), tx.squeeze("_d.definition").alias("definition")).distinct()
    agreed = rows.groupBy("label").agg(F.countDistinct("definition").alias("_n"), F.min("definition").alias("definition"), F.countDistinct("chunk_id").alias("chunks"))
    return agreed.where((F.col("_n") == 1) & F.col("definition").rlike(TIMER_TEXT)).select("label", "definition", "chunks")


# --- test tables --------------------------------------------------------------------------------


def test_rows(cells: DataFrame) -> DataFrame:
    """One record per test row: item, input, precondition, step, verification and its single command."""
    # The cells are parsed once, for the header and for the rows.
    cells = materialize(cells)
    label = F.lower(tx.strip("value"))
    role = F.coalesce(*[F.when(label.isin(*labels), F.lit(name)) for name, labels in TEST_ROLES.items()])
    header = cells.where(F.col("row") == 1).select("document_id", "sheet", "column", role.alias("_role")).where(F.col("_role").isNotNull()).distinct()
    rows = cells.where(F.col("row") > 1).join(header, ["document_id", "sheet", "column"], "left")
    command = F.regexp_extract(tx.strip("value"), COMMAND, 1)
    rows = rows.withColumn("_command", F.when(tx.strip("value").rlike(COMMAND), tx.squeeze(command)))
    pick = [F.max(F.when(F.col("_role") == name, F.col("value"))).alias(name) for name in TEST_ROLES]
    counts = [F.count_if(F.col("_role") == name).alias(f"_n_{name}") for name in ("item", "input")]
    commands = F.collect_set(F.when(F.length("_command").between(2, 160), F.col("_command")))
    records = rows.groupBy("document_id", "sheet", "row", "chunk_id").agg(*pick, *counts, commands.alias("_commands"))
    single = F.when(F.size("_commands") == 1, F.col("_commands")[0])
    return records.where(F.col("_n_item") == 1).select("document_id", "sheet", "row", "chunk_id", *TEST_ROLES, single.alias("command"))


def test_commands(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Command of the test item a question names: equal commands corroborate, different ones stay open."""
    squeezed = lambda value: F.lower(F.regexp_replace(tx.as_column(value), r"(?U)[\W_]", ""))
    # The items give the terms and are joined with the hits.
    items = materialize(rows.where(F.col("command").isNotNull()).withColumn("term", squeezed("item")).where("term <> ''"))
    asked = questions.select("query_id", squeezed("text").alias("_q"), F.col("text").alias("question"))
    hits = contained_terms(asked, "query_id", "_q", items.select("term")).join(measured_side(items), "term").join(measured_side(asked), "query_id")
    scored = computed(hits, "score", bigram_score("question", F.concat_ws(" ", "item", "input", "precondition", "step", "command")))
    per_command = scored.groupBy("query_id", F.lower("command").alias("_c")).agg(
        F.max_by(F.struct("command", "document_id", "sheet", "row", "chunk_id"), F.struct("score", -F.col("chunk_id"))).alias("_b"),
        F.max("score").alias("score"), F.count(F.lit(1)).alias("records"))
    total = per_command.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_command.join(total.hint("merge"), "query_id").select(
        "query_id", "_b.*", "score", "records", F.when(F.col("_n") == 1, "answer").otherwise("unresolved").alias("status"))


def numbered_sections(chunks: DataFrame) -> DataFrame:
    """Closed procedure sections whose steps and sub-steps are numbered from 1 without gaps."""
    rows = chunks.where(F.col("content").contains("参数")).select("chunk_id", F.explode(F.arrays_zip(
        tx.extract_all("content", NUMBERED_SECTION, 1).alias("subject"), tx.extract_all("content", NUMBERED_SECTION, 2).alias("body"),
        tx.extract_all("content", NUMBERED_SECTION, 0).alias("section"))).alias("_s")).select("chunk_id", "_s.*")
    steps = tx.extract_all("body", r"(?m)^[ \t]*(\d+)[、．]", 1).cast("array<int>")
    inner = tx.extract_all("body", r"(?m)^[ \t]*[（(](\d+)[）)]", 1).cast("array<int>")

    def consecutive(numbers: Column) -> Column:
        return (F.size(numbers) > 0) & (numbers == F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1))))

    text = tx.strip("section")
    closed = F.length(text).between(20, 1800) & text.rlike("[。.]$")
    return rows.where(closed & consecutive(steps) & consecutive(inner)).select(
        "chunk_id", F.lower("subject").alias("subject"), text.alias("section"), F.size(steps).alias("steps"))


def log_alarms(lines: DataFrame, label: str = "T") -> DataFrame:
    """Distinct warnings ``<device> <label>n Timeout.`` per file, with their line counts."""
    message = F.regexp_extract("line", rf"(?i)\bWARNING\s+([A-Za-z][A-Za-z0-9_]*\s+{label}\d+\s+Timeout\.)", 1)
    return lines.select("file_id", message.alias("message")).where("message <> ''").groupBy("file_id", "message").agg(F.count(F.lit(1)).alias("lines"))


def row_records(cells: DataFrame) -> DataFrame:
    """Four-cell rows read as index, name, value and purpose; no cell may be a placeholder."""
    rows = cells.groupBy("document_id", "sheet", "row", "chunk_id").agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("column").alias("_d"), F.array_sort(F.collect_list(F.struct(F.length("column").alias("l"), "column", "value"))).alias("_c"))
    value = lambda i: tx.strip(F.get(F.col("_c"), F.lit(i))["value"])
    four = rows.where("_n = 4 AND _d = 4")
    sound = value(0).rlike(r"^\d+$") & (value(1) != "") & (value(2) != "") & (value(3) != "") & ~value(2).isin("-", "/", "N/A") & ~value(3).isin("-", "/", "N/A")
    return four.where(sound).select("document_id", "sheet", "row", "chunk_id", value(0).alias("index"), value(1).alias("name"), value(2).alias("value"), value(3).alias("purpose"))


def row_record(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """The record whose name equals the asked name; a name with several records stays unresolved."""
    records = row_records(cells).withColumn("_name", F.lower(tx.squeeze("name")))
    found = questions.select("query_id", F.lower(tx.squeeze("name")).alias("_name")).join(records, "_name")
    counts = found.groupBy("query_id").agg(F.countDistinct("index", "value", "purpose").alias("_n"))
    return found.join(counts, "query_id").withColumn("status", F.when(F.col("_n") == 1, "answer").otherwise("unresolved")).drop("_name", "_n")


def version_records(cells: DataFrame, sheet: str = "测试环境") -> DataFrame:
    """Two-cell rows of an environment sheet: label and firmware version."""
    rows = cells.where(F.col("sheet") == sheet).groupBy("document_id", "row", "chunk_id").agg(
        F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct(F.length("column").alias("l"), "column", "value"))).alias("_c"))
    label = F.regexp_replace(tx.strip(F.get(F.col("_c"), F.lit(0))["value"]), r"^\d+[.、]\s*", "")
    version = tx.strip(F.get(F.col("_c"), F.lit(1))["value"])
    return rows.where("_n = 2").where(version.rlike(r"^Firmware\s*:\s*\d+(?:\.[A-Za-z0-9_-]+){1,5}$") & (F.length(version) <= 80)).select(
        "document_id", "row", "chunk_id", label.alias("label"), version.alias("version"))


# --- answers ------------------------------------------------------------------------------------


def merge_citations(records: DataFrame) -> DataFrame:
    """Identical texts of a question with all their citation numbers; several texts stay unresolved."""
    grouped = records.groupBy("query_id", "text").agg(F.array_sort(F.collect_set("citation")).alias("citations"))
    counts = grouped.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return grouped.join(counts, "query_id").select("query_id", "text", "citations", F.when(F.col("_n") == 1, "answer").otherwise("unresolved").alias("status"))


def local_evidence(question, content) -> Column:
    """The single line of the text that holds a structured identifier of the question, else NULL."""
    question, content = tx.as_column(question), tx.as_column(content)
    tabular = content.rlike(r"(?m)^(?:工作表|文档表格)《")
    short = F.when(tabular, F.array().cast("array<string>")).otherwise(tx.extract_all(question, SHORT_ID))
    terms = F.array_distinct(F.concat(tx.extract_all(question, STRUCTURED_ID), short))
    lines = F.transform(F.split(content, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), tx.strip)

    def line_of(term):
        found = F.filter(lines, lambda line: F.regexp_like(line, F.concat(F.lit("(?i)"), _edge(term))))
        return F.when((F.size(found) == 1) & F.length(F.get(found, F.lit(0))).between(1, 400), F.get(found, F.lit(0)))

    hits = F.array_distinct(F.filter(F.transform(terms, line_of), lambda x: x.isNotNull()))
    return F.when(~F.concat(question, F.lit("\n"), content).rlike(ON_OFF) & (F.size(hits) == 1), hits[0])


def annotate_cells(content, columns) -> Column:
    """Cells of a row text with their header label, as long as the added text fits the budget."""
    content = tx.as_column(content)
    pieces = F.split(content, r"(?<=[；：])(?=[A-Z]+\d+=)")
    start = F.struct(F.lit("").alias("text"), F.lit(MAX_ANNOTATION).alias("left"))

    def step(state, piece):
        label = tx.as_column(columns)[F.regexp_extract(piece, r"^([A-Z]+)\d+=", 1)]
        note = F.concat(F.lit("("), label, F.lit(")"))
        fits = label.isNotNull() & F.length(label).between(1, 40) & ~label.rlike(r"[\r\n]") & (F.length(note) <= state["left"])
        marked = F.concat(F.regexp_extract(piece, r"^([A-Z]+\d+)=", 1), note, F.regexp_replace(piece, r"^[A-Z]+\d+", ""))
        return F.struct(F.concat(state["text"], F.when(F.coalesce(fits, F.lit(False)), marked).otherwise(piece)).alias("text"),
                        F.when(F.coalesce(fits, F.lit(False)), state["left"] - F.length(note)).otherwise(state["left"]).alias("left"))

    return F.aggregate(pieces, start, step, lambda s: s["text"])


def prompt_context(sources: DataFrame) -> DataFrame:
    """Numbered context text per question.

    Sources: query_id, question, slot, document_id, filename, page, paragraph, content. Sources of one
    document are put in page or paragraph order inside their own slots; numbers stay with their source.
    """
    per_doc = Window.partitionBy("query_id", "document_id")
    paged, parted = F.count("page").over(per_doc), F.count("paragraph").over(per_doc)
    n = F.count(F.lit(1)).over(per_doc)
    rows = sources.withColumn("_by", F.when(paged == n, F.col("page")).when(parted == n, F.col("paragraph")).otherwise(F.col("slot")))
    rows = rows.withColumn("_slots", F.sort_array(F.collect_list("slot").over(per_doc))).withColumn(
        "_k", F.row_number().over(per_doc.orderBy("_by", "slot"))).withColumn("_place", F.element_at("_slots", F.col("_k")))
    where = F.array_join(F.filter(F.array(
        F.when(F.col("page") > 0, F.concat(F.lit("第 "), F.col("page").cast("string"), F.lit(" 页"))),
        F.when(F.col("paragraph") > 0, F.concat(F.lit("第 "), F.col("paragraph").cast("string"), F.lit(" 段")))), lambda x: x.isNotNull()), "，")
    local = local_evidence("question", "content")
    text = F.concat(F.lit("["), F.col("slot").cast("string"), F.lit("] 文件《"), F.col("filename"), F.lit("》（"),
                    F.when(where == "", "位置未知").otherwise(where), F.lit("）：\n"),
                    F.when(local.isNotNull(), F.concat(F.lit("问题相关局部证据："), local, F.lit("\n完整片段：\n"))).otherwise(""), tx.strip("content"))
    lines = rows.select("query_id", "question", "_place", text.alias("_text"))
    return lines.groupBy("query_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("_place", "_text"))).alias("_l")).select(
        "query_id", F.concat(F.lit("当前问题："), "question", F.lit("\n\n当前检索片段：\n"), F.array_join(F.transform("_l", lambda x: x["_text"]), "\n")).alias("context"))


def check_citations(answers: DataFrame) -> DataFrame:
    """ok, empty or bad_citation per answer; code spans and type lengths are no citations.

    Answers: answer_id, answer, n_sources.
    """
    text = F.regexp_replace(F.regexp_replace("answer", r"`+[^`]*`+", ""), CITATION_LENGTH, "")
    groups = tx.extract_all(text, CITATION, 1)
    good = F.forall(groups, lambda g: g.rlike(r"^\d+(?:\s*[,，、]\s*\d+)*$") & F.forall(
        F.split(g, "[,，、]"), lambda n: F.trim(n).try_cast("long").between(1, F.col("n_sources"))))
    return answers.withColumn("status", F.when(tx.strip("answer") == "", "empty").when(~good, "bad_citation").otherwise("ok"))


def normalize_refusal(answer, refusal: str = REFUSAL) -> Column:
    """Drop the refusal sentence when a real answer remains; a pure refusal loses its citations."""
    answer = tx.as_column(answer)
    rest = tx.strip(F.replace(answer, F.lit(refusal), F.lit("")))
    real = F.regexp_replace(F.regexp_replace(rest, r"\[\d+\]", ""), r"^[，。；：,.!?！？;:\n \t\-*#]+|[，。；：,.!?！？;:\n \t\-*#]+$", "")
    return F.when(~answer.contains(refusal), answer).when(real != "", rest).otherwise(F.lit(refusal))
