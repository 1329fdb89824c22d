"""Located text units: paragraphs, rendered table rows, parsed cells and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweave.functions import text as tx

ROW_PREFIX = r"^(?:工作表|文档表格)《([^》]+)》第\s*(\d+)\s*行："
CELL = r"(?s)(?:^|[；;])\s*([A-Z]+)(\d+)=(.*?)(?=[；;]\s*[A-Z]+\d+=|$)"


def paragraph_units(documents: DataFrame, text: str = "text", separator: str = r"\n\s*\n") -> DataFrame:
    """Non-empty paragraphs numbered from 1; one document stays one row until the explode."""
    parts = F.filter(F.transform(F.split(tx.clean_text(text), separator), tx.strip), lambda p: p != "")
    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.posexplode(parts).alias("position", "text")).select(
        *others, (F.col("position") + 1).cast("long").alias("paragraph"), "text")


def column_letter(index: Column) -> Column:
    """Spreadsheet column name of a 1-based column number, up to three letters."""
    first, rest = index - 1, F.floor((index - 27) / 26)

    def letter(value):
        return F.chr((value % 26 + 65).cast("int"))

    two = F.concat(letter(rest), letter(first))
    three = F.concat(letter(F.floor((index - 703) / 676)), letter(rest), letter(first))
    return F.when(index <= 26, letter(first)).when(index <= 702, two).otherwise(three)


def _cells(values, row) -> Column:
    """``A3=v`` pieces of one row; NULL and blank cells are skipped."""
    pieces = F.transform(values, lambda value, i: F.when(
        tx.clean_text(value) != "",
        F.concat(column_letter(i + 1), row.cast("string"), F.lit("="), tx.clean_text(value))))
    return F.array_join(F.filter(pieces, lambda p: p.isNotNull()), "；")


def _render(rows: DataFrame, label: str, sheet: str, values: str) -> DataFrame:
    cells = _cells(F.col(values), F.col("row"))
    return rows.withColumn("_cells", cells).where(F.col("_cells") != "").withColumn(
        "text", F.concat(F.lit(f"{label}《"), F.col(sheet).cast("string"), F.lit("》第 "),
                         F.col("row").cast("string"), F.lit(" 行："), F.col("_cells"))).drop("_cells")


def row_units(rows: DataFrame, sheet: str = "sheet", values: str = "values") -> DataFrame:
    """Spreadsheet rows rendered with their coordinates; the paragraph is the row number."""
    return _render(rows, "工作表", sheet, values).select(
        "document_id", sheet, F.col("row").alias("paragraph"), "text")


def row_units_with_header(rows: DataFrame, table: str = "table_no", values: str = "values") -> DataFrame:
    """Word tables: the rendered first row precedes every later row of the same table.

    The header is one row per table, so it joins instead of spanning the table with a window.
    """
    rendered = _render(rows, "文档表格", table, values)
    header = rendered.where(F.col("row") == 1).select("document_id", table, F.col("text").alias("_header"))
    return rendered.join(header, ["document_id", table], "left").select(
        "document_id", table, F.col("row").alias("paragraph"),
        F.when((F.col("row") > 1) & F.col("_header").isNotNull(), F.concat("_header", F.lit("\n"), "text"))
        .otherwise(F.col("text")).alias("text"))


def parse_rows(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Cells (sheet, row, column, value) of rendered row text.

    A line that opens no row continues the row before it. A row whose cell coordinates name another
    row, or that repeats a column, is void as a whole.
    """
    keys = [c for c in chunks.columns if c != content]
    # Rows open at their prefix; splitting before each prefix keeps continuation lines together.
    opened = F.split(F.col(content), r"\n(?=(?:工作表|文档表格)《[^》]+》第\s*\d+\s*行：)")
    marked = chunks.where(F.col(content).contains("》第"))
    rows = marked.select(*keys, F.posexplode(opened).alias("_part", "_text")).where(F.col("_text").rlike(ROW_PREFIX))
    body = F.regexp_replace("_text", ROW_PREFIX, "")
    # The one-element explode keeps the filters below from copying the cell extraction.
    rows = rows.select(*keys, "_part", F.inline(F.array(F.struct(
        F.regexp_extract("_text", ROW_PREFIX, 1).alias("sheet"), F.regexp_extract("_text", ROW_PREFIX, 2).cast("long").alias("row"),
        F.arrays_zip(tx.extract_all(body, CELL, 1).alias("column"), tx.extract_all(body, CELL, 2).alias("number"),
                     tx.extract_all(body, CELL, 3).alias("value")).alias("cells")))))
    same_row = F.forall("cells", lambda c: c["number"].cast("long") == F.col("row"))
    columns = F.transform("cells", lambda c: c["column"])
    distinct = F.size(F.array_distinct(columns)) == F.size("cells")
    return (rows.where((F.size("cells") > 0) & same_row & distinct)
            .select(*keys, "sheet", "row", F.inline("cells"))
            .select(*keys, "sheet", "row", F.col("column"), tx.strip("value").alias("value")))


def heading_path(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Open ancestor headings per block, held as one array per page.

    Blocks come as ``blocks array<struct<number,kind,text,...>>`` per page, so the walk over a page
    is an array fold inside the row and needs no shuffle.
    """
    heading = "struct<level:int,number:int,text:string>"
    start = F.struct(F.array().cast(f"array<{heading}>").alias("open"),
                     F.array().cast(f"array<struct<number:int,kind:string,text:string,headings:array<{heading}>>>").alias("out"))

    def step(state, block):
        is_heading = block["kind"].rlike("^h[1-6]$")
        level = F.when(is_heading, F.substring(block["kind"], 2, 1).cast("int"))
        open_now = F.when(is_heading, F.filter(state["open"], lambda h: h["level"] < level)).otherwise(state["open"])
        entry = F.struct(level.alias("level"), block["number"].alias("number"), block["text"].alias("text"))
        still_open = F.when(is_heading, F.concat(open_now, F.array(entry))).otherwise(open_now)
        done = F.struct(block["number"].alias("number"), block["kind"].alias("kind"), block["text"].alias("text"),
                        open_now.alias("headings"))
        return F.struct(still_open.alias("open"), F.concat(state["out"], F.array(done)).alias("out"))

    return blocks.withColumn("blocks", F.aggregate("blocks", start, step, lambda state: state["out"]))


def explode_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per block with its heading path and the text that carries the headings."""
    rows = heading_path(pages, key).select(key, F.inline("blocks"))
    path = F.transform("headings", lambda h: h["text"])
    return rows.withColumn("heading_path", F.array_join(path, " > ")).withColumn(
        "context_text", F.array_join(F.concat(path, F.array("text")), "\n")).drop("headings")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Gap-free numbers from 0 inside small key groups."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
