"""Log files: strict decoding, physical lines and records, all inside the row of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave.functions import text as tx
from docweave.runtime import computed
from docweave.sources.readers import strict_decode

MAX_LOG_CHARS = 4_000_000
MAX_LOG_LINES = 50_000
TIMESTAMP = r"^\s*\[?(?:\d{4}[-/]\d{2}[-/]\d{2}[ T])?\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
BAD_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{fffd}]"
LINE = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"


def decode_log(data, encoding="auto") -> Column:
    """Struct(encoding, text): a byte order mark or the declared encoding decides, nothing is replaced."""
    data = tx.as_column(data)
    head2, head3 = F.hex(F.substring(data, 1, 2)), F.hex(F.substring(data, 1, 3))
    wanted = F.lit(encoding) if isinstance(encoding, str) else encoding
    auto = wanted.isin("auto", "utf-16")
    selected = (F.when(auto & (head2 == "FFFE"), "utf-16-le").when(auto & (head2 == "FEFF"), "utf-16-be")
                .when(wanted == "utf-16", F.lit(None)).when(wanted == "auto", "utf-8").otherwise(wanted))
    selected = F.when((selected == "utf-8") & (head3 == "EFBBBF"), "utf-8-sig").otherwise(selected)
    body = F.when(selected == "utf-8-sig", F.substring(data, F.lit(4), F.length(data))).otherwise(data)
    utf8 = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))

    charset = F.when(selected.isin("utf-16-le", "utf-16-be", "gb18030"), selected)
    text = F.when(selected.isin("utf-8", "utf-8-sig"), utf8).otherwise(F.regexp_replace(strict_decode(data, charset), r"^\x{feff}", ""))
    return F.struct(selected.alias("encoding"), text.alias("text"))


def log_files(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds lines (terminators kept), line_count, newline kind and error_code per file."""
    text = F.col(content)
    lines = tx.extract_all(text, LINE)
    crlf = text.contains("\r\n")
    bare = F.regexp_replace(text, "\r\n", "")
    kinds = F.filter(F.array(F.when(crlf, F.lit("crlf")), F.when(bare.contains("\n"), F.lit("lf")),
                             F.when(bare.contains("\r"), F.lit("cr"))), lambda k: k.isNotNull())
    error = (F.when(text.isNull(), "bad_encoding").when(text.rlike(BAD_CHARACTERS), "control_characters")
             .when(F.length(text) > MAX_LOG_CHARS, "too_many_chars").when(tx.strip(text) == "", "empty_log"))
    checked = computed(files, "error_code", error)
    checked = computed(checked, "lines", F.when(F.col("error_code").isNull(), lines))
    return (checked
            .withColumn("line_count", F.size("lines").cast("long"))
            .withColumn("error_code", F.coalesce("error_code", F.when(F.col("line_count") > MAX_LOG_LINES, F.lit("too_many_lines"))))
            .withColumn("newline", F.when(F.size(kinds) > 1, "mixed").when(F.size(kinds) == 0, "none").otherwise(kinds[0])))


def record_starts(lines) -> Column:
    """0-based first lines of the records of one file."""
    lines = tx.as_column(lines)
    blank = F.transform(lines, lambda line: tx.strip(line) == "")
    positions = F.transform(lines, lambda line, i: F.when(line.rlike(TIMESTAMP), i))
    stamped = F.filter(positions, lambda i: i.isNotNull())
    after_blank = F.filter(F.transform(lines, lambda line, i: F.when(
        (i > 0) & ~F.get(blank, i) & F.get(blank, i - 1), i)), lambda i: i.isNotNull())
    zero = F.array(F.lit(0))
    starts = F.array_sort(F.array_distinct(F.concat(zero, F.when(F.size(stamped) > 0, stamped).otherwise(after_blank))))
    # Leading blank lines belong to the first record that has text.
    lead_blank = F.forall(F.slice(blank, F.lit(1), F.get(starts, F.lit(1))), lambda b: b)
    return F.when((F.size(starts) > 1) & lead_blank, F.concat(zero, F.slice(starts, 3, F.greatest(F.size(starts), F.lit(1))))).otherwise(starts)


def log_lines(files: DataFrame, key: str = "file_id") -> DataFrame:
    """One row per physical line with its record number; the record walk stays inside the file row."""
    starts = record_starts("lines")
    good = computed(files.where(F.col("error_code").isNull()), "_starts", starts)
    rows = good.select(key, "_starts", F.posexplode("lines").alias("_i", "line"))
    return rows.select(
        key, (F.col("_i") + 1).cast("long").alias("line_no"),
        F.size(F.filter("_starts", lambda s: s <= F.col("_i"))).cast("long").alias("record_no"),
        F.regexp_replace("line", r"[\r\n]+$", "").alias("line"))
