"""Page records of recognised documents: quality, validation, retry merge and publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave.functions import text as tx
from docweave.runtime import computed

LINE_SCORE = 0.60
PAGE_SCORE = 0.60
MIN_PAGE_CHARS = 10
MAX_GARBLE = 0.02
MAX_PAGES = 50
MAX_PAGE_CHARS = 4_000_000
STATUSES = ("ok", "suspect", "failed")


def page_quality(lines: DataFrame, most_uncertain: int | None = None) -> DataFrame:
    """Scores, warnings and status per page from recognised lines.

    ``uncertain_lines`` lists all lines of a low score, or the first ``most_uncertain``. A page holds few lines, and the counts combine map-side; the text of a page is gathered only
    within its own (document, page) group.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text", "score")))
    pages = lines.groupBy("document_id", "page").agg(
        F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.min("score"), 4).alias("min_score"),
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(F.col("score") < LINE_SCORE).alias("low_lines"),
        F.count_if(F.col("score").isNull()).alias("unscored"), ordered.alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: x["text"]), "\n")
    quality = tx.text_quality("text")
    scored = F.col("unscored") == 0
    first = F.get(F.col("_lines"), F.lit(0))["line_no"]
    uncertain = F.filter("_lines", lambda x: x["score"] < LINE_SCORE)
    if most_uncertain is not None:
        uncertain = F.slice(uncertain, 1, most_uncertain)
    pages = computed(pages.withColumn("text", text), "_q", quality)
    warnings = F.filter(F.array(
        F.when(scored & (F.col("low_lines") > 0), F.lit("low_confidence_line")),
        F.when(F.col("_q.chars") == 0, F.lit("no_text_detected")).when(F.col("_q.chars") < MIN_PAGE_CHARS, F.lit("short_text")),
        F.when(F.col("_q.garble_ratio") > MAX_GARBLE, F.lit("garbled_text")),
        F.when(scored & (F.col("mean_score") < PAGE_SCORE), F.lit("low_confidence"))), lambda w: w.isNotNull())
    return pages.select(
        "document_id", "page", "text", F.col("_q.chars").alias("chars"), "line_count",
        F.when(scored, F.col("mean_score")).alias("mean_score"), F.when(scored, F.col("min_score")).alias("min_score"),
        F.when(scored, F.transform(uncertain, lambda x: (x["line_no"] - first + 1).cast("long"))).alias("uncertain_lines"),
        warnings.alias("warnings"), F.when(F.size(warnings) > 0, "suspect").otherwise("ok").alias("status"))


def uncertain_lines(lines: DataFrame) -> DataFrame:
    """(document_id, page, line, text, score): every line of a low score on pages whose lines all have one, numbered from 1.

    Only one row per page is aggregated; the lines are not gathered.
    """
    pages = lines.groupBy("document_id", "page").agg(F.min("line_no").alias("_first"), F.count_if(F.col("score").isNull()).alias("_unscored"))
    low = lines.where(F.col("score") < LINE_SCORE).join(pages.where("_unscored = 0"), ["document_id", "page"])
    return low.select("document_id", "page", (F.col("line_no") - F.col("_first") + 1).cast("long").alias("line"), "text", "score")


def page_summary(pages: DataFrame) -> DataFrame:
    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(f"{status}_pages")

    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), *[count(s) for s in STATUSES], count("skipped"))


def validate_page_set(pages: DataFrame, expected: DataFrame, allow_skipped: bool = False) -> DataFrame:
    """Error per document: pages must be exactly 1..n once, with a known status and text."""
    known = [*STATUSES, *(["skipped"] if allow_skipped else [])]
    usable = F.col("status").isin("ok", "suspect")
    stats = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("page").alias("distinct_pages"),
        F.min("page").alias("first_page"), F.max("page").alias("last_page"),
        F.count_if(~F.coalesce(F.col("status").isin(known), F.lit(False))).alias("bad_status"),
        F.count_if(usable & (tx.strip(F.coalesce("text", F.lit(""))) == "")).alias("blank_pages"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    n = F.col("page_count")
    complete = (F.col("rows") == n) & (F.col("distinct_pages") == n) & (F.col("first_page") == 1) & (F.col("last_page") == n)
    error = (F.when(F.col("rows").isNull() | n.isNull() | (n < 1) | (n > MAX_PAGES) | ~complete, "page_numbers_invalid")
             .when(F.col("bad_status") > 0, "page_status_invalid").when(F.col("blank_pages") > 0, "page_text_missing")
             .when(F.col("chars") > MAX_PAGE_CHARS, "text_limit"))
    return expected.join(stats, "document_id", "left").select("document_id", "page_count", error.alias("error_code"))


def merge_page_retry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Only pages that had failed take the retry; a skipped retry page is an error."""
    retry = new.select("document_id", "page", F.col("status").alias("_status"), F.col("text").alias("_text"))
    joined = old.join(retry, ["document_id", "page"], "left")
    failed = F.col("status") == "failed"
    skipped = failed & (F.col("_status") == "skipped")
    take = failed & F.col("_status").isNotNull() & ~skipped
    return joined.select(
        "document_id", "page", F.when(take, F.col("_status")).otherwise(F.col("status")).alias("status"),
        F.when(take, F.col("_text")).otherwise(F.col("text")).alias("text"),
        F.when(skipped, F.lit("retry_skipped")).alias("error_code"))


def publish_pages(pages: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Published pages and one row of tags per document.

    Good pages are published, suspect ones only after explicit acceptance, failed ones never.
    """
    marks = accepted.select("document_id", "page", F.lit(True).alias("_accepted")).distinct()
    joined = pages.join(marks, ["document_id", "page"], "left").withColumn("_accepted", F.coalesce("_accepted", F.lit(False)))
    published = joined.where((F.col("status") == "ok") | ((F.col("status") == "suspect") & F.col("_accepted"))).drop("_accepted")

    def numbers(condition: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.col("page")))), lambda p: p.cast("string")), ",")

    def tag(name: str) -> Column:
        return F.when(F.col(name) != "", F.concat(F.lit(name + "="), F.col(name)))

    names = [f"ocr_{s}_pages" for s in STATUSES]
    grouped = joined.groupBy("document_id").agg(
        *[numbers(F.col("status") == s).alias(n) for s, n in zip(STATUSES, names)],
        numbers((F.col("status") == "suspect") & ~F.col("_accepted")).alias("ocr_excluded_suspect_pages"))
    tags = F.filter(F.array(*[tag(n) for n in [*names, "ocr_excluded_suspect_pages"]]), lambda t: t.isNotNull())
    return published, grouped.select("document_id", tags.alias("tags"))


def parse_page_tags(documents: DataFrame) -> DataFrame:
    """Page numbers per status out of the tag strings."""
    pattern = r"^ocr_(ok|suspect|failed)_pages=(.*)$"
    rows = documents.select("document_id", F.explode("tags").alias("tag")).where(F.trim("tag").rlike(pattern))
    token = F.explode(F.split(F.regexp_extract(F.trim("tag"), pattern, 2), ","))
    return (rows.select("document_id", F.regexp_extract(F.trim("tag"), pattern, 1).alias("status"), token.alias("_token"))
            .where(F.trim("_token").rlike("^[0-9]{1,16}$"))
            .select("document_id", "status", F.trim("_token").cast("long").alias("page"))
            .where(F.col("page").between(1, 2 ** 53 - 1)).distinct())


def merge_layer_text(layer, recognised) -> Column:
    """Recognised text alone when it holds every layer line, else both."""
    layer, recognised = tx.strip(F.coalesce(tx.as_column(layer), F.lit(""))), tx.strip(F.coalesce(tx.as_column(recognised), F.lit("")))
    lines = F.filter(F.transform(F.split(layer, r"\r\n|[\n\r]"), tx.without_space), lambda x: x != "")
    held = F.forall(lines, lambda line: tx.without_space(recognised).contains(line))
    return (F.when(layer == "", recognised).when(recognised == "", layer).when(held, recognised)
            .otherwise(F.concat(layer, F.lit("\n"), recognised)))
