"""Keyword search with facets, corpus inspection and usage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave.functions import text as tx
from docweave.functions.matching import contained_terms
from docweave.operators.access import COMMON_DEVICE, Scope
from docweave.operators.index import top_per_query
from docweave.operators.substrings import GramIndex, holding_all
from docweave.runtime import computed
from docweave.sources.metadata import parse_source_metadata, source_type

OCR_FAILED, OCR_SUSPECT = r"^ocr_failed_pages=", r"^ocr_suspect_pages="
# Reasons of the inspection summary, in their order.
REASONS = ("处理未就绪", "没有入库片段", "记录片段数与实际不一致", "存在空白片段", "部分片段缺少位置", "OCR 存在可疑页",
           "OCR 存在失败页", "OCR 文字待核对", "OCR 处理失败", "网页内容未完全提取或核对")


def search_terms(query) -> Column:
    """All white-space separated terms, whole."""
    return F.filter(F.split(tx.strip(query), r"(?U)\s+"), lambda w: w != "")


def asked_terms(queries: DataFrame) -> DataFrame:
    return computed(queries, "_terms", F.array_distinct(F.transform(search_terms("text"), tx.ascii_lower))).where(F.size("_terms") > 0)


def keyword_matches(queries: DataFrame, chunks: DataFrame, scope: Scope | None = None) -> DataFrame:
    """(query_id, chunk_id, document_id) of ready chunks that hold every term, ASCII case-insensitively.

    Queries: query_id, text, and optionally include_archived, page, device, source_types. Chunks:
    chunk_id, document_id, content, status, lifecycle, and page, device, source_type when filtered.
    """
    asked = asked_terms(queries)
    wanted = asked.select("query_id", F.size("_terms").alias("_n"), F.explode("_terms").alias("term"))
    ready = chunks.where(F.col("status") == "ready")
    columns = [c for c in ("document_id", "lifecycle", "filename", "seq", "page", "device", "source_type") if c in chunks.columns]
    # Hits carry what the filters and the paging need, so the chunk table is read once.
    texts = contained_terms(ready, "chunk_id", "content", wanted, columns)
    full = (texts.join(wanted, "term").groupBy("chunk_id", "query_id", "_n", *columns).agg(F.count(F.lit(1)).alias("_hits"))
            .where(F.col("_hits") == F.col("_n")).select("query_id", "chunk_id", *columns))
    return filtered_matches(full, asked, scope)


def indexed_keyword_matches(queries: DataFrame, chunks: DataFrame, index: GramIndex, scope: Scope | None = None) -> DataFrame:
    """The rows of ``keyword_matches`` through a substring index of the chunk texts.

    The index may hold more chunks than the table has now; those that are gone or not ready are not found.
    """
    asked = asked_terms(queries)
    ready = chunks.where(F.col("status") == "ready")
    columns = [c for c in ("document_id", "lifecycle", "filename", "seq", "page", "device", "source_type") if c in chunks.columns]
    held = holding_all(asked.select("query_id", F.col("_terms").alias("terms")), index, ready)
    return filtered_matches(held.join(ready.select("chunk_id", *columns), "chunk_id"), asked, scope)


def filtered_matches(full: DataFrame, asked: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Matches that the filters of their question and its scope let through."""
    columns = full.columns
    rows = full.join(
        asked.select("query_id", *[F.col(c).alias(f"_want_{c}") for c in (
            "include_archived", "page", "device", "source_types") if c in asked.columns]), "query_id")
    keep = F.col("lifecycle") == "active"
    if "_want_include_archived" in rows.columns:
        keep = keep | F.col("_want_include_archived")
    if "_want_page" in rows.columns:
        keep = keep & (F.col("_want_page").isNull() | (F.col("page") == F.col("_want_page")))
    if "_want_device" in rows.columns:
        keep = keep & (F.col("_want_device").isNull() | F.col("device").isin(COMMON_DEVICE) | (F.col("device") == F.col("_want_device")))
    if "_want_source_types" in rows.columns:
        keep = keep & (F.col("_want_source_types").isNull() | F.array_contains("_want_source_types", F.col("source_type")))
    rows = rows.where(keep).select("query_id", "chunk_id", "document_id", *[c for c in ("filename", "seq") if c in columns])
    return rows if scope is None else scope.keep(rows)


def search_page(matches: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of hits ordered by file name, document and position; paging is the feature."""
    best = top_per_query(matches, offset + limit, tx.ascii_lower("filename"), F.col("document_id"), F.col("seq"), F.col("chunk_id"))
    return best.where(F.col("rank") > offset)


def search_totals(matches: DataFrame) -> DataFrame:
    return matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))


def search_facets(matches: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits per document with its device and source type; with ``limit`` the first documents per question, by hits and file name.

    ``source_metadata`` and ``content_type`` may be absent.
    """
    for name in ("source_metadata", "content_type"):
        if name not in documents.columns:
            documents = documents.withColumn(name, F.lit(None).cast("string"))
    hits = matches.groupBy("query_id", "document_id").agg(F.count(F.lit(1)).alias("hits"))
    kind = source_type("source_metadata", "content_type", "filename").alias("source_type")
    found = hits.join(documents.select("document_id", "filename", "device", kind), "document_id")
    if limit is None:
        return found
    return top_per_query(found, limit, F.col("hits").desc(), tx.ascii_lower("filename"), F.col("document_id"))


def nonempty(content="content") -> Column:
    return F.trim(F.translate(tx.as_column(content), "\t\n\r", "   ")) != ""


def unlocated() -> Column:
    """No page, no paragraph and no valid line range."""
    lines = (F.coalesce("line_start", F.lit(0)) > 0) & (F.coalesce("line_end", F.lit(0)) >= F.col("line_start"))
    return (F.coalesce("page", F.lit(0)) <= 0) & (F.coalesce("paragraph", F.lit(0)) <= 0) & ~F.coalesce(lines, F.lit(False))


def _with_lines(chunks: DataFrame) -> DataFrame:
    for name in ("line_start", "line_end"):
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(None).cast("long"))
    return chunks


def inspection_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with at least one defect and the ordered reasons.

    Documents: document_id, filename, status, num_chunks, tags, source_metadata, job_state, direct_image.
    Chunk defects are counted with partial sums, so a document of any size costs no gathered group.
    """
    counts = _with_lines(chunks).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("actual"), F.count_if(~nonempty()).alias("empty"), F.count_if(unlocated()).alias("unlocated"))
    rows = documents.join(counts, "document_id", "left").fillna(0, ["actual", "empty", "unlocated"])
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    failed, suspect = F.exists(tags, lambda t: t.rlike(OCR_FAILED)), F.exists(tags, lambda t: t.rlike(OCR_SUSPECT))
    state = F.coalesce("job_state", F.lit(""))
    meta = parse_source_metadata("source_metadata")
    tests = (F.col("status") != "ready", F.col("actual") == 0, F.col("actual") != F.col("num_chunks"), F.col("empty") > 0,
             (F.col("unlocated") > 0) & ~F.col("direct_image"), suspect, failed,
             (state == "review") | F.array_contains(tags, "ocr_human_review_pending"), (state == "failed") & ~failed,
             (F.col("_meta.kind") == "web") & (F.col("_meta.status") == "partial"))
    reasons = F.filter(F.array(*[F.when(test, F.lit(reason)) for test, reason in zip(tests, REASONS)]), lambda r: r.isNotNull())
    found = computed(computed(rows, "_meta", meta), "reasons", reasons)
    return found.where(F.size("reasons") > 0).select("document_id", "filename", "reasons").orderBy(tx.ascii_lower("filename"), "document_id")


def inspect_document(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Quality figures per document; page lists come from distinct (document, page) pairs."""
    rows = _with_lines(chunks)
    stats = rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("content")).alias("text_chars"),
        F.count_if(~nonempty()).alias("empty_chunk_count"), F.countDistinct(F.when(F.col("paragraph") > 0, F.col("paragraph"))).alias("paragraph_count"),
        F.count_if(unlocated()).alias("chunks_without_location"))
    pages = indexed_pages(chunks)
    failed = failed_pages(documents)
    page_stats = pages.join(failed.withColumn("_failed", F.lit(True)), ["document_id", "page"], "left").join(
        documents.select("document_id", "page_count"), "document_id").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("indexed_pages"), F.count_if(F.col("_failed").isNotNull()).alias("failed_pages_indexed"),
        F.count_if(F.col("page") > F.col("page_count")).alias("pages_out_of_range"))
    figures = ["chunk_count", "text_chars", "empty_chunk_count", "paragraph_count", "chunks_without_location", "indexed_pages",
               "failed_pages_indexed", "pages_out_of_range"]
    return (documents.select("document_id", "num_chunks").join(stats, "document_id", "left").join(page_stats, "document_id", "left")
            .fillna(0, figures).withColumn("count_differs", F.col("chunk_count") != F.col("num_chunks")).select("document_id", *figures, "count_differs"))


def indexed_pages(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.col("page") > 0) & nonempty()).select("document_id", "page").distinct()


def failed_pages(documents: DataFrame) -> DataFrame:
    from docweave.operators.page_sets import parse_page_tags
    return parse_page_tags(documents).where("status = 'failed'").select("document_id", "page")


def missing_pages(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Physical pages without indexed text; the page count comes with the document."""
    pages = documents.where(F.col("page_count") > 0).select("document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count").cast("long"))).alias("page"))
    return pages.join(indexed_pages(chunks), ["document_id", "page"], "left_anti")


# --- metrics ------------------------------------------------------------------------------------


SERIES = ("model_ms", "retrieval", "tokens")


def latency_samples(turns: DataFrame) -> DataFrame:
    """Adds the sample columns of the latency figures.

    Model time counts answered turns only; retrieval time counts every turn that searched, also failed
    ones; a turn without model time that did not fail is a refusal.
    """
    failed = F.lower(F.trim(F.coalesce("status", F.lit("")))) == "error"
    answered = ~failed & F.col("latency_ms").isNotNull()
    return turns.withColumns({
        "_failed": failed, "_refused": ~failed & F.col("latency_ms").isNull(), "_model_ms": F.when(answered, F.col("latency_ms")),
        "_retrieval": F.col("retrieval_ms"), "_tokens": F.when(answered, F.col("completion_tokens"))})


def latency_figures() -> list[Column]:
    """Counts and nearest-rank percentiles: element ceil(share * n) of the sorted samples."""
    columns = [F.count(F.lit(1)).alias("turns"), F.count_if("_failed").alias("errors"), F.count_if("_refused").alias("refusals")]
    for name in SERIES:
        columns += [F.count(f"_{name}").alias(f"{name}_samples"), F.max(f"_{name}").alias(f"{name}_max")]
        columns += [F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY _{name})").alias(f"{name}_{label}")
                    for share, label in ((0.5, "p50"), (0.95, "p95"))]
    return columns


def latency_summary(turns: DataFrame, window: int = 500) -> DataFrame:
    """Figures over the newest turns; the window is the feature and a distributed top-n."""
    newest = turns.orderBy(F.col("turn_id").desc()).limit(window)
    return latency_samples(newest).agg(*latency_figures(), F.min("created_epoch").alias("first_epoch"), F.max("created_epoch").alias("last_epoch"))


def overview(users: DataFrame, documents: DataFrame, chunks: DataFrame, turns: DataFrame, day_start_epoch: int) -> DataFrame:
    """One row of corpus and usage counts; every count is its own partial aggregate."""
    docs = documents.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("uploads_bytes"))
    chats = turns.agg(F.count(F.lit(1)).alias("chats"), F.count_if(F.col("created_epoch") >= day_start_epoch).alias("chats_today"))
    return docs.select("documents", "uploads_bytes", users.agg(F.count(F.lit(1))).scalar().alias("users"),
                       chunks.agg(F.count(F.lit(1))).scalar().alias("chunks"), chats.select("chats").scalar().alias("chats"),
                       chats.select("chats_today").scalar().alias("chats_today"))
