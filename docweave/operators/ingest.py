"""Validation, deduplication, replacement and change application for documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave.functions import text as tx
from docweave.runtime import computed, salted_join
from docweave.sources.metadata import parse_source_metadata

# Accepted extensions, MIME types and size limits.
EXTENSIONS = (".pdf", ".doc", ".docx", ".xlsx", ".txt", ".md")
MIME_TYPES = (
    "application/pdf", "application/x-pdf", "application/msword", "application/vnd.ms-word",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "text/plain", "text/markdown", "text/x-markdown", "application/octet-stream")
MAX_BYTES = 25 * 1024 * 1024
MAX_TEXT_CHARS = 20_000_000
MAX_UNITS = 200_000
MAX_CHUNKS = 50_000
VERSION = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,31}$"
OCR_TAG = r"^ocr_(ok|suspect|failed)_pages="


def clean_version(value) -> Column:
    """Version or its default; NULL when malformed."""
    version = tx.strip(F.coalesce(F.nullif(tx.as_column(value), F.lit("")), F.lit("1.0")))
    return F.when(version.rlike(VERSION), version)


def clean_date(value) -> Column:
    text = tx.strip(tx.as_column(value))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def file_error(filename, size, content_type) -> Column:
    mime = F.lower(F.trim(F.split(F.coalesce(tx.as_column(content_type), F.lit("")), ";")[0]))
    size = tx.as_column(size)
    return (F.when(tx.base_name(filename) == "", "bad_filename")
            .when(size == 0, "empty_file").when(size > MAX_BYTES, "too_large")
            .when(~tx.suffix(filename).isin(*EXTENSIONS), "unsupported_ext")
            .when((mime != "") & ~mime.isin(*MIME_TYPES), "bad_mime"))


def validate_documents(documents: DataFrame) -> DataFrame:
    """Adds ``error_code``; NULL marks a valid document.

    Needs filename, size_bytes, content_type; checks version and effective_date when present.
    """
    error = file_error("filename", "size_bytes", "content_type")
    if "version" in documents.columns:
        error = F.coalesce(error, F.when(clean_version("version").isNull(), F.lit("bad_version")))
    if "effective_date" in documents.columns:
        given = F.coalesce(tx.strip("effective_date"), F.lit("")) != ""
        error = F.coalesce(error, F.when(given & clean_date("effective_date").isNull(), F.lit("bad_date")))
    return documents.withColumn("filename", tx.base_name("filename")).withColumn("error_code", error)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (validated.where(F.col("error_code").isNull()).drop("error_code"),
            validated.where(F.col("error_code").isNotNull()))


def unit_budget_errors(units: DataFrame, max_chars: int = MAX_TEXT_CHARS, max_units: int = MAX_UNITS) -> DataFrame:
    """Documents whose extracted text breaks a budget; counted with map-side partial sums."""
    totals = units.groupBy("document_id").agg(
        F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("units"))
    error = F.when(F.col("chars") > max_chars, "text_too_large").when(F.col("units") > max_units, "too_many_units")
    return totals.withColumn("error_code", error).where(F.col("error_code").isNotNull())


def chunk_budget_errors(chunks: DataFrame, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    return (chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
            .where(F.col("chunks") > max_chunks)
            .select("document_id", "chunks", F.lit("too_many_chunks").alias("error_code")))


def dedup_exact(documents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds ``survivor_id`` and ``is_duplicate`` by content hash; the lowest id wins.

    The winner per hash is a partial aggregate and the join back is salted, so a content that
    fills a third of the corpus is neither gathered in one group nor joined in one task.
    """
    winners = documents.groupBy("sha256").agg(F.min("document_id").alias("survivor_id"), F.count(F.lit(1)).alias("_copies"))
    if existing is not None:
        known = existing.groupBy("sha256").agg(F.min("document_id").alias("_known"))
        winners = winners.join(known, "sha256", "left").select(
            "sha256", F.coalesce("_known", "survivor_id").alias("survivor_id"), "_copies", F.col("_known").isNotNull().alias("_repeat"))
        winners = winners.where((F.col("_copies") > 1) | F.col("_repeat"))
    else:
        winners = winners.where(F.col("_copies") > 1)
    # Contents that occur once need no partner, so only repeated ones are joined back.
    joined = salted_join(documents, winners.select("sha256", "survivor_id"), ["sha256"], "left", "document_id")
    survivor = F.coalesce("survivor_id", "document_id")
    return joined.withColumn("survivor_id", survivor).withColumn("is_duplicate", F.col("survivor_id") != F.col("document_id"))


def replace_document_chunks(existing: DataFrame, rebuilt: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole-document replacement.

    ``outcomes`` holds one row per touched document (document_id, error). Failed documents keep no
    chunks. Returns the new chunk table and the document updates.
    """
    good = outcomes.where(F.col("error").isNull())
    kept = salted_join(existing, outcomes.select("document_id"), ["document_id"], "left_anti", "chunk_id")
    fresh = salted_join(rebuilt, good.select("document_id"), ["document_id"], "left_semi", "chunk_id")
    counts = fresh.groupBy("document_id").agg(F.count(F.lit(1)).alias("num_chunks"))
    updates = outcomes.join(counts, "document_id", "left").select(
        "document_id", F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"),
        F.substring("error", 1, 500).alias("error"), F.coalesce("num_chunks", F.lit(0)).cast("long").alias("num_chunks"))
    return kept.unionByName(fresh), updates


def write_chunks(chunks: DataFrame, path: str, buckets: int = 256) -> None:
    """Partition by document bucket; only the touched buckets are overwritten.

    A second key spreads one bucket over several files, so a huge document is not one writer task.
    """
    (chunks.withColumn("doc_bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))
     .repartition("doc_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path))


def delete_documents(deleted: DataFrame, documents: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cascade to child tables and clear links to the deleted documents."""
    gone = deleted.select("document_id").distinct()
    kept = documents.join(gone, "document_id", "left_anti")
    links = gone.select(F.col("document_id").alias("replacement_document_id"), F.lit(True).alias("_gone"))
    kept = (kept.join(links, "replacement_document_id", "left")
            .withColumn("replacement_document_id", F.when(F.col("_gone").isNull(), F.col("replacement_document_id")))
            .drop("_gone"))
    result = {"documents": kept}
    for name, child in children.items():
        result[name] = child.join(gone, "document_id", "left_anti")
    return result


def delete_turns(turns: DataFrame, deleted: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining turns, and conversations with a recomputed update time; empty ones disappear."""
    kept = turns.join(deleted.select("turn_id").distinct(), "turn_id", "left_anti")
    latest = kept.groupBy("conversation_id").agg(F.max("created_epoch").alias("updated_epoch"))
    remaining = conversations.drop("updated_epoch").join(latest, "conversation_id", "inner")
    return kept, remaining


def upsert_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version per key, by an aggregate that combines map-side."""
    others = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def insert_or_ignore(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(incoming.dropDuplicates(keys).join(current.select(*keys).distinct(), keys, "left_anti"))


def replace_whole(current: DataFrame, replacement: DataFrame, owner: str) -> DataFrame:
    """Lists owned by one key are replaced as a whole."""
    return (current.join(replacement.select(owner).distinct(), owner, "left_anti")
            .unionByName(replacement.dropDuplicates()))


def reindex_plan(documents: DataFrame, originals: DataFrame) -> DataFrame:
    """Route per document: web, log or plain rebuild, or the reason for refusing one.

    Documents: document_id, stored_name, sha256, source_metadata (JSON), tags (array), has_ocr_job.
    Originals: document_id, content (binary or text). The hash is recomputed from the content.
    """
    actual = originals.select("document_id", F.sha2("content", 256).alias("actual_sha"))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    meta = parse_source_metadata("source_metadata")
    is_log = (tx.suffix("stored_name") == ".log") | F.array_contains(tags, "log_source")
    route = F.when(F.col("source_metadata").isNotNull() & F.col("meta").isNotNull(), F.col("meta.kind")).otherwise(F.lit("plain"))
    special = F.col("route") != "plain"
    missing, changed = F.col("actual_sha").isNull(), F.col("actual_sha") != F.col("sha256")
    reason = (
        F.when(F.col("source_metadata").isNotNull() & F.col("meta").isNull(), "source_metadata_invalid")
        .when(special & (F.col("meta.sha256") != F.col("sha256")), F.concat(F.col("route"), F.lit("_metadata_invalid")))
        .when(special & missing, F.concat(F.col("route"), F.lit("_source_missing")))
        .when(special & changed, F.concat(F.col("route"), F.lit("_source_changed")))
        .when(special, F.lit(None))
        .when(is_log, "log_metadata_invalid")
        .when(F.exists(tags, lambda t: t.startswith("web_")), "web_metadata_invalid")
        .when(F.array_contains(tags, "image_text_direct"), "image_text_reindex_blocked")
        .when(F.exists(tags, lambda t: t.rlike(OCR_TAG)) | F.col("has_ocr_job"), "ocr_reindex_blocked")
        .when(missing, "source_missing"))
    return (computed(documents.join(actual, "document_id", "left"), "meta", meta).withColumn("route", route)
            .withColumn("reason", reason)
            .select("document_id", F.when(F.col("reason").isNull(), F.col("route")).alias("route"), "reason"))


def audit_rows(events: DataFrame) -> DataFrame:
    """Append-only action log at second resolution."""
    return events.select(
        "user_id", "username", "action", "detail", "ip",
        F.date_format(F.date_trunc("second", "at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.to_date("at").alias("created_on"))


def append_audit(events: DataFrame, path: str) -> None:
    audit_rows(events).write.mode("append").partitionBy("created_on").parquet(path)


def apply_if_unchanged(changes: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Outcome per change: applied, conflict, busy or missing.

    Changes carry ``expected_<field>`` and ``new_<field>``; values compare null-safely.
    """
    state = current.select(key, F.lit(True).alias("_found"), F.col("status").alias("_status"),
                           *[F.col(f).alias(f"_now_{f}") for f in fields])
    same = F.lit(True)
    for field in fields:
        same = same & F.col(f"expected_{field}").eqNullSafe(F.col(f"_now_{field}"))
    outcome = (F.when(F.col("_found").isNull(), "missing").when(F.col("_status") == "parsing", "busy")
               .when(~same, "conflict").otherwise("applied"))
    return changes.join(state, key, "left").withColumn("outcome", outcome).select(
        key, "outcome", *[F.when(F.col("outcome") == "applied", F.col(f"new_{f}")).otherwise(F.col(f"_now_{f}")).alias(f)
                          for f in fields])
