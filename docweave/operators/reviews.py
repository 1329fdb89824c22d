"""Feedback review state, replayable evaluation cases and bound evidence packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave.functions import text as tx
from docweave.operators.access import check_access
from docweave.runtime import materialize, ranked, salted_join

PRIOR_TURNS = 6
MAX_SCOPE_DOCUMENTS = 100
MAX_PACKET_CHUNKS = 200
DIGEST_BUCKET = 1024
STATES = ("pending", "confirmed", "resolved", "dismissed")
CONFIRMED = ("confirmed", "resolved")
PURPOSES = ("source_excerpt", "current_value", "onsite_remedy")
SHA256 = "^[0-9a-f]{64}$"


def fingerprint(*columns: str) -> Column:
    """Hash of the canonical JSON of the columns in name order; NULLs are part of it."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


FEEDBACK_FIELDS = ("feedback_id", "turn_id", "rating", "comment", "question", "answer")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    others = [c for c in reviews.columns if c != "feedback_id"]
    return reviews.groupBy("feedback_id").agg(F.max_by(F.struct(*others), F.col("review_id")).alias("_r")).select("feedback_id", "_r.*")


def feedback_status(feedback: DataFrame, reviews: DataFrame) -> DataFrame:
    """Effective review state: it holds only while rating, comment, question and answer are unchanged."""
    rows = feedback.join(latest_reviews(reviews), "feedback_id", "left")
    same = F.lit(True)
    for name in ("rating", "comment", "question", "answer"):
        same = same & F.col(f"snapshot.{name}").eqNullSafe(F.col(name))
    helpful = F.col("rating") == "helpful"
    reviewed = F.col("review_id").isNotNull()
    status = F.when(reviewed & ~helpful & same, F.col("review_status")).when(helpful, "not_required").otherwise("pending")
    return rows.withColumn("status", status).withColumn("review_stale", reviewed & ~helpful & ~same).withColumn(
        "feedback_hash", fingerprint(*FEEDBACK_FIELDS))


def feedback_snapshot(feedback: DataFrame, turns: DataFrame, citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Feedback with its citations, up to six turns before it, and the revalidation flag.

    Turns are numbered once; the six prior numbers are joined by equality, so no pair of turns of a
    long conversation is formed beyond those six.
    """
    numbered = ranked(turns.select("conversation_id", "turn", "turn_id", "question", "answer"), ["conversation_id"],
                      F.floor(F.col("turn") / 4096), [F.col("turn"), F.col("turn_id")], "turn_no")
    own = numbered.select("turn_id", "conversation_id", "turn_no")
    rows = feedback.select("feedback_id", "turn_id").join(own, "turn_id")
    wanted = rows.select("feedback_id", "conversation_id", F.explode(
        F.transform(F.sequence(F.lit(1), F.lit(PRIOR_TURNS)), lambda i: F.col("turn_no") - i)).alias("turn_no")).where("turn_no > 0")
    prior = (wanted.join(numbered.select("conversation_id", "turn_no", "question", "answer"), ["conversation_id", "turn_no"])
             .groupBy("feedback_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "question", "answer"))).alias("prior_turns")))
    cited = citations.join(documents.select("document_id", "filename", "sha256", "version", "lifecycle"), "document_id")
    sources = (rows.select("feedback_id", "turn_id").join(cited, "turn_id").groupBy("feedback_id").agg(
        F.array_sort(F.collect_list(F.struct("citation_id", "document_id", "filename", "sha256", "version", "lifecycle"))).alias("sources")))
    return (rows.join(prior, "feedback_id", "left").join(sources, "feedback_id", "left")
            .withColumn("context_requires_revalidation", F.col("turn_no") > 1))


def review_errors() -> Column:
    """Broken field rules of a submitted review, in a fixed order."""
    confirmed = F.col("status").isin(*CONFIRMED)
    sources = F.coalesce(F.size("expected_sources"), F.lit(0))
    keys = F.transform("expected_sources", lambda s: F.struct(s["document_id"], s["chunk_id"]))
    replay = F.col("replay_confirmed")
    tests = {
        "unknown_status": ~F.col("status").isin(*STATES),
        "expected_answer_missing": confirmed & (tx.strip("expected_answer") == ""),
        "note_missing": F.col("status").isin("resolved", "dismissed") & (tx.strip("note") == ""),
        "duplicate_source": F.size(F.array_distinct(keys)) != F.size(keys),
        "replay_not_confirmed": replay & (~confirmed | (tx.strip("replay_question") == "")),
        "refusal_undecided": replay & F.col("should_refuse").isNull(),
        "refusal_with_sources": replay & F.col("should_refuse") & (sources > 0),
        "sources_missing": replay & ~F.col("should_refuse") & (sources == 0)}
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())


def validate_reviews(submissions: DataFrame, feedback: DataFrame, reviews: DataFrame) -> DataFrame:
    """Outcome per submission: accepted, invalid, not_required, conflict or not_found.

    The submitted hash and last review id must still be current.
    """
    hashes = feedback.select("feedback_id", F.col("rating").alias("_rating"), fingerprint(*FEEDBACK_FIELDS).alias("_hash"))
    last = reviews.groupBy("feedback_id").agg(F.max("review_id").alias("_last"))
    rows = submissions.join(hashes, "feedback_id", "left").join(last, "feedback_id", "left").withColumn("errors", review_errors())
    current = (F.col("feedback_hash") == F.col("_hash")) & (F.col("expected_review_id") == F.coalesce("_last", F.lit(0)))
    outcome = (F.when(F.size("errors") > 0, "invalid").when(F.col("_hash").isNull(), "not_found")
               .when(F.col("_rating") == "helpful", "not_required").when(~current, "conflict").otherwise("accepted"))
    return rows.withColumn("outcome", outcome).drop("_rating", "_hash", "_last")


def index_digests(chunks: DataFrame) -> DataFrame:
    """Digest of the ordered chunks per document, as a tree of bounded buckets.

    Chunk hashes fold into buckets of 1024 consecutive positions and the buckets into the document, so
    a huge document is hashed by many tasks.
    """
    leaf = F.sha2(F.to_json(F.struct("chunk_id", "seq", "page", "paragraph", "content"), {"ignoreNullFields": "false"}), 256)
    rows = chunks.select("document_id", F.floor(F.col("seq") / DIGEST_BUCKET).alias("_bucket"), "seq", "chunk_id", leaf.alias("_leaf"))
    buckets = rows.groupBy("document_id", "_bucket").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "_leaf"))).alias("_l"))
    folded = buckets.select("document_id", "_bucket", F.sha2(F.array_join(F.transform("_l", lambda x: x["_leaf"]), ""), 256).alias("_digest"))
    return folded.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("_bucket", "_digest"))).alias("_b")).select(
        "document_id", F.sha2(F.array_join(F.transform("_b", lambda x: x["_digest"]), ""), 256).alias("chunk_digest"))


def document_manifest(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Identity and index digest of every ready and active document."""
    good = documents.where("status = 'ready' AND lifecycle = 'active'")
    digest = F.sha2(F.concat_ws("|", F.coalesce("chunk_digest", F.lit("")), F.coalesce("applicability", F.lit(""))), 256)
    return good.join(index_digests(chunks), "document_id", "left").select("document_id", "filename", "sha256", "version", digest.alias("index_sha256"))


def eval_scope(originals: DataFrame, users: DataFrame, documents: DataFrame, grants: DataFrame, members: DataFrame,
               limit: int = MAX_SCOPE_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Replay scope per review and the reviews that have none.

    Originals: review_id, user_id, document_ids (NULL = lost, empty = everything visible). A whole
    corpus beyond the limit is refused by its counts, before any pair is listed.
    """
    from docweave.operators.access import granted_documents, is_admin, is_shared, visible_counts
    active = documents.where("status = 'ready' AND lifecycle = 'active'")
    counts = visible_counts(users, active, grants, members).select("user_id", "visible_documents")
    people = users.select("user_id", "is_active", is_admin().alias("_admin"))
    rows = originals.join(people, "user_id", "left").join(counts, "user_id", "left")
    named = F.size("document_ids") > 0
    asked = rows.where(named).select("review_id", "user_id", F.explode(F.array_distinct("document_ids")).alias("document_id"))
    checked = materialize(check_access(asked, users, documents, grants, members))
    per_review = checked.groupBy("review_id").agg(F.count(F.lit(1)).alias("_asked"), F.bool_and("visible").alias("_all_visible"))
    judged = rows.join(per_review, "review_id", "left")
    error = (F.when(F.col("document_ids").isNull(), "scope_lost").when(~F.coalesce("is_active", F.lit(False)), "user_inactive")
             .when(named & ~F.coalesce("_all_visible", F.lit(False)), "access_revoked")
             .when(F.when(named, F.col("_asked")).otherwise(F.col("visible_documents")) > limit, "too_many_documents")
             .when(~named & (F.col("visible_documents") == 0), "empty_scope"))
    judged = materialize(judged.withColumn("error", error))
    good = judged.where(F.col("error").isNull())
    explicit = checked.join(good.select("review_id"), "review_id", "left_semi").select("review_id", "document_id")
    open_ended = good.where(~named).select("review_id", "user_id", "_admin")

    def listed(rows: DataFrame):
        """Document ids as one array. Open scopes that passed the count check hold at most ``limit`` documents, so a
        longer list has no reader and is not gathered."""
        return rows.select("document_id").limit(limit).agg(F.collect_list("document_id").alias("_ids")).select("_ids").scalar()

    shared = (open_ended.where(~F.col("_admin")).select("review_id", F.explode(listed(active.where(is_shared()))).alias("document_id"))
              .unionByName(open_ended.where("_admin").select("review_id", F.explode(listed(active)).alias("document_id"))))
    asking = users.join(open_ended, "user_id", "left_semi")
    granted = open_ended.join(granted_documents(asking, grants, members).join(active.select("document_id"), "document_id", "left_semi"), "user_id")
    scope = explicit.unionByName(shared.select("review_id", "document_id")).unionByName(granted.select("review_id", "document_id")).distinct()
    return scope, judged.where(F.col("error").isNotNull()).select("review_id", "error")


IDENTITY = ("sha256", "version", "lifecycle", "applicability")


def validate_expected_sources(selected: DataFrame, chunks: DataFrame, documents: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Reasons per selected source: changed identity, foreign excerpt, missing location, out of scope.

    Selected: review_id, document_id, chunk_id, excerpt, chunk_content_sha256 and the identity columns.
    """
    docs = documents.where("status = 'ready'").select("document_id", *[F.col(c).alias(f"_{c}") for c in IDENTITY])
    body = chunks.select("chunk_id", "document_id", "content", "page", "paragraph")
    rows = salted_join(selected, body, ["chunk_id", "document_id"], "left", "review_id").join(docs, "document_id", "left")
    changed = F.sha2("content", 256) != F.col("chunk_content_sha256")
    for name in IDENTITY:
        changed = changed | ~F.col(name).eqNullSafe(F.col(f"_{name}"))
    gone = F.col("content").isNull() | F.col("_sha256").isNull()
    located = (F.coalesce("page", F.lit(0)) > 0) | (F.coalesce("paragraph", F.lit(0)) > 0)
    tests = {"source_missing": gone, "source_changed": ~gone & changed, "excerpt_not_in_source": ~gone & ~F.col("content").contains(F.col("excerpt")),
             "no_location": ~gone & ~located, "source_archived": ~gone & (F.col("_lifecycle") != "active")}
    if scope is not None:
        rows = rows.join(scope.select("review_id", "document_id").distinct().withColumn("_in", F.lit(True)), ["review_id", "document_id"], "left")
        tests["out_of_scope"] = F.col("_in").isNull()
    reasons = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    return rows.select("review_id", "document_id", "chunk_id", reasons.alias("reasons"))


def manifest_changes(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Reviews whose frozen scope no longer equals the current manifest, with the count of changes."""
    fields = ("filename", "sha256", "version", "index_sha256")
    now = current.select("document_id", *[F.col(c).alias(f"_{c}") for c in fields])
    rows = salted_join(frozen, now, ["document_id"], "left", "review_id")
    same = F.lit(True)
    for name in fields:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return rows.where(~same).groupBy("review_id").agg(F.count(F.lit(1)).alias("changed_documents"))


def case_validity(reviews: DataFrame, selected: DataFrame, chunks: DataFrame, documents: DataFrame, frozen: DataFrame,
                  current: DataFrame, revoked: DataFrame) -> DataFrame:
    """Reasons why a saved case cannot be replayed any more; an empty list means ready.

    Reviews: review_id, review_status, replay_confirmed, replay_question, should_refuse, expected_answer.
    ``frozen`` is the stored scope manifest; ``revoked`` holds review ids whose user lost access.
    """
    scope = frozen.select("review_id", "document_id")
    sources = validate_expected_sources(selected, chunks, documents, scope).groupBy("review_id").agg(
        F.count(F.lit(1)).alias("_sources"), F.array_distinct(F.flatten(F.collect_set("reasons"))).alias("_source_reasons"))
    scoped = frozen.groupBy("review_id").agg(F.count(F.lit(1)).alias("_scope"))
    drift = manifest_changes(frozen, current)
    lost = revoked.select("review_id").distinct().withColumn("_revoked", F.lit(True))
    rows = reviews.join(sources, "review_id", "left").join(scoped, "review_id", "left").join(drift, "review_id", "left").join(lost, "review_id", "left")
    count = F.coalesce("_sources", F.lit(0))
    tests = {
        "not_confirmed": ~F.col("review_status").isin(*CONFIRMED),
        "replay_not_confirmed": ~F.col("replay_confirmed") | (F.coalesce("replay_question", F.lit("")) == ""),
        "refusal_undecided": F.col("should_refuse").isNull(),
        "expected_answer_missing": F.coalesce("expected_answer", F.lit("")) == "",
        "sources_missing": ~F.col("should_refuse") & (count == 0), "refusal_with_sources": F.col("should_refuse") & (count > 0),
        "scope_not_frozen": F.col("_scope").isNull(), "access_changed": F.col("_revoked"), "scope_changed": F.col("changed_documents") > 0}
    own = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    reasons = F.array_sort(F.concat(own, F.coalesce("_source_reasons", F.array().cast("array<string>"))))
    return rows.select("review_id", reasons.alias("reasons"), (F.size(reasons) == 0).alias("ready"))


def export_candidates(status: DataFrame) -> DataFrame:
    """Confirmed or resolved reviews as candidate records."""
    name = F.concat(F.lit("feedback-"), F.col("feedback_id").cast("string"), F.lit("-review-"), F.col("review_id").cast("string"))
    return status.where(F.col("status").isin(*CONFIRMED)).select(
        name.alias("case_id"), F.col("snapshot.question").alias("question"), "expected_answer", "should_refuse",
        F.col("status").alias("review_status"), F.lit(False).alias("runnable"))


def export_cases(status: DataFrame, validity: DataFrame) -> DataFrame:
    """Candidates that are still valid, as replayable cases."""
    ready = validity.where("ready").select("review_id")
    return export_candidates(status.join(ready, "review_id", "left_semi")).withColumn("runnable", F.lit(True))


# --- evidence packets ---------------------------------------------------------------------------


def bind_evidence(requests: DataFrame) -> DataFrame:
    """Digest and error per evidence request; at most 200 chunks, so a packet is a bounded group.

    Requests: request_id, position, chunk_id, document_id, filename, version, sha256, content, page,
    paragraph. Beyond the limit a request is refused by its count and never gathered.
    """
    bad = F.when((F.col("chunk_id") <= 0) | (F.col("document_id") <= 0) | F.col("chunk_id").isNull() | F.col("document_id").isNull(), "invalid_source_identity") \
        .when((tx.strip(F.coalesce("content", F.lit(""))) == "") | (tx.strip(F.coalesce("filename", F.lit(""))) == ""), "missing_source_text_or_filename") \
        .when((tx.strip(F.coalesce("version", F.lit(""))) == "") | ~F.coalesce(F.col("sha256").rlike(SHA256), F.lit(False)), "missing_document_identity") \
        .when((F.col("page") <= 0) | (F.col("paragraph") <= 0), "invalid_source_location")
    leaf = F.sha2(F.to_json(F.struct("chunk_id", "document_id", "filename", "version", "sha256", "content", "page", "paragraph"), {"ignoreNullFields": "false"}), 256)
    rows = requests.withColumn("_bad", bad).withColumn("_leaf", leaf)
    counts = rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("chunk_id").alias("_distinct"), F.min("_bad").alias("_bad"))
    judged = counts.withColumn("error", F.when(F.col("chunks") > MAX_PACKET_CHUNKS, "too_many_sources").when(
        F.col("_bad").isNotNull(), F.col("_bad")).when(F.col("_distinct") < F.col("chunks"), "duplicate_chunk_id"))
    bounded = rows.join(judged.where("error IS NULL").select("request_id"), "request_id", "left_semi")
    digests = bounded.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", "_leaf"))).alias("_l")).select(
        "request_id", F.sha2(F.array_join(F.transform("_l", lambda x: x["_leaf"]), ""), 256).alias("digest"))
    return judged.select("request_id", "chunks", "error").join(digests, "request_id", "left")


def rebind_evidence(bound: DataFrame, current_requests: DataFrame) -> DataFrame:
    """source_changed per request whose packet built from the current tables differs."""
    now = bind_evidence(current_requests).select("request_id", F.col("digest").alias("_now"))
    changed = ~F.col("digest").eqNullSafe(F.col("_now"))
    return bound.join(now, "request_id", "left").select(
        "request_id", F.when(F.col("error").isNotNull(), F.col("error")).when(changed, "source_changed").otherwise("ok").alias("status"))


def render_selection(requests: DataFrame, selections: DataFrame) -> DataFrame:
    """Answer status and excerpt text per (request, purpose).

    Selections: request_id, purpose, chunk_ids. Chosen ids must be in the packet and distinct. Only
    excerpts can be answered from documents; current values and on-site remedies never can.
    """
    numbered = ranked(requests.select("request_id", "position", "chunk_id", "content"), ["request_id"], F.floor(F.col("position") / DIGEST_BUCKET),
                      ["position", "chunk_id", "content"], "n")
    # Of a packet only the chosen excerpts come together.
    asked = selections.select("request_id", "chunk_ids").distinct()
    chosen = (asked.select("request_id", "chunk_ids", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id")).join(numbered, ["request_id", "chunk_id"])
              .groupBy("request_id", "chunk_ids").agg(F.array_sort(F.collect_list(F.struct("n", "chunk_id", "content"))).alias("_p")))
    known = requests.select("request_id").distinct().withColumn("_known", F.lit(True))
    rows = (selections.join(known, "request_id", "left")
            .join(chosen.withColumnsRenamed({"request_id": "_request", "chunk_ids": "_chosen"}),
                  (F.col("request_id") == F.col("_request")) & F.col("chunk_ids").eqNullSafe(F.col("_chosen")), "left"))
    blocks = F.coalesce("_p", F.array().cast(chosen.schema["_p"].dataType))
    ids = F.transform(blocks, lambda b: b["chunk_id"])
    reason = (F.when(F.col("_known").isNull(), "unknown_request").when(F.size(F.array_distinct("chunk_ids")) != F.size("chunk_ids"), "invalid_selection")
              .when(F.size(F.array_except("chunk_ids", ids)) > 0, "unknown_source").when(~F.col("purpose").isin(*PURPOSES), "unsupported_request_purpose"))
    status = (F.when(reason.isNotNull(), "invalid").when(F.col("purpose") != "source_excerpt", "insufficient")
              .when(F.size("chunk_ids") == 0, "insufficient").otherwise("source_excerpt"))
    text = F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("["), b["n"].cast("string"), F.lit("] "), b["content"])), "\n\n")
    return rows.select("request_id", "purpose", status.alias("status"), reason.alias("reason"),
                       F.when(status == "source_excerpt", text).alias("text"),
                       F.when(status == "source_excerpt", F.transform(blocks, lambda b: b["n"])).alias("source_ids"))


def overall_status(rendered: DataFrame) -> DataFrame:
    """One status per request: that of a single purpose, else partial or insufficient."""
    grouped = rendered.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("purposes"), F.max(F.col("status") == "invalid").alias("_invalid"),
        F.max(F.col("status") == "source_excerpt").alias("_some"), F.min("status").alias("_one"))
    status = F.when(F.col("_invalid"), "invalid").when(F.col("purposes") == 1, F.col("_one")).when(F.col("_some"), "partial").otherwise("insufficient")
    return grouped.select("request_id", "purposes", status.alias("status"))


