"""Conversations, history, follow-ups, listings and frozen citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweave.functions import text as tx
from docweave.runtime import computed, ranked, salted_join
from docweave.sources.metadata import parse_source_metadata

HISTORY_TURNS, HISTORY_CHARS = 3, 2000
MAX_ANCESTORS, FOLLOWUP_CHARS = 4, 2000
TITLE_CHARS = 30
# Turn ranking splits a long conversation into buckets of this many consecutive order values.
TURN_BUCKET = 4096
CONTEXT = "struct<format:bigint,parent_chat_id:bigint,chat_ids:array<bigint>,effective_question:string>"
FIRST_LABEL, MORE_LABEL = "原问题：", "补充"
SHA256_ANY = "^[0-9a-fA-F]{64}$"


def conversation_list(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Turn count and error flag per conversation, newest first."""
    counts = turns.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("turn_count"), F.max(F.col("status") == "error").alias("has_error"))
    return conversations.join(counts, "conversation_id", "left").withColumns({
        "turn_count": F.coalesce("turn_count", F.lit(0)), "has_error": F.coalesce("has_error", F.lit(False))}).orderBy(
        F.col("updated_epoch").desc(), F.col("conversation_id").desc())


def page_of(rows: DataFrame, limit: int, offset: int = 0, most: int | None = None) -> DataFrame:
    """One page of an ordered listing, as long as asked; a service that bounds its pages names ``most``, and a larger page is refused, not cut."""
    if limit < 1 or offset < 0 or (most is not None and limit > most):
        raise ValueError(f"no page of {limit} rows from {offset}" + ("" if most is None else f", at most {most}"))
    return rows.offset(offset).limit(limit)


def assign_turns(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn numbers from 1 per conversation, and one row per conversation with title and times.

    Log: conversation_id, order (rising integer), turn_id, user_id, question, created_epoch.
    """
    numbered = ranked(log, ["conversation_id"], F.floor(F.col("order") / TURN_BUCKET), [F.col("order"), F.col("turn_id")], "turn_index")
    conversations = log.groupBy("conversation_id").agg(
        F.min_by("user_id", F.struct("order", "turn_id")).alias("user_id"),
        F.substring(F.min_by("question", F.struct("order", "turn_id")), 1, TITLE_CHARS).alias("title"),
        F.min("created_epoch").alias("created_epoch"), F.max("created_epoch").alias("updated_epoch"))
    return numbered, conversations


def history_context(turns: DataFrame, hidden: DataFrame) -> DataFrame:
    """Last three good turns per conversation that fit the budget, oldest first.

    Questions are kept whole, newest first; answers share what is left. The window limit keeps three
    rows per conversation map-side, so a long conversation is never gathered.
    """
    order = Window.partitionBy("conversation_id").orderBy(F.col("turn").desc(), F.col("turn_id").desc())
    last = turns.where("status = 'ok'").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= HISTORY_TURNS)
    shown = last.join(hidden.select("turn_id").distinct(), "turn_id", "left_anti")
    entry = F.struct("_n", tx.strip("question").alias("question"), tx.strip(F.coalesce("answer", F.lit(""))).alias("answer"))
    grouped = shown.groupBy("conversation_id").agg(F.array_sort(F.collect_list(entry)).alias("_t"))
    items = "array<struct<question:string,answer:string>>"

    def state(left: Column, kept: Column) -> Column:
        return F.struct(left.cast("bigint").alias("left"), kept.cast(items).alias("kept"))

    def add(acc, question, answer, cost):
        return state(acc["left"] - cost, F.concat(acc["kept"], F.array(F.struct(question.alias("question"), answer.alias("answer")))))

    def keep_question(acc, turn):
        size = F.length(turn["question"])
        return F.when((size > 0) & (size <= acc["left"]), add(acc, turn["question"], turn["answer"], size)).otherwise(acc)

    def fit_answer(acc, turn):
        answer = F.substr(turn["answer"], F.lit(1), acc["left"].cast("int"))
        return add(acc, turn["question"], answer, F.length(answer))

    empty = F.array().cast(items)
    questions = grouped.withColumn("_q", F.aggregate("_t", state(F.lit(HISTORY_CHARS), empty), keep_question))
    fitted = F.aggregate(F.col("_q.kept"), state(F.col("_q.left"), empty), fit_answer)
    return questions.select("conversation_id", F.posexplode(F.reverse(fitted["kept"])).alias("position", "_h")).select(
        "conversation_id", "position", "_h.question", "_h.answer")


# --- follow-ups ---------------------------------------------------------------------------------


def canonical_followup(questions: Column) -> Column:
    """The first question and its numbered supplements as one text."""
    lines = F.transform(questions, lambda q, i: F.when(i == 0, F.concat(F.lit(FIRST_LABEL), q)).otherwise(
        F.concat(F.lit(MORE_LABEL), i.cast("string"), F.lit("："), q)))
    return F.array_join(lines, "\n")


def parse_context(raw) -> Column:
    """Checked follow-up context, or NULL: exact fields, rising ids, the parent last, bounded text."""
    document = F.try_parse_json(tx.as_column(raw))
    kinds = F.schema_of_variant(document).isin(
        "OBJECT<chat_ids: ARRAY<BIGINT>, effective_question: STRING, format: BIGINT, parent_chat_id: BIGINT>")
    context = F.when(kinds, F.try_variant_get(document, "$", CONTEXT))
    ids = context["chat_ids"]
    good = ((context["format"] == 1) & F.size(ids).between(1, MAX_ANCESTORS) & F.forall(ids, lambda i: i > 0)
            & (F.array_sort(F.array_distinct(ids)) == ids) & (context["parent_chat_id"] == F.element_at(ids, -1))
            & F.length(context["effective_question"]).between(1, FOLLOWUP_CHARS))
    return F.when(good, context)


def followup_chain(turns: DataFrame, hidden: DataFrame) -> DataFrame:
    """Status per turn with a follow-up context: valid, or the first broken rule.

    Every stored ancestor is read again (same user and conversation, good, visible) and the canonical
    text is rebuilt at each link. A chain has at most four ancestors, so groups stay bounded.
    """
    ctx = parse_context("followup_context")
    records = turns.where(F.col("followup_context").isNotNull()).select(
        "turn_id", "user_id", "conversation_id", "question", ctx.alias("_ctx"))
    steps = records.where(F.col("_ctx").isNotNull()).select(
        "turn_id", "user_id", "conversation_id", F.posexplode("_ctx.chat_ids").alias("_i", "_ancestor"))
    seen = hidden.select(F.col("turn_id").alias("_ancestor")).distinct().withColumn("_hidden", F.lit(True))
    stored = turns.where("status = 'ok'").select(
        F.col("turn_id").alias("_ancestor"), "user_id", "conversation_id", F.col("question").alias("_question"),
        F.col("followup_context").isNotNull().alias("_linked"), ctx.alias("_saved"))
    links = steps.join(stored, ["_ancestor", "user_id", "conversation_id"], "left").join(seen, "_ancestor", "left")
    entry = F.struct("_i", "_question", "_linked", "_saved", F.coalesce("_hidden", F.lit(False)).alias("_hidden"))
    chains = links.groupBy("turn_id").agg(F.array_sort(F.collect_list(entry)).alias("_c"))
    rows = records.join(chains, "turn_id", "left")
    questions, ids = F.transform("_c", lambda c: c["_question"]), F.col("_ctx.chat_ids")

    def link_good(c, i):
        own = F.slice(questions, F.lit(1), i + 1)
        later = (c["_saved"]["chat_ids"] == F.slice(ids, F.lit(1), i)) & (c["_saved"]["effective_question"] == canonical_followup(own))
        return F.when(i == 0, ~c["_linked"]).otherwise(F.coalesce(later, F.lit(False)))

    blank = F.exists(F.concat(questions, F.array("question")), lambda q: tx.strip(F.coalesce(q, F.lit(""))) == "")
    rebuilt = canonical_followup(F.concat(questions, F.array("question")))
    status = (F.when(F.col("_ctx").isNull(), "invalid_context")
              .when(F.element_at(ids, -1) >= F.col("turn_id"), "invalid_order")
              .when(F.exists("_c", lambda c: c["_question"].isNull()), "missing_ancestor")
              .when(F.exists("_c", lambda c: c["_hidden"]), "hidden_ancestor")
              .when(blank, "blank_question")
              .when(F.exists(F.transform("_c", link_good), lambda g: ~F.coalesce(g, F.lit(False))), "broken_chain")
              .when(F.col("_ctx.effective_question") != rebuilt, "changed_text").otherwise("valid"))
    return rows.select("turn_id", status.alias("status"), F.when(status == "valid", F.col("_ctx.effective_question")).alias("effective_question"))


def build_followup(requests: DataFrame, turns: DataFrame) -> DataFrame:
    """Context of a new supplement: the checked chain of its parent plus the new question.

    Requests: request_id, parent_id, question. Too long chains or texts are refused, never cut.
    """
    parent = turns.where("status = 'ok'").select(F.col("turn_id").alias("parent_id"), F.col("question").alias("_pq"), parse_context("followup_context").alias("_pc"))
    rows = requests.join(parent, "parent_id", "left")
    ids = F.concat(F.coalesce("_pc.chat_ids", F.array().cast("array<bigint>")), F.array("parent_id"))
    before = F.coalesce("_pc.effective_question", F.concat(F.lit(FIRST_LABEL), F.col("_pq")))
    text = F.concat(before, F.lit("\n" + MORE_LABEL), F.size(ids).cast("string"), F.lit("："), "question")
    status = (F.when(F.col("_pq").isNull(), "not_found").when(F.size(ids) > MAX_ANCESTORS, "too_many_ancestors")
              .when(F.length(text) > FOLLOWUP_CHARS, "too_long").otherwise("ok"))
    context = F.to_json(F.struct(F.lit(1).alias("format"), F.col("parent_id").alias("parent_chat_id"), ids.alias("chat_ids"), text.alias("effective_question")))
    return rows.select("request_id", status.alias("status"), F.when(status == "ok", context).alias("followup_context"))


# --- listings -----------------------------------------------------------------------------------


def newest(rows: DataFrame, key: str, limit: int = 50, offset: int = 0, most: int | None = None, **equals) -> DataFrame:
    """Filtered rows, newest first, with the total of the filter; paging is a distributed top-n."""
    for column, value in equals.items():
        rows = rows.where(F.col(column) == value)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return page_of(rows.orderBy(F.col(key).desc()), limit, offset, most).withColumn("total", total)


def wrap_legacy_turns(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns without a conversation become one-turn conversations titled by their question.

    The new id is the highest known id plus the turn id: unique and repeatable without ranking.
    """
    top = conversations.agg(F.coalesce(F.max("conversation_id"), F.lit(0)).alias("top")).scalar()
    legacy = turns.where(F.col("conversation_id").isNull()).withColumn("conversation_id", top + F.col("turn_id"))
    created = legacy.select("conversation_id", "user_id", F.substring("question", 1, TITLE_CHARS).alias("title"),
                            F.col("created_epoch"), F.col("created_epoch").alias("updated_epoch"))
    return turns.where(F.col("conversation_id").isNotNull()).unionByName(legacy), created


# --- citations ----------------------------------------------------------------------------------


def freeze_sources(citations: DataFrame, documents: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Adds ``source_snapshot``: the identity of the cited document at citation time, as JSON.

    Damaged source metadata must not pass as an ordinary document: such a snapshot has format 0.
    """
    meta = parse_source_metadata("source_metadata") if "source_metadata" in documents.columns else F.lit(None).cast("struct<kind:string,sha256:string>")
    raw = F.col("source_metadata") if "source_metadata" in documents.columns else F.lit(None).cast("string")
    docs = computed(documents, "_meta", meta).withColumn("_raw", raw)
    known = F.col("_meta").isNotNull() & (F.col("_meta.sha256") == F.col("sha256"))
    identity = [F.col("filename"), F.col("sha256").alias("document_sha256"), F.col("version"), F.col("effective_date"), F.col("applicability"), F.col("device")]
    docs = docs.select("document_id", F.struct(*identity).alias("_id"), F.when(known, F.col("_meta.kind")).alias("_kind"),
                       (F.col("_raw").isNotNull() & ~F.coalesce(known, F.lit(False))).alias("_damaged"))
    rows = salted_join(citations, docs, ["document_id"], "left", "citation_id")
    lines = [F.lit(None).cast("bigint").alias("line_start"), F.lit(None).cast("bigint").alias("line_end")]
    if chunks is not None and "line_start" in chunks.columns:
        rows = rows.join(chunks.select("chunk_id", "line_start", "line_end"), "chunk_id", "left")
        lines = [F.when(F.col("_kind") == "log", F.col(c)).alias(c) for c in ("line_start", "line_end")]
    full = F.to_json(F.struct(F.lit(1).alias("format"), F.col("_id.*"), F.col("_kind").alias("source_kind"), *lines), {"ignoreNullFields": "false"})
    snapshot = F.when(F.col("_id").isNull(), F.lit(None)).when(F.col("_damaged"), F.lit('{"format":0}')).otherwise(full)
    return rows.withColumn("source_snapshot", snapshot).drop("_id", "_kind", "_damaged", "line_start", "line_end")


def citation_status(citations: DataFrame) -> DataFrame:
    """full, legacy_excerpt (no snapshot) or snapshot_unavailable (invalid snapshot)."""
    document = F.try_parse_json("source_snapshot")

    def field(name: str, kind: str = "string", types: tuple = ("STRING",)) -> Column:
        value = F.variant_get(document, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value).isin(*types), F.try_variant_get(document, f"$.{name}", kind))

    present = F.schema_of_variant(F.variant_get(document, "$.effective_date", "variant"))
    kind, start, end = field("source_kind"), field("line_start", "bigint", ("BIGINT",)), field("line_end", "bigint", ("BIGINT",))
    base = ((field("format", "bigint", ("BIGINT",)) == 1) & (tx.strip(field("filename")) != "") & field("document_sha256").rlike(SHA256_ANY)
            & field("version").isNotNull() & field("applicability").isNotNull() & present.isin("STRING", "VOID"))
    located = (kind != "log") | ((start >= 1) & (end >= start))
    valid = F.coalesce(base & F.coalesce(F.when(kind.isNull(), F.lit(True)).otherwise(located), F.lit(False)), F.lit(False))
    return citations.withColumn("evidence_status", F.when(F.col("source_snapshot").isNull(), "legacy_excerpt").when(valid, "full").otherwise("snapshot_unavailable"))
