"""Choice of sources among the bounded candidates of each question.

Candidates hold query_id, question, position, chunk_id, document_id, seq, filename, page, paragraph,
score and content. Search returns at most 200 per question, so every per-question group is bounded
by construction and the rules run as windows and array folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweave.functions import text as tx
from docweave.runtime import computed, materialize

OVERLAP_CHARS = 24
SHEET_MARK = "工作表《"
# Patterns of the selection rules.
FIELD_VALUE = (r"(?U)(?<![A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_]{1,31})\s*([=:：#]|为|是|\s+)\s*([0-9]+)(?![A-Za-z0-9_.,+-])")
VALUE_END = r"(?![A-Za-z0-9_.,+-])"
FIELD_HEADER = (r"^[ \t]*([A-Za-z][A-Za-z0-9_]{1,31})"
                r"(?:[ \t]+|[ \t]*\r?\n(?:(?!^[ \t]*[A-Z][A-Z0-9_]{2,31}[ \t]*$)[^:=]){0,160}?)"
                r"(?i:Format)\s*:\s*[A-Za-z]\s*[0-9]+")
WHERE_USED = r"(?is)\bWhere\s+used\s*:.*"
BLOCK_CHARS = 4000
PROTOCOL = r"(?<![a-z0-9])(?:ascii|hex|secs)(?![a-z0-9])"
SHEET_PROTOCOL = r"(?<![a-z0-9_])(?:ascii|hex|secs)(?![a-z0-9_])"
SHEET_TITLE = r"(?m)^工作表《([^》]+)》第\s*\d+\s*行："
DOCUMENT_TITLE = r"(?im)^DOCUMENT TITLE:[ \t]*(?:\r?\n)?([^\r\n]+)"
CHANNEL = r"通道\s*(\d+)(?![0-9A-Za-z])(?!\s*(?:[.\-~–—]|至|到))"
WHOLE_CELL = r"(?s)(?:^|[；：\n])[A-Z]+\d+=(.*?)(?=；[A-Z]+\d+=|\n工作表《|$)"
VERSION_TERM = r"^v\d+(?:[._-]\d+)*$"


def _per(*keys: str):
    return Window.partitionBy(*keys)


def _empty() -> Column:
    return F.array().cast("array<string>")


def dedup_same_location(candidates: DataFrame) -> DataFrame:
    """Adds ``kept``: the first of identical texts at one location; NULL locations compare equal."""
    first = F.row_number().over(_per("query_id", "document_id", "page", "paragraph", "content").orderBy("position"))
    return candidates.withColumn("kept", (first == 1) & (tx.strip("content") != ""))


def dedup_contained(candidates: DataFrame) -> DataFrame:
    """Adds ``kept``: false for empty texts and for texts held by a longer one of the same document.

    Containment is transitive, so looking at all longer candidates equals looking at the kept ones.
    """
    rows = candidates.withColumn("_text", tx.squeeze("content")).withColumn("_size", F.length("content"))
    group = _per("query_id", "document_id")
    others = F.collect_list(F.struct(F.col("_size").alias("size"), F.col("position").alias("position"), F.col("_text").alias("text"))).over(group)
    rows = rows.withColumn("_others", others)
    held = F.exists("_others", lambda o: (
        ((o["size"] > F.col("_size")) | ((o["size"] == F.col("_size")) & (o["position"] < F.col("position"))))
        & o["text"].contains(F.col("_text"))))
    return rows.withColumn("kept", (F.col("_text") != "") & ~held).drop("_text", "_size", "_others")


def overlap_verified(left, right) -> Column:
    """The right text starts with a real tail of the left text of at least 24 characters."""
    left = F.regexp_replace(F.coalesce(tx.as_column(left), F.lit("")), r"(?U)\s+$", "")
    right = F.regexp_replace(F.coalesce(tx.as_column(right), F.lit("")), r"(?U)^\s+", "")
    head = F.substring(right, 1, OVERLAP_CHARS)
    # Last occurrence of the head: first occurrence in the reversed text.
    place = F.position(F.reverse(head), F.reverse(left))
    size = place - 1 + OVERLAP_CHARS
    tail = F.substring(left, F.length(left) - size + 1, size)
    return ((F.length(right) >= OVERLAP_CHARS) & (place > 0) & right.startswith(tail) & (F.length(right) > size))


def verified_continuations(candidates: DataFrame) -> DataFrame:
    """(query_id, chunk_id, next_id): the next chunk at the same location with a verified overlap."""
    following = candidates.select(
        "query_id", "document_id", (F.col("seq") - 1).alias("seq"), F.col("chunk_id").alias("next_id"),
        F.col("page").alias("_page"), F.col("paragraph").alias("_paragraph"), F.col("content").alias("_content"))
    pairs = candidates.join(following, ["query_id", "document_id", "seq"])
    same = (F.col("page") == F.col("_page")) | (F.col("paragraph") == F.col("_paragraph"))
    return pairs.where(F.coalesce(same, F.lit(False)) & overlap_verified("content", "_content")).select("query_id", "chunk_id", "next_id")


def greedy_pick(candidates: DataFrame, k: int, reason: Column) -> DataFrame:
    """Up to ``k`` picks per question in position order, each followed by its continuation.

    Returns (query_id, chunk_id, slot, reason). The walk is a fold over the bounded candidate array.
    """
    rows = candidates.join(verified_continuations(candidates), ["query_id", "chunk_id"], "left")
    entry = F.struct("position", "chunk_id", "next_id", reason.alias("reason"))
    ordered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_c"))
    picked = "array<struct<chunk_id:bigint,reason:string>>"

    def has(state, chunk):
        return F.exists(state, lambda p: p["chunk_id"] == chunk)

    def add(state, chunk, why):
        return F.concat(state, F.array(F.struct(chunk.cast("bigint").alias("chunk_id"), why.alias("reason"))))

    def step(state, c):
        one = F.when((F.size(state) < k) & ~has(state, c["chunk_id"]), add(state, c["chunk_id"], c["reason"]))
        two = F.when((F.size(one) < k) & c["next_id"].isNotNull() & ~has(one, c["next_id"]),
                     add(one, c["next_id"], F.lit("verified_continuation"))).otherwise(one)
        return F.when(one.isNull(), state).otherwise(two)

    fold = F.aggregate("_c", F.array().cast(picked), step)
    return ordered.select("query_id", F.posexplode(fold).alias("slot", "_p")).select(
        "query_id", "_p.chunk_id", (F.col("slot") + 1).cast("long").alias("slot"), "_p.reason")


def select_ranked(candidates: DataFrame, k: int) -> DataFrame:
    """Selection that keeps the reranked order; only identical texts at one location drop out."""
    marked = dedup_same_location(candidates)
    picks = greedy_pick(marked.where("kept").drop("kept"), k, F.lit("rerank_top_k"))
    reason = F.coalesce("reason", F.when(tx.strip("content") == "", "empty_content").when(~F.col("kept"), "exact_same_source_text")
                        .otherwise("rank_budget"))
    return marked.join(picks, ["query_id", "chunk_id"], "left").select(
        "query_id", "chunk_id", "position", "slot", reason.alias("reason"))


def title_terms(filename) -> Column:
    name = tx.stem(filename)
    return F.array_union(tx.technical_terms(name), tx.technical_terms(F.regexp_replace(name, "_", " ")))


def shared_bigrams(grams, content, filename) -> Column:
    """Question bigrams held by the text; sheet text outside a spreadsheet counts nothing."""
    text = tx.without_space(content)
    foreign = text.contains(SHEET_MARK) & (tx.suffix(filename) != ".xlsx")
    return F.when(foreign, F.lit(0)).otherwise(F.size(F.filter(tx.as_column(grams), lambda g: text.contains(g))))


def with_features(candidates: DataFrame) -> DataFrame:
    """Adds question terms, body terms and title terms used by the ordering rules."""
    per_doc = _per("query_id", "document_id")
    doc_titles = F.flatten(F.transform(tx.extract_all("content", DOCUMENT_TITLE, 1), tx.technical_terms))
    rows = computed(computed(candidates, "_asked", tx.technical_terms("question")), "_words", tx.technical_terms("content"))
    return (computed(rows, "_title", title_terms("filename"))
            .withColumn("_context", F.array_union("_title", F.flatten(F.collect_list(doc_titles).over(per_doc))))
            .withColumn("_present", F.array_distinct(F.flatten(F.collect_list("_words").over(per_doc)))))


def bigram_promotion(featured: DataFrame, k: int) -> DataFrame:
    """Moves a clear bigram peak, or a clear leading group, up inside its document's slots.

    Adds ``promoted`` and rewrites ``position``; blocked when exact identifiers would be lost.
    """
    per_doc = _per("query_id", "document_id")
    rows = computed(featured, "_grams", tx.bigrams("question"))
    rows = computed(rows, "_shared", shared_bigrams("_grams", "content", "filename"))
    rows = rows.withColumn("_r", F.row_number().over(per_doc.orderBy(F.col("_shared").desc(), "position")))
    rows = rows.withColumn("_top", F.max("_shared").over(per_doc))
    leader = F.col("_shared") >= F.col("_top") - 1
    rows = (rows.withColumn("_n", F.count(F.lit(1)).over(per_doc))
            .withColumn("_second", F.max(F.when(F.col("_r") == 2, F.col("_shared"))).over(per_doc))
            .withColumn("_leaders", F.count_if(leader).over(per_doc))
            .withColumn("_last", F.min(F.when(leader, F.col("_shared"))).over(per_doc))
            .withColumn("_next", F.max(F.when(~leader, F.col("_shared"))).over(per_doc))
            .withColumn("_first_slot", F.min("position").over(per_doc))
            .withColumn("_best_slot", F.max(F.when(F.col("_r") == 1, F.col("position"))).over(per_doc))
            .withColumn("_slots", F.sort_array(F.collect_list("position").over(per_doc))))
    unique = (F.col("_top") >= 3) & (F.col("_second").isNull() | (F.col("_top") >= F.col("_second") + 2))
    group = (F.col("_leaders").between(2, k) & (F.col("_leaders") < F.col("_n")) & (F.col("_last") >= 3)
             & (F.col("_last") >= F.col("_next") + 2))
    retained = F.array_intersect(F.array_except("_asked", "_context"), F.col("_present"))
    winner = F.when(unique, F.col("_r") == 1).otherwise(leader)
    rows = rows.withColumn("_unique", unique).withColumn("_winner", (unique | group) & winner & (F.size("_grams") > 0))
    lost = F.max(F.when(F.col("_winner"), F.size(F.array_except(retained, F.col("_words"))))).over(per_doc)
    rows = rows.withColumn("_moves", F.coalesce(lost == 0, F.lit(False)))
    placed = F.row_number().over(per_doc.orderBy(F.when(F.col("_winner"), 0).otherwise(1),
                                                 F.when(F.col("_winner"), F.col("_r").cast("long")).otherwise(F.col("position"))))
    rows = rows.withColumn("_placed", placed)
    swapped = (F.when(F.col("_r") == 1, F.col("_first_slot")).when(F.col("position") == F.col("_first_slot"), F.col("_best_slot"))
               .otherwise(F.col("position")))
    position = F.when(~F.col("_moves"), F.col("position")).when(F.col("_unique"), swapped).otherwise(
        F.element_at("_slots", F.col("_placed")))
    return rows.withColumn("position", position).withColumn("promoted", F.col("_moves") & F.col("_winner")).drop(
        "_r", "_top", "_n", "_second", "_leaders", "_last", "_next", "_first_slot", "_best_slot", "_slots", "_unique", "_winner", "_placed")


def question_fields(question) -> Column:
    """Array of (field, sep, value) that bind an unsigned whole number to a field."""
    text = F.lower(tx.as_column(question))
    return F.arrays_zip(tx.extract_all(text, FIELD_VALUE, 1).alias("field"), tx.extract_all(text, FIELD_VALUE, 2).alias("sep"),
                        tx.extract_all(text, FIELD_VALUE, 3).alias("value"))


def field_value_matches(question, content, filename) -> Column:
    """``field=value`` constraints of the question that the text states directly or as an enum line."""
    name, text = tx.stem(filename), tx.as_column(content)
    # A pair separated by blanks may be part of the file name; then it is no constraint.
    wanted = F.filter(question_fields(question), lambda f: ~(f["sep"].rlike(r"(?U)^\s+$") & F.regexp_like(
        name, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_.-])"), f["field"], F.lit("[ _-]*"), f["value"], F.lit(VALUE_END)))))
    wanted = F.array_distinct(F.transform(wanted, lambda f: F.struct(f["field"].alias("field"), f["value"].alias("value"))))
    block_pattern = rf"(?m){FIELD_HEADER}((?s:.*?))(?={FIELD_HEADER}|\z)"
    # Block bodies are only cut out of texts that hold a format line.
    blocks = F.when(text.rlike(r"(?i)Format\s*:"), F.arrays_zip(
        F.transform(tx.extract_all(text, block_pattern, 1), F.lower).alias("name"),
        F.transform(tx.extract_all(text, block_pattern, 2), lambda b: F.regexp_replace(F.substring(b, 1, BLOCK_CHARS), WHERE_USED, "")).alias("body")))

    def hit(f):
        direct = F.regexp_like(text, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_.-])"), f["field"],
                                              F.lit(r"[ \t]*(?:[=:：#]|为|是|[ \t]+)[ \t]*"), f["value"], F.lit(VALUE_END)))
        line = F.concat(F.lit(r"(?m)^[ \t]*"), f["value"], F.lit(VALUE_END + r"\s*=\s*(?![0-9]+\s*=)\S"))
        listed = F.exists(blocks, lambda b: (b["name"] == f["field"]) & F.regexp_like(b["body"], line))
        return direct | F.coalesce(listed, F.lit(False))

    return F.transform(F.filter(wanted, hit), lambda f: F.concat(f["field"], F.lit("="), f["value"]))


def wordform_matches(asked, words, present, title) -> Column:
    """Question words missing in the document whose ``-ing`` form the text holds."""
    asked, words, present, title = map(tx.as_column, (asked, words, present, title))
    retained = F.array_except(F.array_intersect(asked, present), title)
    missing = F.array_except(F.array_except(F.filter(asked, lambda t: t.rlike("^[a-z]{3,}$")), present), title)

    def forms(term):
        doubled = F.when(term.rlike("[aeiou][bcdfghjklmnpqrstvwxyz]$"), F.concat(term, F.right(term, F.lit(1)), F.lit("ing")))
        dropped = F.when(term.endswith("e"), F.concat(F.regexp_replace(term, "e$", ""), F.lit("ing")))
        return F.filter(F.array(F.concat(term, F.lit("ing")), doubled, dropped), lambda x: x.isNotNull())

    fits = F.size(F.array_except(retained, words)) == 0
    return F.when(fits, F.array_sort(F.filter(missing, lambda t: F.arrays_overlap(forms(t), words)))).otherwise(_empty())


def priority_columns(featured: DataFrame) -> list[Column]:
    """Descending sort keys: title models, protocol, version, channels, whole cell, named title, score."""
    asked, title = F.col("_asked"), F.col("_title")
    versions = F.filter(asked, lambda t: t.rlike(VERSION_TERM))
    models = F.array_except(F.filter(asked, lambda t: t.rlike(r"\d")), versions)
    named = F.filter(F.array_except(F.array_except(asked, models), versions), lambda t: F.length(t) >= 4)
    protocols = F.array_distinct(tx.extract_all(F.lower("question"), PROTOCOL))
    in_name = F.array_distinct(tx.extract_all(F.lower(tx.stem("filename")), PROTOCOL))
    sheets = F.array_join(tx.extract_all("content", SHEET_TITLE, 1), " ")
    in_sheet = F.array_distinct(tx.extract_all(F.lower(sheets), SHEET_PROTOCOL))
    xlsx = tx.suffix("filename") == ".xlsx"
    source = F.when((F.size(in_name) == 0) & xlsx & (F.size(in_sheet) == 1), in_sheet).otherwise(in_name)
    asked_channels, channels = tx.extract_all("question", CHANNEL, 1), tx.extract_all("content", CHANNEL, 1)
    channel = (F.size(asked_channels) > 0) & (F.size(F.array_except(asked_channels, channels)) == 0)
    compact = F.lower(tx.without_space("question"))
    cell = xlsx & F.exists(tx.extract_all("content", WHOLE_CELL, 1), lambda v: (
        F.length(v).between(4, 80) & v.rlike("[A-Za-z]") & v.rlike(f"[{tx.CJK}]") & compact.contains(F.lower(tx.without_space(v)))))
    first = F.min("position").over(_per("query_id", "document_id")) == F.col("position")
    per_query = _per("query_id")
    hit_model = F.size(F.array_intersect(models, title)) > 0
    docs = F.size(F.collect_set(F.when(hit_model, F.col("document_id"))).over(per_query))
    semantic = (docs == 1) & hit_model & (F.size(F.array_except(asked, title)) == 0) & ~F.col("_strong")
    return [F.size(F.array_intersect(models, title)), F.size(F.array_intersect(protocols, source)),
            F.size(F.array_intersect(versions, title)), channel.cast("int"), cell.cast("int"),
            ((F.size(F.array_intersect(named, title)) > 0) & first).cast("int"),
            F.when(semantic, F.coalesce(F.col("score"), F.lit(0.0))).otherwise(F.lit(0.0))]


def order_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """Contained duplicates out, promotions, field and word-form order inside documents, priorities.

    ``position`` becomes the final order; ``field_matches`` and ``word_matches`` explain it.
    """
    per_doc = _per("query_id", "document_id")
    kept = dedup_contained(candidates).where("kept").drop("kept")
    rows = bigram_promotion(with_features(kept), k)
    rows = computed(rows, "field_matches", field_value_matches("question", "content", "filename"))
    rows = computed(rows, "word_matches", wordform_matches("_asked", "_words", "_present", "_title"))
    slots = F.sort_array(F.collect_list("position").over(per_doc))
    place = F.row_number().over(per_doc.orderBy(F.size("field_matches").desc(), F.size("word_matches").desc(), "position"))
    rows = rows.withColumn("_slots", slots).withColumn("_place", place)
    rows = rows.withColumn("position", F.element_at("_slots", F.col("_place")))
    strong = F.max(F.col("_moves") | (F.size("field_matches") > 0) | (F.size("word_matches") > 0)).over(per_doc)
    rows = rows.withColumn("_strong", strong)
    keys = priority_columns(rows)
    names = [f"_p{i}" for i in range(len(keys))]
    rows = rows.withColumns(dict(zip(names, keys)))
    final = F.row_number().over(_per("query_id").orderBy(*[F.col(n).desc() for n in names], "position"))
    return rows.withColumn("position", final.cast("long")).select(
        *candidates.columns, "promoted", "field_matches", "word_matches")


def select_sources(candidates: DataFrame, k: int) -> DataFrame:
    """Chosen slots and a reason for every candidate: (query_id, chunk_id, position, slot, reason)."""
    # The bounded, ordered candidates feed the pick and the reasons.
    ordered = materialize(order_candidates(candidates, k))
    reason = F.when(F.size("field_matches") > 0, "field_value_match").when(F.size("word_matches") > 0, "query_wordform").otherwise("rank_top_k")
    picks = greedy_pick(ordered, k, reason)
    kept = ordered.select("query_id", "chunk_id", F.lit(True).alias("_kept"))
    why = F.coalesce("reason", F.when(tx.strip("content") == "", "empty_content").when(F.col("_kept").isNull(), "contained_same_document")
                     .otherwise("rank_budget"))
    return (candidates.join(kept, ["query_id", "chunk_id"], "left").join(picks, ["query_id", "chunk_id"], "left")
            .select("query_id", "chunk_id", "position", "slot", why.alias("reason")))
