"""The whole path from questions to cited sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from docweave.functions import text as tx
from docweave.operators import completion, index, selection, vectors
from docweave.operators.access import Scope, open_scope
from docweave.runtime import lookup_join, materialize

SOURCE_COLUMNS = ["query_id", "slot", "chunk_id", "document_id", "seq", "filename", "page", "paragraph", "score", "content"]

# Order of the relations behind the selected sources; the citation numbers follow it.
RELATIONS = ("selected", "table_row_continuation", "question_literal", "table_header", "continuation")
LATER = 1 << 40


def relation_order():
    return F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("relation"))


@dataclass
class Corpus:
    """Index tables over the searchable chunks: ready, active, with vectors."""

    documents: DataFrame
    chunks: DataFrame
    technical: index.LexicalIndex
    general: index.LexicalIndex
    titles: DataFrame
    vectors: DataFrame


def build_corpus(documents: DataFrame, chunks: DataFrame, make_encoder: Callable = vectors.HashEncoder, keep: bool = True) -> Corpus:
    """Index tables of a corpus, written once for the several searches that read them.

    Titles, file names and row addresses stand for documents that are ready and active only.
    """
    documents = documents.where("status = 'ready' AND lifecycle = 'active'")
    technical = index.build_index(chunks)
    general = index.build_index(chunks, tx.lexical_terms("content"))
    embedded = vectors.embed(chunks.select("chunk_id", "document_id", "content"), "content", make_encoder).drop("content")
    hold = materialize if keep else (lambda df: df)
    for table in (technical, general):
        table.postings = hold(table.postings)
        table.frequencies = hold(index.term_frequencies(table.postings))
        table.stats = hold(table.stats)
    return Corpus(documents, chunks, technical, general, hold(index.filename_index(documents)), hold(embedded))


def hybrid_search(questions: DataFrame, corpus: Corpus, k: int, scope: Scope | None = None, min_score: float | None = None,
                  make_encoder: Callable = vectors.HashEncoder, narrowed: bool = False) -> dict[str, DataFrame]:
    """Semantic, identifier and general channels and their fusion, at most ``k`` rows per question each.

    Questions: query_id, text and optionally previous_question. File names in
    a question narrow its scope, unless the caller's is ``narrowed`` already.
    """
    if not narrowed:
        scope = index.filename_scope(questions, scope or open_scope(questions, corpus.documents), corpus.documents)
    # Written once: the encoder sees every question once, however often its vector is read.
    asked = materialize(vectors.embed(questions.select("query_id", "text"), "text", make_encoder, query=True).drop("text"))
    current = vectors.cosine_topk(asked, corpus.vectors, k, min_score, scope)
    semantic = current
    if "previous_question" in questions.columns:
        earlier = questions.where(F.col("previous_question").isNotNull()).select(
            "query_id", F.concat("previous_question", F.lit("\n"), "text").alias("text"))
        old = materialize(vectors.embed(earlier, "text", make_encoder, query=True).drop("text"))
        history = vectors.cosine_topk(old, corpus.vectors, k, min_score, scope)
        with_history = current.join(earlier.select("query_id"), "query_id", "left_semi")
        fused = vectors.pair_cosine(vectors.history_fusion(with_history, history, k), asked, corpus.vectors)
        plain = current.join(earlier.select("query_id"), "query_id", "left_anti")
        semantic = plain.select("query_id", "chunk_id", "score", "rank").unionByName(fused.select("query_id", "chunk_id", "score", "rank"))
    technical = index.identifier_search(index.identifier_terms(questions), corpus.technical, k, scope, corpus.titles,
                                        index.forced_title_terms(questions))
    general = index.bm25_search(index.or_terms(questions, tx.lexical_terms("text", query=True)), corpus.general, k, scope)
    fused = materialize(vectors.rrf_fuse(semantic, technical, general, k, corpus.vectors))
    return {"questions": asked, "semantic": semantic, "technical": technical, "general": general, "fused": fused}


def candidates(questions: DataFrame, corpus: Corpus, channels: dict[str, DataFrame]) -> DataFrame:
    """Fused hits with text, location and the raw cosine."""
    scored = vectors.pair_cosine(channels["fused"], channels["questions"], corpus.vectors)
    rows = scored.select("query_id", "chunk_id", F.col("rank").cast("long").alias("position"), F.round("score", 4).alias("score"))
    body = corpus.chunks.select("chunk_id", "document_id", "seq", "filename", "page", "paragraph", "content")
    return lookup_join(body, rows, ["chunk_id"]).join(questions.select("query_id", F.col("text").alias("question")), "query_id")


def retrieve(questions: DataFrame, corpus: Corpus, k: int = 3, scope: Scope | None = None, min_score: float | None = None,
             make_encoder: Callable = vectors.HashEncoder, reranked: bool = False, literals: bool = True, continuations: bool = True) -> DataFrame:
    """Cited sources per question: (source columns, relation, source_no, reason).

    Questions that address one table row skip the search. Others run hybrid search over
    min(200, 20 k) candidates, selection and the completion steps. A question without any source
    appears once with a reason and no chunk.
    """
    addressed = completion.row_addresses(questions).select("query_id").distinct()
    searched = questions.join(addressed, "query_id", "left_anti")
    # Every step, not the search alone, keeps to the files a question names.
    scope = index.filename_scope(questions, scope or open_scope(questions, corpus.documents), corpus.documents)
    located = completion.table_row_address(questions, corpus.documents, corpus.chunks, k, scope)
    channels = hybrid_search(searched, corpus, min(200, 20 * k), scope, min_score, make_encoder, narrowed=True)
    # The bounded candidates feed several steps; a checkpoint keeps the search from being repeated.
    found = materialize(candidates(searched, corpus, channels))
    if reranked:
        ordered = vectors.rerank(found)
        chosen = selection.select_ranked(ordered.withColumn("position", F.col("rerank_rank").cast("long")), k)
    else:
        chosen = selection.select_sources(found, k)
    picked = chosen.where(F.col("slot").isNotNull()).select("query_id", "chunk_id", "slot")
    sources = found.join(picked, ["query_id", "chunk_id"]).select(*SOURCE_COLUMNS).unionByName(
        located.select(*SOURCE_COLUMNS[:1], F.col("slot").cast("long").alias("slot"), *SOURCE_COLUMNS[2:]))
    sources = materialize(sources)
    body = corpus.chunks.select("chunk_id", "document_id", "seq", "filename", "page", "paragraph", "content")

    def added(rows: DataFrame, relation: str) -> DataFrame:
        full = lookup_join(body, rows.select("query_id", "chunk_id"), ["chunk_id"])
        return full.select("query_id", F.lit(None).cast("long").alias("slot"), "chunk_id", "document_id", "seq", "filename", "page", "paragraph",
                           F.lit(None).cast("double").alias("score"), "content", F.lit(relation).alias("relation"))

    result = sources.withColumn("relation", F.lit("selected"))
    # A question that addresses a row is answered by its rows; only questions that searched are completed.
    chosen_sources = sources.join(searched.select("query_id"), "query_id", "left_semi")
    result = result.unionByName(added(completion.attach_row_continuation(chosen_sources, corpus.chunks), "table_row_continuation"))
    if literals:
        tokens = materialize(searched.select("query_id", F.posexplode(completion.question_literals("text")).alias("literal_no", "literal")))
        extra = completion.attach_literals(chosen_sources, completion.literal_candidates(tokens, corpus.chunks, scope))
        with_literals = materialize(added(extra, "question_literal"))
        result = result.unionByName(with_literals)
        # Headers follow for questions with a literal, for selected and literal sources, within one joint limit.
        spent = with_literals.groupBy("query_id").agg(F.count(F.lit(1)).alias("_spent"))
        worded = (chosen_sources.join(tokens.select("query_id").distinct(), "query_id", "left_semi")
                  .unionByName(with_literals.withColumn("slot", F.lit(LATER).cast("long")).drop("relation")))
        sheets = worded.where(F.lower("filename").endswith(".xlsx")).select("document_id").distinct()
        headers = completion.attach_table_headers(worded, completion.header_rows(lookup_join(corpus.chunks, sheets, ["document_id"], "left_semi")))
        fitting = headers.join(spent, "query_id", "left").where(F.col("extra_no") + F.coalesce("_spent", F.lit(0)) <= completion.MAX_LITERAL_SOURCES)
        result = result.unionByName(added(fitting, "table_header"))
    result = materialize(result)
    if continuations:
        # Selected sources first, then the attached ones, share one limit.
        order = Window.partitionBy("query_id").orderBy(F.coalesce("slot", F.lit(LATER)), relation_order(), F.col("chunk_id"))
        walked = (result.join(searched.select("query_id"), "query_id", "left_semi").where("relation <> 'table_header'")
                  .withColumn("slot", F.row_number().over(order).cast("long")).drop("relation"))
        going_on = completion.attach_continuations(walked, corpus.chunks)
        result = result.unionByName(going_on.select(
            "query_id", F.lit(None).cast("long").alias("slot"), "chunk_id", "document_id", "seq", "filename", "page", "paragraph", "score",
            "content", F.lit("continuation").alias("relation")))
    first = result.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct(*[c for c in result.columns if c not in ("query_id", "chunk_id")]), F.struct(
        F.coalesce("slot", F.lit(LATER)), relation_order())).alias("_r")).select("query_id", "chunk_id", "_r.*")
    numbered = Window.partitionBy("query_id").orderBy(F.coalesce("slot", F.lit(LATER)), relation_order(), F.col("chunk_id"))
    first = first.withColumn("source_no", F.row_number().over(numbered).cast("long"))
    hit = found.select("query_id").distinct().withColumn("_hit", F.lit(True))
    empty = questions.select("query_id").join(first.select("query_id").distinct(), "query_id", "left_anti").join(hit, "query_id", "left")
    reasons = empty.select("query_id", F.when(F.col("_hit").isNull(), "no_hits").otherwise("no_selected").alias("reason"))
    return first.withColumn("reason", F.lit(None).cast("string")).unionByName(reasons, allowMissingColumns=True)

