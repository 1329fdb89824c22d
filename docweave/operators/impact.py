"""Top-k BM25 over impact blocks: exact results without reading the postings that cannot reach them.

A posting carries no count, so the share of a term in a chunk is its weight times a factor that falls with the
chunk's length. The postings of a term are therefore cut into blocks of similar length, shortest first; a block
has a shortest length, hence an upper bound of its factor, and knows how many postings it holds.

Order the terms of a question by weight, heaviest first. A chunk of n terms whose first matching term in this order
is t gets at most its factor times the sum of n weights from t on. So, given a score that k chunks are known to
reach, only blocks of t count whose factor times that sum comes up to it: of light terms usually none. A first round
reads the shortest chunks of the heaviest terms, the second the blocks that are left; after each the chunks that
collected most are scored from their own terms in a forward table, and the k-th of them is the next known score. At
one length the blocks of the second round are those of the heaviest terms up to some turn, so what a chunk
collected in them and the heaviest weights behind that turn that it still has room for bound its score: only chunks
that may reach the known one are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweave.functions import text as tx
from docweave.operators.index import B, K1, LexicalIndex, top_per_query, weighted_terms
from docweave.runtime import BROADCAST_LIMIT_BYTES, broadcast_if_small, computed, estimated_bytes, materialize, salted_join

# Block lengths: exact up to 16, then steps of a fifth.
EXACT_LENGTHS, STEP = 16, 1.2
# Postings that the first round reads, times k.
FIRST_ROUND = 60
# Chunks that are scored for a known score, times k.
SCORED = 5
# Scores are ranked by nine digits; bounds must not fail by rounding.
SLACK = 1e-6


@dataclass
class ImpactIndex:
    """postings(term, level, document_id, chunk_id, length), blocks(term, level, n), forward(chunk_id, document_id, length, terms), and the lexical statistics."""

    postings: DataFrame
    blocks: DataFrame
    forward: DataFrame
    lexical: LexicalIndex


def level(length: Column) -> Column:
    above = F.floor(F.log(length / EXACT_LENGTHS) / F.log(F.lit(STEP))).cast("int") + EXACT_LENGTHS + 1
    return F.when(length <= EXACT_LENGTHS, length.cast("int")).otherwise(above)


def build_impact_index(chunks: DataFrame, terms: Column | None = None) -> ImpactIndex:
    """Impact index of ready chunks. The forward table is written once and the postings and blocks come from it."""
    rows = chunks.select("chunk_id", "document_id", "content")
    if terms is None:
        rows = computed(rows, "_own", tx.technical_terms("content"))
        terms = tx.expand_terms("_own", "content")
    forward = materialize(computed(rows, "terms", terms).select("chunk_id", "document_id", F.size("terms").cast("long").alias("length"), "terms"))
    postings = materialize(forward.select(F.explode("terms").alias("term"), level(F.col("length")).alias("level"), "document_id", "chunk_id", "length"))
    blocks = materialize(postings.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n")))
    frequencies = materialize(blocks.groupBy("term").agg(F.sum("n").alias("df")))
    stats = materialize(forward.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("length").alias("avg_length")))
    return ImpactIndex(postings, blocks, forward, LexicalIndex(postings.drop("level"), frequencies, stats))


def shortest(level: Column) -> Column:
    """No chunk of the level is shorter."""
    return F.when(level <= EXACT_LENGTHS, level.cast("double")).otherwise(EXACT_LENGTHS * F.pow(F.lit(STEP), level - EXACT_LENGTHS - 1) - SLACK)


def factor(length: Column, average: float) -> Column:
    return (K1 + 1) / (1 + K1 * (1 - B + B * length / average))


def longest(level: Column) -> Column:
    """No chunk of the level has more terms."""
    return F.when(level <= EXACT_LENGTHS, level).otherwise(F.floor(EXACT_LENGTHS * F.pow(F.lit(STEP), level - EXACT_LENGTHS) + SLACK).cast("int"))


def total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda held, weight: held + weight)


def question_blocks(weights: DataFrame, index: ImpactIndex, average: float) -> DataFrame:
    """(query_id, term, idf, turn, level, n, bound): blocks of each question's terms and the most that chunks can score whose first matching term they hold."""
    ordered = weights.select("query_id", "term", "idf", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("idf").desc(), "term")).alias("turn"))
    ordered = ordered.join(heaviest_first(weights), "query_id")
    met = index.blocks.join(broadcast_if_small(materialize(ordered)), "term")
    rest = total(F.slice("weights", F.col("turn"), longest(F.col("level"))))
    return met.select("query_id", "term", "idf", "turn", "level", "n", (factor(shortest(F.col("level")), average) * rest).alias("bound"))


def heaviest_first(weights: DataFrame) -> DataFrame:
    """(query_id, weights) with a question's weights in falling order."""
    return weights.groupBy("query_id").agg(F.sort_array(F.collect_list("idf"), asc=False).alias("weights"))


def collected(asked: DataFrame, weights: DataFrame, index: ImpactIndex, average: float) -> DataFrame:
    """(query_id, chunk_id, low, high): the share that a chunk collects in the asked blocks, and the most it can have with all other terms."""
    behind = 1 + F.max("turn").over(Window.partitionBy("query_id", "level"))
    asked = materialize(asked.select("query_id", "term", "level", "idf", behind.alias("behind")))
    if estimated_bytes(asked, *asked.columns) <= BROADCAST_LIMIT_BYTES:
        met = index.postings.join(F.broadcast(asked), ["term", "level"])
    else:
        met = salted_join(index.postings, asked, ["term", "level"], "inner", "chunk_id")
    held = (met.groupBy("query_id", "chunk_id", "length").agg(F.sum("idf").alias("seen"), F.count(F.lit(1)).cast("int").alias("matched"), F.first("behind").alias("behind"))
            .join(broadcast_if_small(materialize(heaviest_first(weights))), "query_id"))
    share = factor(F.col("length"), average)
    room = (F.col("length") - F.col("matched")).cast("int")
    light = total(F.slice("weights", F.col("behind"), room))
    return materialize(held.select("query_id", "chunk_id", (share * F.col("seen")).alias("low"), (share * (F.col("seen") + light)).alias("high")))


def score(pairs: DataFrame, weights: DataFrame, index: ImpactIndex, average: float) -> DataFrame:
    """(query_id, chunk_id, document_id, score) of pairs, from the chunk's own terms."""
    pairs = materialize(pairs.select("query_id", "chunk_id"))
    found = index.forward.join(broadcast_if_small(pairs), "chunk_id")
    terms = found.select("query_id", "chunk_id", "document_id", "length", F.explode("terms").alias("term"))
    return (terms.join(broadcast_if_small(weights.select("query_id", "term", "idf")), ["query_id", "term"])
            .groupBy("query_id", "chunk_id", "document_id").agg(F.sum(F.col("idf") * factor(F.col("length"), average)).alias("score")))


def known_score(met: DataFrame, weights: DataFrame, index: ImpactIndex, k: int, average: float) -> DataFrame:
    """(query_id, least): the k-th score among the chunks that collected most; questions with fewer chunks have none."""
    likely = top_per_query(met, SCORED * k, F.col("low").desc(), F.col("chunk_id"))
    known = top_chunks(score(likely, weights, index, average), k)
    least = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("least")).where(F.col("held") == k)
    return broadcast_if_small(materialize(least.select("query_id", (F.col("least") - SLACK).alias("least"))))


def reaching(rows: DataFrame, bound: str, least: DataFrame) -> DataFrame:
    """Rows whose bound comes up to the known score of their question."""
    return rows.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col(bound) >= F.col("least"))).drop("least")


def plan_blocks(weights: DataFrame, index: ImpactIndex, k: int, average: float) -> DataFrame:
    """The blocks that each question has to read after the first round."""
    blocks = materialize(question_blocks(weights, index, average))
    before = Window.partitionBy("query_id").orderBy("turn", "level").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.withColumn("read", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("read") < FIRST_ROUND * k)
    return reaching(blocks, "bound", known_score(collected(first, weights, index, average), weights, index, k, average))


def top_chunks(scored: DataFrame, k: int) -> DataFrame:
    return top_per_query(scored, k, F.round("score", 9).desc(), F.col("chunk_id"))


def block_max_search(terms: DataFrame, index: ImpactIndex, k: int) -> DataFrame:
    """OR search: (query_id, chunk_id, document_id, score, rank), the rows of ``bm25_search`` without a scope.

    A question without known terms has no rows. Equal scores go by chunk id.
    """
    average = index.lexical.stats.first()["avg_length"] or 1.0
    weights = materialize(weighted_terms(terms, index.lexical))
    met = collected(plan_blocks(weights, index, k, average), weights, index, average)
    left = reaching(met, "high", known_score(met, weights, index, k, average))
    return top_chunks(score(left, weights, index, average), k)


def postings_read(terms: DataFrame, index: ImpactIndex, k: int) -> DataFrame:
    """(query_id, read, held): postings in the blocks that the second round reads, and in all blocks of the question's terms."""
    average = index.lexical.stats.first()["avg_length"] or 1.0
    weights = materialize(weighted_terms(terms, index.lexical))
    read = plan_blocks(weights, index, k, average).groupBy("query_id").agg(F.sum("n").alias("read"))
    return question_blocks(weights, index, average).groupBy("query_id").agg(F.sum("n").alias("held")).join(read, "query_id")
