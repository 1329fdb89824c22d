"""Postings, BM25 statistics and lexical search for whole tables of questions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docweave.functions import text as tx
from docweave.operators.access import Scope
from docweave.operators.units import parse_rows
from docweave.runtime import BROADCAST_LIMIT_BYTES, bounded_slices, computed, estimated_bytes, lookup_join, materialize, salted_join

K1, B = 1.2, 0.75
MAX_ATTACHED_PAIRS = 4096
# Scored rows that one task sums up in memory.
TASK_HITS = 4_000_000
# Postings whose chunks a task compares with sets of terms at once.
TASK_ROWS = 200_000
# Figures of terms by questions, and of postings by questions, that a task holds at once.
MAX_GRID = 1 << 22
# Labels that make the first sheet row a header, and the log intent of the alias rule.
HEADER_ROLES = ("type", "input", "precondition", "测试项", "前置条件", "测试步骤", "测试步骤-输入", "期望回复")
LOG_INTENT_WORD, LOG_INTENT_TERM, LOG_TERM = "日志", "e84", "log"
# How a question names, negates or produces a file.
FILE_EXTENSION = r"\.(?:pdf|docx?|xlsx|txt|md)"
FILE_NAME = r'[^=《》“”"`，,；;：:?？\n]+?' + FILE_EXTENSION
MENTION_WORDS = "(?:仅)?(?:根据|依据|按|在|参考|对照|与|和|及)"
FILE_MENTION = (
    r"《(" + FILE_NAME + r")》|"
    r'(?:' + MENTION_WORDS + r'\s*)[《“"`]?(' + FILE_NAME + r')[》”"`]?(?![a-z0-9_.-])|'
    r'^[“"`](' + FILE_NAME + r')[”"`](?=\s*(?:中|里|内|的|与|和|及))|'
    r"^([a-z0-9][^=《》“”\"`，,；;：:?？\n]*?" + FILE_EXTENSION + r")(?=\s*(?:中|里|内|的|与|和|及))")
OUTPUT_BEFORE = r"(?:文件名|路径|示例字符串)\s*(?:设(?:置)?为|是|为|=)|(?:保存|另存|命名)为"
OUTPUT_AFTER = r"\s*这个字符串"
NEGATED_BEFORE = r"(?:不|勿|别|不是|不要|排除|除了|而非|\bnot)(?:按|用|依据|参考|根据|对照|以)?\s*$"
NEGATED_AFTER = r"\s*(?:不要(?:按|用|参考|根据|依据)|别(?:按|用|参考)|不(?:用|作为|参考)|除外)"


@dataclass
class LexicalIndex:
    """postings(term, document_id, chunk_id, length), frequencies(term, df), stats(n_chunks, avg_length)."""

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame


def build_index(chunks: DataFrame, terms: Column | None = None) -> LexicalIndex:
    """Index of ready chunks; terms are distinct per chunk, so a posting carries no count."""
    rows = chunks.select("chunk_id", "document_id", "content")
    if terms is None:
        rows = computed(rows, "_own", tx.technical_terms("content"))
        terms = tx.expand_terms("_own", "content")
    rows = computed(rows, "_terms", terms)
    postings = rows.select("chunk_id", "document_id", F.size("_terms").cast("long").alias("length"),
                           F.explode("_terms").alias("term"))
    frequencies = term_frequencies(postings)
    stats = rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size("_terms")).alias("avg_length"))
    return LexicalIndex(postings, frequencies, stats)


def term_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def write_postings(index: LexicalIndex, path: str, buckets: int = 512, spread: int = 8) -> None:
    """Postings partitioned by term bucket and sorted by term.

    A search reads only the buckets of its terms, and row-group statistics skip other terms. The
    spread key cuts a hot term into several files.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    (index.postings.withColumn("term_bucket", bucket)
     .repartition("term_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(spread)))
     .sortWithinPartitions("term_bucket", "term", "chunk_id")
     .write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/postings"))
    index.frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_postings(spark, path: str) -> LexicalIndex:
    return LexicalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/frequencies"),
                        spark.read.parquet(f"{path}/stats"))


# --- query terms and scope ------------------------------------------------------------------


def apply_alias_rules(text, terms) -> Column:
    """Log questions about one protocol: the timer family replaces its stem and ``log`` is added."""
    text, terms = tx.as_column(text), tx.as_column(terms)
    renamed = F.transform(terms, lambda t: F.when(t == "tp", F.lit(tx.TIMER_ALIAS)).otherwise(t))
    return F.when(log_intent(text, terms), F.array_union(renamed, F.array(F.lit(LOG_TERM)))).otherwise(terms)


def log_intent(text, terms) -> Column:
    return tx.as_column(text).contains(LOG_INTENT_WORD) & F.array_contains(tx.as_column(terms), LOG_INTENT_TERM)


def identifier_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term) of all identifiers of the questions."""
    return questions.select("query_id", F.explode(apply_alias_rules("text", tx.technical_terms("text"))).alias("term"))


def or_terms(questions: DataFrame, terms: Column) -> DataFrame:
    """(query_id, term) of all distinct terms of the questions."""
    return questions.select("query_id", F.explode(F.array_distinct(terms)).alias("term"))


def in_scope(hits: DataFrame, scope: Scope | None) -> DataFrame:
    return hits if scope is None else scope.keep(hits)


def weighted_terms(terms: DataFrame, index: LexicalIndex) -> DataFrame:
    """Adds the index-wide inverse document frequency, floored when it is not positive."""
    n = index.stats.select("n_chunks").scalar()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return lookup_join(index.frequencies, terms, ["term"]).select(
        "query_id", "term", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"), "df")


def term_hits(terms: DataFrame, index: LexicalIndex, scope: Scope | None = None) -> DataFrame:
    """One scored row per (question, chunk, term).

    Postings are pruned to the asked terms and placed by chunk before they meet the questions. With
    question weights of proven small size the join is a broadcast, so the sums per chunk and the best
    hits per question need no further shuffle of the hits. There are many more hits than postings, so
    it is the hits that say how many tasks hold them without spilling. Larger weights meet the postings
    by term, with the postings of a hot term spread over salts.
    """
    met = _meeting(terms, index, scope)
    kept = ["query_id", "chunk_id", "document_id", "term", "share"]
    if met.small:
        joined = met.postings.join(F.broadcast(met.weights.drop("df")), "term")
    else:
        joined = salted_join(met.postings, met.weights, ["term"], "inner", "chunk_id", measured=True)
    if met.attached:
        joined = joined.where(scope.allows())
    average = index.stats.select("avg_length").scalar()
    share = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("length") / average))
    hits = joined.withColumn("share", share).select(*kept)
    return hits if met.attached else in_scope(hits, scope)


@dataclass
class _Meeting:
    """Question weights and the postings they ask for; ``small`` postings are pruned and placed by chunk, ``attached`` ones carry their scope."""

    weights: DataFrame
    postings: DataFrame
    small: bool
    attached: bool


def _meeting(terms: DataFrame, index: LexicalIndex, scope: Scope | None) -> _Meeting:
    weights = weighted_terms(terms, index)
    postings = index.postings
    # A document with few explicit pairs carries them; otherwise the pairs are joined with the hits.
    attached = scope is not None and scope.pairs_per_document() <= MAX_ATTACHED_PAIRS
    if attached:
        weights = weights.join(scope.queries, "query_id")
    weights = materialize(weights)
    small = estimated_bytes(weights) <= BROADCAST_LIMIT_BYTES
    if small:
        postings = postings.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi")
    if attached:
        # The scope joins the pruned postings, not the much larger hits.
        postings = scope.attach(postings)
    if small:
        expected = weights.agg(F.sum("df").alias("n")).first()["n"] or 0
        tasks = max(postings.sparkSession.sparkContext.defaultParallelism, math.ceil(expected / TASK_HITS))
        postings = postings.repartition(tasks, "chunk_id")
    return _Meeting(weights, postings, small, attached)


def _best_in_tasks(met: _Meeting, average: float, k: int):
    """Scores of whole chunks and the best ``k`` of every question in a task.

    A task reads its postings chunk by chunk, in ascending order, and adds up a row of the weight table for each, so the
    hits are never rows. A later chunk of an equal score loses, as in the ranking.
    """
    found = met.weights.select("query_id", "term", "idf", *(["see_all", "has_request"] if met.attached else [])).collect()
    questions = list(dict.fromkeys(r["query_id"] for r in found))
    place = {q: i for i, q in enumerate(questions)}
    row_of = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for r in found))}
    table = np.zeros((len(row_of), len(questions)))
    see_all, has_request = np.zeros(len(questions), dtype=bool), np.zeros(len(questions), dtype=bool)
    for r in found:
        table[row_of[r["term"]], place[r["query_id"]]] += r["idf"]
        if met.attached:
            see_all[place[r["query_id"]]], has_request[place[r["query_id"]]] = r["see_all"], r["has_request"]
    shared = met.postings.sparkSession.sparkContext.broadcast((questions, place, row_of, table, see_all, has_request))
    attached = met.attached

    def scored(rows: pa.Table, best: dict, least: np.ndarray) -> None:
        questions, place, row_of, table, see_all, has_request = shared.value
        chunk, document = rows["chunk_id"], rows["document_id"]
        keys = [np.asarray(column.is_null()) for column in (chunk, document)] + [np.asarray(column.fill_null(0)) for column in (chunk, document)]
        first = np.flatnonzero(np.r_[True, np.any([key[1:] != key[:-1] for key in keys], axis=0)])
        factor = (K1 + 1) / (1 + K1 * (1 - B + B * np.asarray(rows["length"]) / average))
        at = np.array([row_of[t] for t in rows["term"].to_pylist()])
        lists = {name: rows[name].take(pa.array(first)).to_pylist() for name in ("granted", "requested")} if attached else {}
        open_to_all = np.asarray(rows["shared"].take(pa.array(first)).fill_null(False)) if attached else None
        for start in range(0, len(questions), width := max(1, MAX_GRID // max(1, len(at)))):
            held = slice(start, start + width)
            sums = np.add.reduceat(table[at, held] * factor[:, None], first, axis=0)
            good = sums > 0
            if attached:
                visible, wanted = open_to_all[:, None] | see_all[held], np.repeat(~has_request[None, held], len(first), axis=0)
                for target, name in ((visible, "granted"), (wanted, "requested")):
                    for i, members in enumerate(lists[name]):
                        if members:
                            target[i, [p for p in (place.get(q, -1) - start for q in members) if 0 <= p < sums.shape[1]]] = True
                good &= visible & wanted
            rounded = np.round(sums, 9)
            good &= rounded > least[held]
            for q in np.flatnonzero(good.any(axis=0)):
                own = np.flatnonzero(good[:, q])
                parts = [rounded[own, q], sums[own, q], *(key[first[own]] for key in keys)]
                old = best.get(start + q)
                parts = parts if old is None else [np.concatenate(pair) for pair in zip(old, parts)]
                top = np.argsort(-parts[0], kind="stable")[:k]
                best[start + q] = [part[top] for part in parts]
                if len(top) == k:
                    least[start + q] = parts[0][top[-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = shared.value[0]
        best, least, waiting = {}, np.full(len(questions), -np.inf), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            rows = rows.combine_chunks()
            # The last chunk may go on in the next batch.
            missing, ids = np.asarray(rows["chunk_id"].is_null()), np.asarray(rows["chunk_id"].fill_null(0))
            cut = int(np.argmax((missing == missing[-1]) & (ids == ids[-1])))
            waiting = rows.slice(cut)
            if cut:
                scored(rows.slice(0, cut).combine_chunks(), best, least)
        if waiting is not None:
            scored(waiting, best, least)
        for q, (_, score, no_chunk, no_document, chunk, document) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([questions[q]] * len(score), pa.int64()), pa.array(chunk, pa.int64(), mask=no_chunk),
                                              pa.array(document, pa.int64(), mask=no_document), pa.array(score)],
                                             names=["query_id", "chunk_id", "document_id", "score"])

    return run


def top_per_query(hits: DataFrame, k: int, *order: Column, name: str = "rank") -> DataFrame:
    """Best ``k`` per question; the window limit prunes map-side before the shuffle."""
    window = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)




def bm25_search(terms: DataFrame, index: LexicalIndex, k: int, scope: Scope | None = None) -> DataFrame:
    """OR search: (query_id, chunk_id, document_id, score, rank).

    While a table of terms by questions is small, tasks sum up whole chunks and emit their best; otherwise hits are grouped.
    """
    met = _meeting(terms, index, scope)
    size = met.weights.agg(F.count_distinct("term").alias("t"), F.count_distinct("query_id").alias("q")).first()
    kinds = [met.weights.schema["query_id"].dataType, *(index.postings.schema[c].dataType for c in ("chunk_id", "document_id"))]
    if met.small and size["t"] * size["q"] <= MAX_GRID and (scope is None or met.attached) and all(kind == T.LongType() for kind in kinds):
        columns = ["chunk_id", "document_id", "term", "length", *(["shared", "granted", "requested"] if met.attached else [])]
        rows = met.postings.select(*columns).sortWithinPartitions("chunk_id", "document_id")
        average = index.stats.select("avg_length").first()["avg_length"] or 1.0
        scored = rows.mapInArrow(_best_in_tasks(met, average, k), "query_id long, chunk_id long, document_id long, score double")
    else:
        scored = term_hits(terms, index, scope).groupBy("query_id", "chunk_id", "document_id").agg(F.sum("share").alias("score"))
    return top_per_query(scored, k, F.round("score", 9).desc(), F.col("chunk_id"))


def filename_index(documents: DataFrame) -> DataFrame:
    """(document_id, term) of the file names."""
    return documents.select("document_id", F.explode(tx.filename_terms("filename")).alias("term"))


def live_terms(hits: DataFrame) -> DataFrame:
    """Terms with at least one posting in scope, per question."""
    return hits.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("_n")).select("query_id", "term")


def live_question_terms(terms: DataFrame, index: LexicalIndex, scope: Scope | None = None) -> DataFrame:
    """(query_id, term) of the terms with at least one posting in scope. Every known term has a posting, so only a scope can
    make it die; without one no hit is listed."""
    if scope is None:
        return weighted_terms(terms, index).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("_n")).select("query_id", "term")
    return live_terms(term_hits(terms, index, scope))


def _title_hits(terms: DataFrame, titles: DataFrame, scope: Scope | None) -> DataFrame:
    hits = salted_join(titles, terms.select("query_id", "term"), ["term"], "inner", "document_id")
    return in_scope(hits, scope)


def broad_title_questions(live: DataFrame, titles: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Questions whose live terms are all contained in more than one document title."""
    needed = live.groupBy("query_id").agg(F.count(F.lit(1)).alias("_need"))
    full = (_title_hits(live, titles, scope).groupBy("query_id", "document_id").agg(F.count(F.lit(1)).alias("_have"))
            .join(needed, "query_id").where(F.col("_have") == F.col("_need")))
    return full.groupBy("query_id").agg(F.count(F.lit(1)).alias("titles")).where(F.col("titles") > 1)


def _repeated(weights: DataFrame, index: LexicalIndex, scope: Scope | None) -> bool:
    """Whether a question repeats a term or a chunk comes twice, so that a hit counts more than once."""
    twice = [weights.groupBy("query_id", "term").count().where("count > 1"),
             index.postings.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length")).where("chunk_id IS NULL OR n > length")]
    if scope is not None:
        twice += [scope.queries.groupBy("query_id").count().where("count > 1"), scope.documents.groupBy("document_id").count().where("count > 1")]
        twice += [pairs.groupBy("query_id", "document_id").count().where("count > 1") for pairs in (scope.granted, scope.requested)]
    return any(rows.limit(1).count() for rows in twice)


def _sets_in_tasks(sets: DataFrame, average: float):
    """Rows (_set, chunk_id, document_id, score) of the sets whose terms all stand in one chunk, from postings in the order of chunks.

    The postings of the rarest term of a set are its candidates; the other terms are looked up among those of the same chunk.
    """
    held = sets.select("_set", "_idf", "term", "_others").toArrow().combine_chunks()
    others = held["_others"].combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.string()))
    names = pc.unique(pa.chunked_array([held["term"].combine_chunks().cast(pa.string()), others.flatten().cast(pa.string())]))
    rare = np.asarray(pc.index_in(held["term"].cast(pa.string()), value_set=names)).astype(np.int64)
    order = np.argsort(rare, kind="stable")
    counts = np.bincount(rare, minlength=len(names))
    sizes = np.asarray(pc.list_value_length(others)).astype(np.int64)
    ids, idf = np.asarray(held["_set"]), np.asarray(held["_idf"])
    shared = sets.sparkSession.sparkContext.broadcast((
        names, counts, np.cumsum(counts) - counts, order, sizes, np.cumsum(sizes) - sizes,
        np.asarray(pc.index_in(others.flatten().cast(pa.string()), value_set=names)).astype(np.int64), ids, idf))

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names, counts, starts, order, sizes, first_other, others, ids, idf = shared.value
        words = rows["term"].combine_chunks().dictionary_encode()
        known = np.asarray(pc.fill_null(pc.index_in(words.dictionary.cast(pa.string()), value_set=names), -1))
        term = known[np.asarray(pc.fill_null(words.indices, 0))] if len(known) else np.full(rows.num_rows, -1)
        asked = np.flatnonzero(term >= 0)
        if not len(asked):
            return
        chunk = np.asarray(rows["chunk_id"].combine_chunks().dictionary_encode().indices).astype(np.int64)
        codes = np.sort(chunk[asked] * len(names) + term[asked])
        weight = 1 + K1 * (1 - B + B * np.asarray(rows["length"]) / average)
        asked = asked[counts[term[asked]] > 0]
        cost = np.cumsum(counts[term[asked]])
        for part in np.split(asked, np.flatnonzero(np.diff(cost // TASK_HITS)) + 1):
            many = counts[term[part]]
            at = np.repeat(part, many)
            own = order[np.repeat(starts[term[part]] - (np.cumsum(many) - many), many) + np.arange(len(at))]
            number = 0
            while (open_ := sizes[own] > number).any():
                wanted = chunk[at[open_]] * len(names) + others[first_other[own[open_]] + number]
                place = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
                kept = np.ones(len(own), dtype=bool)
                kept[open_] = codes[place] == wanted
                at, own, number = at[kept], own[kept], number + 1
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), *(rows[c].combine_chunks().take(pa.array(at)) for c in ("chunk_id", "document_id")), pa.array(idf[own] * (K1 + 1) / weight[at])],
                    names=["_set", "chunk_id", "document_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                held += batch.num_rows
            if held >= TASK_ROWS:
                rows = pa.Table.from_batches(waiting)
                # The last chunk may go on in the next batch.
                same = np.asarray(pc.equal(rows["chunk_id"], rows["chunk_id"][-1]))
                cut = rows.num_rows - int(same.sum())
                yield from found(rows.slice(0, cut))
                waiting, held = rows.slice(cut).to_batches(), 0
        if waiting:
            yield from found(pa.Table.from_batches(waiting))

    return run


def _full_hits(weights: DataFrame, index: LexicalIndex, k: int, scope: Scope | None) -> DataFrame:
    """(query_id, chunk_id, document_id, score) of chunks that hold all terms of a question; without a scope the best ``k``.

    Questions of the same terms are searched once. The sets of terms travel to the postings in slices of bounded size, so
    postings are placed by chunk once and candidates are never rows.
    """
    asked = weights.groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("_names"), F.sum("idf").alias("_idf"),
                                            F.min_by("term", F.struct("df", "term")).alias("term"))
    sets = materialize(asked.groupBy("_names").agg(F.min("term").alias("term"), F.min("_idf").alias("_idf"))
                       .select("term", "_names", "_idf", F.array_except("_names", F.array("term")).alias("_others"), F.monotonically_increasing_id().alias("_set")))
    asked = materialize(asked.select("query_id", "_names").join(sets.select("_names", "_set"), "_names").select("query_id", "_set"))
    wanted = materialize(weights.groupBy("term").agg(F.max("df").alias("df")))
    postings = index.postings.select("chunk_id", "document_id", "term", "length")
    if estimated_bytes(wanted, "term") <= BROADCAST_LIMIT_BYTES:
        postings = postings.join(F.broadcast(wanted.select("term")), "term", "left_semi")
    expected = wanted.agg(F.sum("df").alias("n")).first()["n"] or 0
    tasks = max(postings.sparkSession.sparkContext.defaultParallelism, math.ceil(expected / TASK_HITS))
    placed = postings.repartition(tasks, "chunk_id").sortWithinPartitions("chunk_id")
    average = index.stats.select("avg_length").first()["avg_length"] or 1.0
    kinds = {c: placed.schema[c].dataType.simpleString() for c in ("chunk_id", "document_id")}
    row = f"_set long, chunk_id {kinds['chunk_id']}, document_id {kinds['document_id']}, score double"
    full = None
    for part in bounded_slices(sets, "_set", "_set", "_idf", "term", "_others"):
        met = placed.mapInArrow(_sets_in_tasks(part, average), row)
        full = met if full is None else full.unionByName(met)
    if scope is None:
        best = Window.partitionBy("_set").orderBy(F.round("score", 9).desc(), F.col("chunk_id"))
        full = full.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).drop("_rank")
    found = full.join(asked, "_set").select("query_id", "chunk_id", "document_id", "score")
    return materialize(found if scope is None else scope.keep(found))


def _hits_of_documents(pairs: DataFrame, weights: DataFrame, index: LexicalIndex) -> DataFrame:
    """Scored hits of the questions in the documents paired with them."""
    share = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("length") / index.stats.select("avg_length").scalar()))
    asked = pairs.join(weights.select("query_id", "term", "idf"), "query_id")
    return index.postings.join(asked, ["document_id", "term"]).select("query_id", "chunk_id", "document_id", "term", share.alias("share"))


def identifier_search(terms: DataFrame, index: LexicalIndex, k: int, scope: Scope | None = None,
                      titles: DataFrame | None = None, forced_title: DataFrame | None = None) -> DataFrame:
    """AND search over live identifiers, with the title guard and the title fallback.

    Without ``titles`` this is the plain AND search. ``forced_title`` adds (query_id, term) pairs
    that must be in the document title.
    """
    weights = materialize(weighted_terms(terms, index))
    if _repeated(weights, index, scope):
        # The hits feed the liveness test, the AND search and the fallback.
        hits = materialize(term_hits(terms, index, scope))
        live = materialize(live_terms(hits))
        needed = live.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_live"))
        per_chunk = hits.groupBy("query_id", "chunk_id", "document_id").agg(
            F.count(F.lit(1)).alias("_have"), F.sum("share").alias("score"))
        full = per_chunk.join(needed, "query_id").where(F.col("_have") == F.col("n_live")).select(
            "query_id", "chunk_id", "document_id", "score")
    else:
        # Hits are counted, never written.
        live = materialize(weights.select("query_id", "term") if scope is None else live_question_terms(terms, index, scope))
        needed = live.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_live"))
        full = _full_hits(weights.join(live, ["query_id", "term"], "left_semi"), index, k, scope)
        hits = None
    if titles is None:
        return top_per_query(full, k, F.round("score", 9).desc(), F.col("chunk_id"))

    broad = broad_title_questions(live, titles, scope)
    full = full.join(broad, "query_id", "left_anti")
    title_hits = materialize(_title_hits(terms, titles, scope))
    only = title_hits.join(live, ["query_id", "term"], "left_anti").select("query_id", "term").distinct()
    if forced_title is not None:
        only = only.unionByName(forced_title.select("query_id", "term")).distinct()
    only_count = only.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_only"))
    found = full.groupBy("query_id").agg(F.count(F.lit(1)).alias("_found"))
    # Questions that use the fallback: a term only titles hold, or several live terms without a full hit.
    wanting = (needed.join(only_count, "query_id", "left").join(found, "query_id", "left")
               .join(broad.select("query_id", F.lit(True).alias("_broad")), "query_id", "left")
               .select("query_id", "n_live", F.coalesce("n_only", F.lit(0)).alias("n_only"),
                       (F.col("_found").isNull() & F.col("_broad").isNull() & (F.col("n_live") >= 2)).alias("_bare"))
               .where(F.col("_bare") | (F.col("n_only") > 0)))
    live_titles = title_hits.join(live, ["query_id", "term"], "left_semi").select("query_id", "document_id", "term", F.lit(1).alias("_live"), F.lit(0).alias("_only"))
    only_titles = _title_hits(only, titles, scope).select("query_id", "document_id", "term", F.lit(0).alias("_live"), F.lit(1).alias("_only"))
    eligible = (live_titles.unionByName(only_titles).groupBy("query_id", "document_id")
                .agg(F.sum("_live").alias("_titled"), F.sum("_only").alias("_onlys"))
                .join(wanting, "query_id")
                .where(F.col("_onlys") == F.col("n_only"))
                .withColumn("n_required", F.col("n_live") - F.col("_titled"))
                .where((F.col("n_required") > 0) & ((F.col("_titled") > 0) | (F.col("n_only") > 0)))
                .select("query_id", "document_id", "n_live", "n_required"))
    if hits is None:
        hits = _hits_of_documents(eligible.select("query_id", "document_id"), weights, index)
    marked = (hits.join(eligible, ["query_id", "document_id"])
              .join(live_titles.select("query_id", "document_id", "term", F.lit(True).alias("_in_title")),
                    ["query_id", "document_id", "term"], "left"))
    body = F.col("_in_title").isNull()
    weak = (marked.groupBy("query_id", "chunk_id", "document_id", "n_live", "n_required")
            .agg(F.count_if(body).alias("_body"), F.sum(F.when(body, F.col("share")).otherwise(F.lit(0.0))).alias("_body_score"),
                 F.count(F.lit(1)).alias("_all"), F.sum("share").alias("_all_score")))
    is_full = F.col("_all") == F.col("n_live")
    # Written once: the postings are not read again for the questions it answers.
    fallback = materialize(weak.where(F.col("_body") == F.col("n_required")).select(
        "query_id", "chunk_id", "document_id", is_full.alias("_full"), "n_required",
        F.when(is_full, F.col("_all_score")).otherwise(F.col("_body_score")).alias("score")))
    replaced = fallback.select("query_id").distinct()
    plain = full.join(replaced, "query_id", "left_anti").select(
        "query_id", "chunk_id", "document_id", F.lit(True).alias("_full"), F.lit(0).cast("long").alias("n_required"), "score")
    merged = plain.unionByName(fallback)
    best = top_per_query(merged, k, F.col("_full").desc(),
                         F.when(F.col("_full"), F.lit(0)).otherwise(F.col("n_required")).desc(),
                         F.round("score", 9).desc(), F.col("chunk_id"))
    return best.select("query_id", "chunk_id", "document_id", "score", "rank")


def forced_title_terms(questions: DataFrame) -> DataFrame:
    """The alias rule also demands its two terms in the title."""
    terms = tx.technical_terms("text")
    return questions.where(log_intent("text", terms)).select(
        "query_id", F.explode(F.array(F.lit(LOG_INTENT_TERM), F.lit(LOG_TERM))).alias("term"))


# --- file names in questions ----------------------------------------------------------------


def filename_mentions(text) -> Column:
    """File names a question refers to as sources, sorted; negated and output names do not count.

    Every mention is put between marks, so that splitting at them leaves what stands between the mentions at even
    places and the mentions at odd ones; a mention is then judged by the text before and after it.
    """
    folded = F.trim(F.regexp_replace(F.lower(F.coalesce(tx.as_column(text), F.lit(""))), r"(?U)[\s\x01]+", " "))
    parts = F.split(F.regexp_replace(folded, f"(?U){FILE_MENTION}", "\u0001$0\u0001"), "\u0001")

    def judged(place: Column) -> Column:
        mention = F.get(parts, place)
        before, after = F.array_join(F.slice(parts, 1, place), ""), F.array_join(F.slice(parts, place + 2, F.size(parts)), "")
        clause = F.concat(F.element_at(F.split(before, r"[，,；;。！？?!]"), -1), mention)
        produced = clause.rlike(OUTPUT_BEFORE) | after.rlike(f"(?U)^{OUTPUT_AFTER}")
        negated = before.rlike(f"(?U){NEGATED_BEFORE}") | after.rlike(f"(?U)^{NEGATED_AFTER}")
        bare = F.regexp_replace(mention, "^(?:" + MENTION_WORDS + r")?\s*[《“\"`]?|[》”\"`]$", "")
        return F.when(~produced & ~negated, F.trim(bare))

    places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(places, judged))))


def filename_scope(questions: DataFrame, scope: Scope, documents: DataFrame) -> Scope:
    """Narrow the scope of questions that name files.

    A question that names an unknown or invisible file keeps nothing, it never falls back.
    """
    names = documents.select("document_id", tx.normal_filename("filename").alias("name"))
    wanted = questions.select("query_id", filename_mentions("text").alias("_names")).where(F.size("_names") > 0)
    pairs = wanted.select("query_id", F.size("_names").alias("_n"), F.explode("_names").alias("name"))
    matches = scope.keep(pairs.join(names, "name"))
    complete = (matches.groupBy("query_id", "_n").agg(F.countDistinct("name").alias("_found"))
                .where(F.col("_found") == F.col("_n")).select("query_id"))
    narrowed = matches.join(complete, "query_id", "left_semi").select("query_id", "document_id").distinct()
    naming = wanted.select("query_id", F.lit(True).alias("_naming"))
    queries = scope.queries.join(naming, "query_id", "left").select(
        "query_id", "see_all", (F.col("has_request") | F.col("_naming").isNotNull()).alias("has_request"))
    untouched = scope.requested.join(naming, "query_id", "left_anti")
    return Scope(materialize(queries), scope.documents, scope.granted, materialize(untouched.unionByName(narrowed)))


# --- table headers --------------------------------------------------------------------------


def table_headers(chunks: DataFrame) -> DataFrame:
    """(document_id, sheet, chunk_id, columns map) of the sheets whose first row names known roles."""
    cells = parse_rows(chunks.where(F.col("filename").endswith(".xlsx")).select("chunk_id", "document_id", "content"))
    label = F.col("value")
    first = cells.where((F.col("row") == 1) & F.length(label).between(1, 40) & ~label.rlike(r"[\r\n]"))
    known = F.lower(tx.without_space(label)).isin(*HEADER_ROLES)
    headers = first.groupBy("document_id", "sheet", "chunk_id").agg(
        F.count_if(known).alias("_known"), F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("columns"))
    return headers.where(F.col("_known") >= 2).groupBy("document_id", "sheet").agg(
        F.min("chunk_id").alias("chunk_id"), F.min_by("columns", "chunk_id").alias("columns"))
