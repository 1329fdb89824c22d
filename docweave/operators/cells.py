"""Exact vector search that skips cells of vectors by angle.

Pivots are up to ``MAX_PIVOTS`` of the vectors themselves. Every vector lies in the cell of its nearest pivot, and a
cell knows the angles of its nearest and farthest member and its largest norm. By the triangle inequality a question at
angle a to the pivot is at least a - far and near - a away from every member, so the cosine of that angle times both norms
bounds all scores of the cell. Each question first meets its best cells until they hold enough vectors; the k-th
score found there rules out every cell with a smaller bound, and the rest are read in a second round.

Questions and vectors meet by cell in a shuffle. Crowded cells are split into parts of ``PART`` vectors, and so are the
questions of a cell that many ask for, so no task gathers more. Only pivots and cell figures are sent to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from docweave.operators.index import top_per_query
from docweave.operators.vectors import MAX_SCORES, MIN_SCORE, SCORE_DIGITS, best_rows, finite_vectors
from docweave.runtime import materialize

MAX_PIVOTS = 1024
PART = 20_000
# Vectors that the first round reads per question, times k.
FIRST_ROUND = 4
SLACK = 1e-7
# A chosen cell repeats the question's vector, so it is counted as this many figures.
VECTOR_COST = 64
FOUND = "query_id long, chunk_id long, document_id long, score double"


@dataclass
class CellIndex:
    """members(chunk_id, document_id, vector, cell, part), cells(cell, n, near, far, norm), pivots per dimension (first cell number, unit vectors)."""

    members: DataFrame
    cells: DataFrame
    pivots: dict[int, tuple[int, np.ndarray]]


def units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, unit rows and norms; a zero vector keeps zeros."""
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    return matrix, matrix / np.where(norms == 0, 1, norms)[:, None], norms


def blocks(batch: pd.DataFrame, cost: int) -> Iterator[pd.DataFrame]:
    """Rows of a batch in blocks of at most ``MAX_SCORES`` figures, where a row costs ``cost`` of them."""
    width = max(1, MAX_SCORES // max(1, cost))
    for start in range(0, len(batch), width):
        yield batch.iloc[start:start + width]


def of_each_dimension(batches: Iterator[pd.DataFrame], known) -> Iterator[tuple[int, pd.DataFrame]]:
    for batch in batches:
        sizes = batch["dim"].to_numpy()
        for size in np.unique(sizes):
            if size in known:
                yield int(size), batch[sizes == size]


def build_cells(chunks: DataFrame, pivots: int | None = None) -> CellIndex:
    """Cells of all finite vectors. Without ``pivots`` their number is the root of the number of vectors, up to ``MAX_PIVOTS``."""
    rows = materialize(finite_vectors(chunks.select("chunk_id", "document_id", "vector")).withColumn("dim", F.size("vector")))
    wanted = min(MAX_PIVOTS, pivots or max(1, math.isqrt(rows.count())))
    held: dict[int, list] = {}
    for row in rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("dim", "vector").limit(wanted).collect():
        held.setdefault(row["dim"], []).append(row["vector"])
    # A dimension without a pivot among them still gets one.
    others = rows.where(~F.col("dim").isin(list(held) or [0])).groupBy("dim").agg(F.min_by("vector", "chunk_id").alias("vector")).limit(MAX_PIVOTS)
    for row in others.collect():
        held[row["dim"]] = [row["vector"]]
    table, first = {}, 0
    for size, some in sorted(held.items()):
        table[size] = (first, units(pd.Series([np.array(v) for v in some]))[1])
        first += len(some)
    known = rows.sparkSession.sparkContext.broadcast(table)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for size, batch in of_each_dimension(batches, known.value):
            start, centres = known.value[size]
            _, unit, norms = units(batch["vector"])
            cosines = unit @ centres.T
            nearest = cosines.argmax(axis=1)
            angle = np.arccos(np.clip(cosines[np.arange(len(batch)), nearest], -1, 1))
            yield batch.drop(columns="dim").assign(cell=nearest + start, angle=angle, norm=norms)

    schema = T.StructType([*rows.drop("dim").schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("norm", T.DoubleType())])
    placed = materialize(rows.mapInPandas(assign, schema))
    cells = materialize(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"), F.max("norm").alias("norm")))
    parts = cells.select("cell", F.ceil(F.col("n") / PART).alias("parts"))
    members = placed.join(F.broadcast(parts), "cell").select("chunk_id", "document_id", "vector", "cell", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).alias("part"))
    return CellIndex(materialize(members), cells, table)


def cells_to_read(asked: DataFrame, index: CellIndex, enough: int, first: bool) -> DataFrame:
    """(query_id, vector, cell) of each question's best cells until they hold ``enough`` vectors, or of all others whose bound comes up to ``least``."""
    count = sum(len(centres) for _, centres in index.pivots.values())
    figures = np.zeros((4, count))
    for row in index.cells.collect():
        figures[:, row["cell"]] = row["n"], row["near"], row["far"], row["norm"]
    known = asked.sparkSession.sparkContext.broadcast((index.pivots, figures))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, (sizes, near, far, largest) = known.value
        for size, batch in ((size, block) for size, batch in of_each_dimension(batches, pivots) for block in blocks(batch, len(pivots[size][1]) * VECTOR_COST)):
            start, centres = pivots[size]
            own = slice(start, start + len(centres))
            _, unit, norms = units(batch["vector"])
            angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
            away = np.maximum(0, np.maximum(angle - far[own], near[own] - angle))
            # Where the angle is over a right one no score is positive, and zero bounds it.
            bound = np.maximum(0, np.cos(np.minimum(away, np.pi))) * norms[:, None] * largest[own] + SLACK
            bound[:, sizes[own] == 0] = -np.inf
            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(sizes[own][order], axis=1) - sizes[own][order]
            ranked = np.take_along_axis(bound, order, axis=1)
            least = batch["least"].to_numpy(dtype=np.float64)[:, None]
            early = before < enough
            chosen = (early if first else ~early) & (ranked >= least) & np.isfinite(ranked)
            question, place = np.nonzero(chosen)
            yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[question], "vector": batch["vector"].to_numpy()[question], "cell": order[question, place] + start})

    return asked.mapInPandas(choose, "query_id long, vector array<double>, cell int")


def read_cells(pairs: DataFrame, index: CellIndex, k: int, min_score: float | None) -> DataFrame:
    """Best ``k`` rows of every question in every part of the cells it reads."""
    pairs = materialize(pairs)
    crowds = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("crowds"))
    parts = index.members.groupBy("cell").agg(F.max("part").alias("last"))
    # One row per cell: no more than there are pivots.
    shape = F.broadcast(materialize(crowds.join(parts, "cell")))
    questions = (pairs.join(shape, "cell").withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.col("crowds")))
                 .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).select("query_id", "vector", "cell", "part", "crowd"))
    vectors = (index.members.join(shape, "cell").withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.col("crowds") - 1)))
               .select("chunk_id", "document_id", "vector", "cell", "part", "crowd"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {name: [] for name in ("query_id", "chunk_id", "document_id", "score")}
        if len(left) and len(right):
            matrix = np.stack(right["vector"].to_numpy()).astype(np.float64)
            ids, documents = right["chunk_id"].to_numpy(), right["document_id"].to_numpy()
            for block in blocks(left, len(right)):
                scores = np.round(matrix @ np.stack(block["vector"].to_numpy()).astype(np.float64).T, SCORE_DIGITS)
                for column, query_id in enumerate(block["query_id"].to_numpy()):
                    own = scores[:, column]
                    good = own >= min_score if min_score is not None else slice(None)
                    score, chunk, document = best_rows(own[good], ids[good], documents[good], k)
                    for name, values in (("query_id", np.full(len(score), query_id)), ("chunk_id", chunk), ("document_id", document), ("score", score)):
                        found[name].append(values)
        return pd.DataFrame({name: np.concatenate(values) if values else [] for name, values in found.items()})

    keys = ["cell", "part", "crowd"]
    return questions.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInPandas(meet, FOUND)


def _rounds(queries: DataFrame, index: CellIndex, k: int, min_score: float | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pairs of both rounds, the rows of the first and the questions."""
    floor = float("-inf") if min_score is None else min_score
    asked = materialize(finite_vectors(queries.select("query_id", "vector")).withColumn("dim", F.size("vector")))
    first = materialize(cells_to_read(asked.withColumn("least", F.lit(floor)), index, FIRST_ROUND * k, True))
    early = materialize(read_cells(first, index, k, min_score))
    reached = (top_per_query(early, k, F.col("score").desc(), F.col("chunk_id")).groupBy("query_id")
               .agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("least")).where(F.col("held") == k).select("query_id", "least"))
    limits = asked.join(reached, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(floor)))
    return first, materialize(cells_to_read(limits, index, FIRST_ROUND * k, False)), early, asked


def pruned_topk(queries: DataFrame, index: CellIndex, k: int, min_score: float | None = MIN_SCORE) -> DataFrame:
    """The rows of ``cosine_topk`` without a scope: (query_id, chunk_id, document_id, score, rank)."""
    _, second, early, _ = _rounds(queries, index, k, min_score)
    return top_per_query(early.unionByName(read_cells(second, index, k, min_score)), k, F.col("score").desc(), F.col("chunk_id"))


def vectors_read(queries: DataFrame, index: CellIndex, k: int, min_score: float | None = MIN_SCORE) -> DataFrame:
    """(query_id, cells, read): cells and vectors that a question reads in both rounds."""
    first, second, _, _ = _rounds(queries, index, k, min_score)
    return (first.unionByName(second).join(F.broadcast(index.cells), "cell").groupBy("query_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("read")))
