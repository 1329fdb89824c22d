"""Dense count tables of fixed length, summed over all rows; labelled rows; repeated keys."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docweave.llm.arrays import slices, small_batches
from docweave.runtime import BROADCAST_LIMIT_BYTES, estimated_bytes

CHUNKS = 64


def summed(df: DataFrame, length: int, dtype: str, add: Callable[[np.ndarray, pa.RecordBatch], None], column: str = "text") -> np.ndarray:
    """One table of ``length`` numbers, summed over all rows of ``df``.

    Every task sums its own rows with ``add(table, slice)`` and sends the table in compressed chunks;
    one task per chunk adds them as they arrive. The driver gets ``length`` numbers, whatever the input.
    """
    step = -(-length // CHUNKS)

    def count(batches):
        table = np.zeros(length, dtype=dtype)
        for batch in batches:
            for start, stop in slices(batch, column):
                add(table, batch.slice(start, stop - start))
        for chunk in range(CHUNKS):
            part = table[chunk * step:(chunk + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "body": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def merge(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(body.as_py()), dtype=dtype)
                totals[chunk] = totals[chunk] + part if chunk in totals else part
        for chunk, part in totals.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "body": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    parts = small_batches(df).mapInArrow(count, "chunk int, body binary").repartition("chunk").mapInArrow(merge, "chunk int, body binary")
    table = np.zeros(length, dtype=dtype)
    for row in parts.collect():
        part = np.frombuffer(zlib.decompress(row["body"]), dtype=dtype)
        table[row["chunk"] * step:row["chunk"] * step + len(part)] = part
    return table


def joined_small(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that broadcasts the small side only after measuring it; beyond the limit both sides are shuffled."""
    return large.join(F.broadcast(small) if estimated_bytes(small) <= BROADCAST_LIMIT_BYTES else small, keys, how)


def labelled(documents: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, text, label) of documents with a 0/1 label. A document labelled twice takes the larger label; null ids and labels train nothing."""
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(column).cast("int").alias("label")))
    return joined_small(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), marks, ["doc_id"])
