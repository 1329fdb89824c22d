"""Names in texts: an equi-join of window hashes, one window per distinct length of a name.

A name is found whole: no letter A-Z, digit or underscore stands right before or behind it. Letters A-Z are folded. Prefix
polynomials give the hash of every window at such edges in constant time. Windows meet the names of their hash where they are if the written names measure below the broadcast limit, else
in a shuffle whose hot names are spread over the texts; the signs of the window decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docweave.functions import text as tx
from docweave.runtime import BROADCAST_LIMIT_BYTES, estimated_bytes, materialize, salted_join

BASE = np.uint64(0x9E3779B97F4A7C15)
OUTPUT_ROWS = 100_000

WORD = np.zeros(128, dtype=bool)
WORD[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"]] = True


def prefixes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text and the prefix sums of their weighted values, modulo 2^64.

    Place ``i`` weighs ``BASE ** i``; the base is odd, so a window is brought to place 0 by the inverse power.
    """
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    powers = powers_of(BASE, len(signs))
    return signs, np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((signs.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])


def powers_of(base: np.uint64, count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(max(count - 1, 0), base, dtype=np.uint64)]), dtype=np.uint64)[:count]


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def windows(text: str, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes and starts of the windows of each length that stand between edges."""
    signs, sums = prefixes(text)
    word = WORD[np.minimum(signs, 127)] & (signs < 128)
    opens = np.flatnonzero(np.r_[True, ~word[:-1]]) if len(word) else np.zeros(0, dtype=np.int64)
    closes = np.r_[~word, True]
    back = powers_of(INVERSE, len(signs))
    for length in lengths:
        starts = opens[opens + length <= len(signs)]
        starts = starts[closes[starts + length]]
        if len(starts):
            yield (sums[starts + length] - sums[starts]) * back[starts], starts, int(length)


def _name_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = np.array([prefixes(t)[1][-1] for t in batch.column(0).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0)], names=["hash", "term"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(parts):
        hashes, sizes, starts, lengths = zip(*parts)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(starts), pa.int32()),
                                           pa.array(np.repeat(lengths, sizes), pa.int32())], names=["hash", "start", "length"])

    for batch in batches:
        for row in range(batch.num_rows):
            text, lengths = batch.column(1)[row].as_py(), np.array(batch.column(2)[row].as_py() or [], dtype=np.int64)
            held, count = [], 0

            def flush():
                made = rows(held)
                key = pa.array([batch.column(0)[row].as_py()] * made.num_rows, batch.column(0).type)
                # The signs of a window, so that the exact check needs no join back to the text.
                terms = pa.array([text[s:s + n] for s, n in zip(made.column(1).to_pylist(), made.column(2).to_pylist())], pa.string())
                return pa.RecordBatch.from_arrays([key, made.column(0), terms], names=["key", "hash", "window"])

            for hashes, starts, length in windows(text, lengths):
                held.append((hashes, len(hashes), starts, length))
                count += len(hashes)
                if count >= OUTPUT_ROWS:
                    yield flush()
                    held, count = [], 0
            if held:
                yield flush()


def mentioned_names(texts: DataFrame, key: str, text: str, names: DataFrame, shortest: int = 1) -> DataFrame:
    """(key, term), distinct: the lower-cased ``term`` of ``names`` that a text states whole.

    Names shorter than ``shortest`` signs, null names and null texts take no part. Windows of a text: its edges times the
    number of distinct name lengths, which is the only thing of the names that every task gets.
    """
    terms = names.select(tx.ascii_lower("term").alias("term")).where(F.length("term") >= shortest).distinct()
    lengths = terms.agg(F.array_sort(F.collect_set(F.length("term")))).scalar()
    cut = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), tx.ascii_lower(text).alias("text"), lengths.alias("lengths"))
    kind = texts.schema[key].dataType.simpleString()
    stated = cut.mapInArrow(_window_rows, f"key {kind}, hash long, window string")
    hashed = materialize(terms.mapInArrow(_name_hashes, "hash long, term string"))
    if estimated_bytes(hashed) <= BROADCAST_LIMIT_BYTES:
        met = stated.join(F.broadcast(hashed), "hash")
    else:
        met = salted_join(stated, hashed, ["hash"], "inner", "key")
    return met.where(F.col("window") == F.col("term")).select(F.col("key").alias(key), "term").distinct()
