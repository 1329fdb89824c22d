"""Vectorised text work inside Arrow batches: slices of bounded size, words, rolling hashes.

Offsets count bytes of the UTF-8 text of one slice. Word hashes come from modular prefix sums
(modulus 2**64): H(a, b) = (S[b] - S[a]) * base**-a, then a bit mix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SLICE_BYTES = 1 << 20
BATCH_ROWS = 2000
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# Lower-cases A-Z and nothing else.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
# 0 separates words: space, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# Letters, digits and every byte of a multi-byte character.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64."""
    known = _powers.get(str(base))
    if known is None or len(known) < count:
        factors = np.full(max(count, SLICE_BYTES + 1), base, dtype=np.uint64)
        factors[0] = 1
        known = _powers[str(base)] = np.cumprod(factors, dtype=np.uint64)
    return known[:count]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with at most ``limit`` bytes of text, or one longer row."""
    lengths = batch.column(column).cast(pa.large_string())
    sizes = np.diff(np.frombuffer(lengths.buffers()[1], dtype=np.int64, count=len(lengths) + lengths.offset + 1)[lengths.offset:])
    start = held = 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield start, row
            start, held = row, 0
        held += int(size)
    if len(sizes) > start:
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets in them; a null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a row: starts, ends, row of each."""
    if not len(member):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    heads = offsets[:-1][(offsets[:-1] < len(member))]
    begins[heads] = member[heads]
    starts = np.flatnonzero(begins)
    finish = member.copy()
    finish[:-1] &= ~member[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    finish[tails] = member[tails]
    ends = np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[start:end] for every span, from one prefix sum."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(raw) + 1)[starts])


def words(column: pa.Array, member: np.ndarray = NOT_SPACE, lower: bool = True):
    """Word hashes of a string column with their rows, starts and ends (bytes within the slice), and row offsets."""
    raw, offsets = text_bytes(column)
    if lower:
        raw = ASCII_LOWER[raw]
    starts, ends, rows = runs(member[raw], offsets)
    return span_hashes(raw, starts, ends), rows, starts, ends, offsets


def chained(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one row, and the index of their first word."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    last = len(hashes) - size + 1
    combined = hashes[:last].copy()
    for step in range(1, size):
        combined = mix(combined * BASE + hashes[step:step + last])
    first = np.flatnonzero(rows[:last] == rows[size - 1:])
    return combined[first], first


def row_sums(values: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=count)


def shared(df: DataFrame, value):
    """Broadcast variable of a model of bounded size."""
    return df.sparkSession.sparkContext.broadcast(value)


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, with the session's Arrow batches at no more than ``BATCH_ROWS`` rows.

    Spark holds whole batches outside the heap, twice while they grow; ten thousand texts at once, its usual
    batch, are too many beside an executor's other memory.
    """
    conf = df.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], list | None], schema: str, finish: Callable[[], list] | None = None,
                column: str = "text") -> DataFrame:
    """``work`` gets slices of bounded size and returns arrays in the order of ``schema``."""
    fields = T._parse_datatype_string(schema) if not isinstance(schema, T.StructType) else schema
    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch, column):
                made = work(batch.slice(start, stop - start))
                if made is not None and len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(a, type=f.type) if not isinstance(a, pa.Array) else a.cast(f.type)
                                                      for a, f in zip(made, target)], schema=target)
        if finish is not None:
            for made in finish():
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(a, type=f.type) for a, f in zip(made, target)], schema=target)
    return small_batches(df).mapInArrow(run, fields)


def fold(text_id, modulus: int):
    """crc32 of the decimal doc_id modulo ``modulus``."""
    return F.crc32(text_id.cast("string").cast("binary")) % modulus
