"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``size`` tokens. The driver sees only the histogram of piece lengths, at
most ``size`` numbers. From it a plan is made: for the longest open length, combinations of one, two or three
other lengths whose sum fills the gap exactly are looked up and consumed as often as all members are available;
what is left goes best-fit into the smallest gap that takes it. A plan line stands for many equal sequences.
Pieces are then numbered within their length, in parallel, and find their place in the plan by that number.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docweave.llm.arrays import map_batches, shared, text_bytes
from docweave.llm.registry import query
from docweave.llm.tokens import default_path, word_ids
from docweave.runtime import materialize, ranked

SIZE = 4096
END = (1).to_bytes(4, "little")


def pieces(documents: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and an end sign, cut only beyond ``size``."""

    def work(batch):
        cache = word_ids(tokenizer)
        column = batch.column("text")
        raw, _ = text_bytes(column)
        separators = bool(((raw >= 0x1C) & (raw <= 0x1F)).any())
        made = [[], [], [], [], []]
        for doc, text in zip(batch.column("doc_id").to_pylist(), column.to_pylist()):
            ids = cache.ids(text, separators) + END
            for piece, start in enumerate(range(0, len(ids) // 4, size)):
                part = ids[4 * start:4 * (start + size)]
                for values, value in zip(made, (doc, piece, start, len(part) // 4, zlib.crc32(part))):
                    values.append(value)
        return made

    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(named, work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Lengths of a sequence, and how many sequences have them. All available pieces are used exactly once."""
    left = [0] * (size + 1)
    for length, count in counts.items():
        left[length] += count
    # Bit x: length x is available; in the mirror, bit size - x.
    bits = sum(1 << x for x in range(size + 1) if left[x])
    mirror = sum(1 << (size - x) for x in range(size + 1) if left[x])
    lines: list[tuple[tuple[int, ...], int]] = []

    def change(length: int, by: int) -> None:
        nonlocal bits, mirror
        had = left[length] > 0
        left[length] += by
        if had != (left[length] > 0):
            bits ^= 1 << length
            mirror ^= 1 << (size - length)

    def take(lengths: tuple[int, ...]) -> bool:
        need: dict[int, int] = {}
        for length in lengths:
            need[length] = need.get(length, 0) + 1
        times = min(left[length] // n for length, n in need.items())
        if times <= 0:
            return False
        for length, n in need.items():
            change(length, -n * times)
        lines.append((lengths, times))
        return True

    def pair(gap: int) -> tuple[int, int] | None:
        """Two available lengths with this sum: the bits of all complements at once, the most unequal pair first."""
        found = bits & (mirror >> (size - gap)) & ((1 << (gap // 2 + 1)) - 1)
        if gap % 2 == 0 and left[gap // 2] < 2:
            found &= ~(1 << (gap // 2))
        if not found:
            return None
        x = (found & -found).bit_length() - 1
        return x, gap - x

    def triple(gap: int) -> tuple[int, int, int] | None:
        for x in range(gap - 2, 0, -1):
            if left[x]:
                change(x, -1)
                rest = pair(gap - x)
                change(x, 1)
                if rest is not None:
                    return x, *rest
        return None

    if left[size]:
        take((size,))
    for longest in range(size - 1, 0, -1):
        gap = size - longest
        while left[longest]:
            if take((longest, gap)):
                continue
            change(longest, -1)  # the sequence's own first piece is not there for its partners
            found = pair(gap) or triple(gap)
            change(longest, 1)
            if found is None or not take((longest, *found)):
                break
    # Best fit, longest first: (gap, lengths, times), sorted by gap.
    open_: list[tuple[int, tuple[int, ...], int]] = []
    for length in range(size, 0, -1):
        while left[length]:
            place = bisect.bisect_left(open_, (length, (), 0))
            if place == len(open_):
                each = size // length
                full, rest = divmod(left[length], each)
                for lengths, times in (((length,) * each, full), ((length,) * rest, 1 if rest else 0)):
                    if times:
                        bisect.insort(open_, (size - length * len(lengths), lengths, times))
                left[length] = 0
                continue
            gap, lengths, times = open_.pop(place)
            used = min(times, left[length])
            left[length] -= used
            bisect.insort(open_, (gap - length, (*lengths, length), used))
            if used < times:
                bisect.insort(open_, (gap, lengths, times - used))
    return lines + [(lengths, times) for _, lengths, times in open_]


def slots(lines: list[tuple[tuple[int, ...], int]], size: int = SIZE) -> tuple[np.ndarray, ...]:
    """Per length, ranges of piece numbers and where they go: key (length, first number), first sequence, offset."""
    used = np.zeros(size + 1, dtype=np.int64)
    keys, sequences, offsets, sequence = [], [], [], 0
    for lengths, times in lines:
        offset = 0
        for length in lengths:
            keys.append((length << 45) + int(used[length]))
            sequences.append(sequence)
            offsets.append(offset)
            used[length] += times
            offset += length
        sequence += times
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return tuple(np.array(values, dtype=np.int64)[order] for values in (keys, sequences, offsets))


def pack(documents: DataFrame, tokenizer: str, size: int = SIZE, buckets: int = 64) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null or empty text is one piece with the end sign alone. Repeated ids are separate documents. An empty
    table gives no rows. Other columns are not kept.
    """
    cut = materialize(pieces(documents, tokenizer, size))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = shared(documents, slots(plan(counts, size), size))
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    numbered = ranked(cut, ["length"], spread, ["doc_id", "piece", "start", "ids_crc32"])

    def work(batch):
        keys, sequences, offsets = places.value
        length = batch.column("length").to_numpy()
        number = batch.column("rank").to_numpy() - 1
        place = np.searchsorted(keys, (length << 45) + number, side="right") - 1
        sequence = sequences[place] + number - (keys[place] & ((1 << 45) - 1))
        return [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), sequence, offsets[place]]

    with_text = numbered.withColumn("text", F.lit(""))
    return map_batches(with_text, work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
