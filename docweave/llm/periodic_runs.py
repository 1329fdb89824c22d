"""Periodic runs of words by an online sparse diagonal DP.

A word at place i that equals the word at place i - q matches on the diagonal of lag q. Matches on consecutive
places are one diagonal; m of them are a stretch of m + q words with period q. The scan walks the places in
order, prolongs the lags that are active and match again, and as soon as a lag stops emits its stretch if it is
long enough.

All pairs of equal words would be too many (a text of one word has n * n / 2), so a place meets only earlier
occurrences that can belong to a run. A run has at least ``EXPONENT`` = 4 periods. Take a lag q with
h/2 < q <= h, h a power of two. Every place of the run is then the start of h words that match q places before,
and no nearer: h >= q words at two distances d < q would give the stretch the period gcd(d, q). So for each h
the nearest earlier occurrence of the h words from a place decides, and it counts only if its lag is of the class
h/2 < q <= h. That is at most one lag per place and power of two, loses no run, and leaves out all multiples of
a period. Equality of h words is exact: ranks of h words come from pairs of ranks of h/2 words, and places whose
words occur once in their text take no further part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docweave.llm.arrays import NOT_SPACE, map_batches, runs as spans_of, text_bytes
from docweave.llm.registry import query

EXPONENT = 4
MIN_LENGTH = 6


def word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same number for equal words, by a dictionary of their bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    packed = raw[NOT_SPACE[raw]]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def active_lags(numbers: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, lags), by place, then lag: the nearest earlier occurrence of h words for every h, if h/2 < lag <= h.

    ``rows`` is the text of each word, ``counts`` the words of each text; places count over the whole batch.
    """
    stops = np.cumsum(counts)
    width = int(numbers.max()) + 1 if len(numbers) else 1
    places = np.flatnonzero(counts[rows] >= MIN_LENGTH)
    ranks = np.full(len(numbers) + 1, -1, dtype=np.int64)
    keys, h = rows[places] * width + numbers[places], 1
    found = []
    while len(places):
        order = np.argsort(keys, kind="stable")
        ordered, held = keys[order], places[order]
        again = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
        lag = held[again] - held[again - 1]
        near = (lag * 2 > h) & (lag <= h)
        found.append((held[again][near], lag[near]))
        # Only places whose words occur again in the text go on, with a rank per distinct sequence of h words.
        more = np.zeros(len(ordered), dtype=bool)
        more[again] = more[again - 1] = True
        repeated = held[more]
        ranks[repeated] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])[more]
        places = np.sort(repeated)
        # The next lags are over h, and a run has EXPONENT periods.
        places = places[(places + 2 * h <= stops[rows[places]]) & (counts[rows[places]] >= EXPONENT * (h + 1))]
        second = ranks[places + h]
        places, second = places[second >= 0], second[second >= 0]
        keys = ranks[places] * (len(numbers) + 1) + second
        ranks[repeated] = -1
        h *= 2
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at, lags = (np.concatenate(parts) for parts in zip(*found))
    order = np.lexsort((lags, at))
    return at[order], lags[order]


class Diagonals:
    """Match lengths of the active lags of one scan; ``step`` and ``finish`` return the runs that end there."""

    def __init__(self):
        self.place = -2
        self.active: dict[int, int] = {}  # lag -> first place of its diagonal

    def ended(self, lags) -> list[tuple[int, int, int]]:
        """(start, length, period) of the long ones among diagonals whose last match was at ``place``."""
        found = []
        for lag in lags:
            covered = 1 << (lag - 1).bit_length()  # a match stands for so many equal words
            first = self.active[lag]
            length = self.place - first + covered + lag
            if length >= max(MIN_LENGTH, EXPONENT * lag):
                found.append((first - lag, length, lag))
        return found

    def step(self, place: int, lags: list[int]) -> list[tuple[int, int, int]]:
        """Take the lags that match at ``place``: active ones grow, others begin, active ones that are not there end."""
        found, before = [], self.active
        if place != self.place + 1:
            found, before = self.ended(before), {}
        elif before.keys() - lags:
            found = self.ended(lag for lag in before if lag not in lags)
        self.active = {lag: before.get(lag, place) for lag in lags}
        self.place = place
        return found

    def finish(self) -> list[tuple[int, int, int]]:
        found, self.active = self.ended(self.active), {}
        return found


def find_runs(numbers: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period; starts count over the whole batch.

    One scan serves many texts: the first word of a text has no earlier occurrence, so no diagonal is alive there.
    """
    scan, found = Diagonals(), []
    places, lags = (a.tolist() for a in active_lags(numbers, rows, counts))
    at, last = 0, len(places)
    while at < last:
        place, stop = places[at], at + 1
        while stop < last and places[stop] == place:
            stop += 1
        found += scan.step(place, lags[at:stop])
        at = stop
    found += scan.finish()
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if found:
        kept = bytearray(b"\x01" * len(words))
        for start, length, period in found:
            kept[start + period:start + length] = bytes(length - period)
        words = [word for word, keep in zip(words, kept) if keep]
    return b" ".join(words)


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per document.

    ``runs`` lists every maximal run by start, then period; ``collapsed`` is the text with one period left of each,
    its words joined by one space. A null, empty or blank text has no words, no runs and an empty collapsed text.
    Rows with one id, or without an id, are documents of their own. A text is read by one task, with memory in
    proportion to its words. An empty table gives no rows. Other columns are not kept.
    """

    def work(batch):
        raw, offsets = text_bytes(batch.column("text"))
        starts, ends, rows = spans_of(NOT_SPACE[raw], offsets)
        counts = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        by_row: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, period in find_runs(word_numbers(raw, starts, ends), rows, counts):
            row = int(rows[start])
            by_row.setdefault(row, []).append((start - int(firsts[row]), length, period))
        texts = raw.tobytes()
        collapsed = [collapse(texts[a:b].split(), by_row.get(row, ())) for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()))]
        listed = [[{"start": s, "length": n, "period": p} for s, n, p in by_row.get(row, ())] for row in range(batch.num_rows)]
        return [batch.column("doc_id"), counts, listed, pa.array(collapsed, pa.binary()).cast(pa.string())]

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""
    order = ("(a, b) -> CASE WHEN a.length * b.period <> b.length * a.period THEN int(sign(b.length * a.period - a.length * b.period)) "
             "WHEN a.start <> b.start THEN int(sign(a.start - b.start)) ELSE int(sign(a.period - b.period)) END")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(F.expr(f"array_sort(runs, {order})"), F.lit(0)).alias("best"),
                        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                       F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """Every tenth document by the crc32 of its id gets a periodic end; a document without words or an id stays as it is."""
    digest = "crc32(binary(string(doc_id)))"
    # A one-element transform binds what its body needs several times.
    planted = r"""
        transform(transform(array(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')), ws -> named_struct('ws', ws, 'n', size(ws), 'g', DIGEST DIV 10)),
          x -> transform(array(int(x.g % x.n)), a -> array_join(transform(sequence(0, x.n - 1),
            i -> x.ws[IF(i < a, i, int(a + (i - a) % (1 + (x.n - a) DIV (3 + x.g % 8))))]), ' '))[0])[0]""".replace("DIGEST", digest)
    chosen = F.expr(rf"{digest} % 10 = 0 AND text RLIKE '[^\\x20\\x09-\\x0D]'")
    return documents.select("doc_id", F.when(chosen, F.expr(planted)).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    return summary(periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
