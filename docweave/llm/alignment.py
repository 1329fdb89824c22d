"""Alignment of two tokenizers over the same bytes, by lockstep merging.

Both token sequences of a text spell the same bytes. A state is a pair of pointers, one into each sequence; it
links the two tokens it points at, then moves on from the token that ends first, or from both and makes a cut if
they end together. One NumPy vector holds the states of all documents of a batch and all of them take each step at
once; states at their end leave the vector. So that a long document does not keep a step to itself, it has a state
for every ``LANE`` tokens of the first tokenizer: a state starts at the token of the other one that holds its first
byte, and every overlapping pair belongs to the state of its first token.

How many documents hold a linked pair of ids is a count by pair over the distinct pairs of each document, combined
before it is shuffled. Documents look up the frequent pairs, at most ``LOOKUP_PAIRS``, in a broadcast table; the
others meet their counts by a join, which has no hot key because its pairs are rare.
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docweave.llm.arrays import map_batches, shared
from docweave.llm.registry import query
from docweave.runtime import materialize

LANE = 64
LOOKUP_PAIRS = 2_000_000
CACHE_ENTRIES = 300_000
TOGETHER = 10_000
CACHED_LENGTH = 40


class Tokens:
    """Both tokenizers and the byte spelling of their ids."""

    # A space between two signs, the second not white, starts a token of either tokenizer; texts without the other pattern have no other spaces.
    gap = re.compile(r"(?<=[^ ]) (?=\S)")
    other = re.compile(r" (?:\s|\Z)|\A ")

    def __init__(self, first: str, second: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_file=second)
        # Bytes as the byte-level alphabet writes them: visible Latin-1 signs stand for themselves, the rest follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        value = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        vocabulary = self.first.get_vocab()
        self.first_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, number in vocabulary.items():
            self.first_bytes[number] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        pieces = [self.second.id_to_piece(n) for n in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        self.first_sizes, self.second_sizes = (np.array([len(b) for b in table], dtype=np.int64) for table in (self.first_bytes, self.second_bytes))
        # Texts are cut at gaps only if no piece goes on from another sign over a space.
        self.divisible = not any(re.search("[^▁]▁", p) for p in pieces)
        self.cache: dict[str, tuple[bytes, bytes] | None] = {}
        numbers = [str(n) for n in range(max(len(self.first_bytes), len(self.second_bytes)))]
        self.spelled = np.array([n + sign for sign in (",", "|", ";", "") for n in numbers], dtype=object).reshape(4, -1)

    def chunks(self, text: str) -> list[str]:
        """Parts that both tokenizers read as they read the text; the space before a part is the one they add."""
        if not text or not self.divisible:
            return [text] if text else []
        return self.gap.split(text) if self.other.search(text) else text.split(" ")

    def learn(self, chunks: set[str]) -> None:
        """Ids of chunks that the cache lacks, as bytes of 32-bit numbers; None where a tokenizer does not spell the bytes.

        Chunks that may stand next to each other are read as one text and parted at their ends.
        """
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = list(chunks.difference(self.cache))
        odd = [chunk for chunk in new if chunk[:1].isspace() or chunk[-1:] == " " or "▁" in chunk or not self.divisible]
        held = set(odd)
        plain = [chunk for chunk in new if chunk not in held]
        for start in range(0, len(plain), TOGETHER):
            some = plain[start:start + TOGETHER]
            made = self.read(some)
            if made is None:
                odd += some
            else:
                self.cache.update(zip(some, made))
        for chunk in odd:
            made = self.read([chunk])
            self.cache[chunk] = made and made[0]

    def read(self, chunks: list[str]) -> list[tuple[bytes, bytes]] | None:
        """Ids of consecutive chunks, or None if a tokenizer does not spell all their bytes or goes on over an end."""
        text = " ".join(chunks)
        wanted = (" " + text).encode()
        ends = np.cumsum([1 + len(chunk.encode()) for chunk in chunks])
        sides = []
        for ids, spelling, sizes in ((self.first.encode(" " + text, add_special_tokens=False).ids, self.first_bytes, self.first_sizes),
                                     (self.second.encode(text), self.second_bytes, self.second_sizes)):
            if b"".join([spelling[i] for i in ids]) != wanted:
                return None
            numbers = np.array(ids, dtype=np.int32)
            token_ends = np.cumsum(sizes[numbers])
            last = np.searchsorted(token_ends, ends)
            if (token_ends[last] != ends).any():
                return None
            body, stops = numbers.tobytes(), (4 * (last + 1)).tolist()
            sides.append([body[a:b] for a, b in zip([0, *stops], stops)])
        return list(zip(*sides))

    def forget(self, chunks: set[str]) -> None:
        """Long chunks do not stay."""
        for chunk in chunks:
            if len(chunk) > CACHED_LENGTH:
                del self.cache[chunk]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all texts, each with a space before it, and how many each has, for both sides. A text has none where the bytes of either side differ from it."""
        divided = [self.chunks(text) for text in texts]
        wanted = set().union(*divided)
        self.learn(wanted)
        known, counts, joined = self.cache, ([], []), ([], [])
        for parts in divided:
            found = [known[part] for part in parts]
            for side in (0, 1):
                ids = b"" if None in found else b"".join([pair[side] for pair in found])
                joined[side].append(ids)
                counts[side].append(len(ids) // 4)
        self.forget(wanted)
        return ([np.frombuffer(b"".join(side), dtype=np.int32).astype(np.int64) for side in joined], [np.array(side, dtype=np.int64) for side in counts])


def tokens(first: str, second: str) -> Tokens:
    """Loaded once per Python worker and pair of files, kept between tasks."""
    holder = sys.modules.setdefault("_docweave_alignment", types.ModuleType("_docweave_alignment"))
    key = f"{first}\n{second}"
    if key not in holder.__dict__:
        setattr(holder, key, Tokens(first, second))
    return getattr(holder, key)


def merge(first_ends: np.ndarray, second_ends: np.ndarray, begins: np.ndarray, stops: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, ...]:
    """Lockstep merging of all documents: (first, second) places of every link, then of the tokens before every cut.

    Ends are byte offsets over the whole batch; document d has the first tokens ``begins[d]`` to ``stops[d]``.
    """
    sizes = stops - begins
    lanes = -(-sizes // lane)
    number = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    a = np.repeat(begins, lanes) + number * lane
    stop = np.minimum(a + lane, np.repeat(stops, lanes))
    b = np.searchsorted(second_ends, np.where(a > 0, first_ends[a - 1], 0), side="right")
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        end_a, end_b = first_ends[a], second_ends[b]
        together = end_a == end_b
        cuts_a.append(a[together])
        cuts_b.append(b[together])
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        alive = a < stop
        if not alive.all():
            a, b, stop = a[alive], b[alive], stop[alive]
    if not links_a:
        return (np.zeros(0, dtype=np.int64),) * 4
    return np.concatenate(links_a), np.concatenate(links_b), np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def spell(known: Tokens, first: np.ndarray, second: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray) -> list[str]:
    """Groups of every document: ``a1,a2|b1;a3|b2,b3``."""
    place_a, place_b = np.arange(len(first)), np.arange(len(second))
    group_a, group_b = np.searchsorted(cuts_a, place_a), np.searchsorted(cuts_b, place_b)
    sign_a, sign_b = np.zeros(len(first), dtype=np.int64), np.zeros(len(second), dtype=np.int64)
    sign_a[cuts_a], sign_b[cuts_b] = 1, 2
    stops_b = np.cumsum(counts_b)
    sign_b[stops_b[counts_b > 0] - 1] = 3
    out = np.empty(len(first) + len(second), dtype=object)
    # In front of a token are the earlier ones of its own side, and of the other side all groups before it; before a second token also its own group.
    out[place_a + np.r_[0, cuts_b + 1][group_a]] = known.spelled[sign_a, first]
    out[place_b + (cuts_a + 1)[group_b]] = known.spelled[sign_b, second]
    ends = np.cumsum(counts_a + counts_b)
    return ["".join(out[end - size:end]) for end, size in zip(ends.tolist(), (counts_a + counts_b).tolist())]


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def aligned(documents: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times), one row per document.

    ``groups`` spells the id groups between common ends; ``pairs`` are its distinct linked id pairs, the first id
    times the size of the second vocabulary plus the second id, ascending, and ``times`` how often each is linked. A
    null or empty text, or one that a tokenizer does not spell byte by byte, has no tokens, no groups and no pairs.
    Repeated ids and rows without one are documents of their own. Other columns are not kept.
    """

    def work(batch):
        known = tokens(first, second)
        (flat_a, flat_b), (counts_a, counts_b) = known.encode([text or "" for text in batch.column("text").to_pylist()])
        stops = np.cumsum(counts_a)
        links_a, links_b, cuts_a, cuts_b = merge(np.cumsum(known.first_sizes[flat_a]), np.cumsum(known.second_sizes[flat_b]), stops - counts_a, stops)
        owner = np.repeat(np.arange(batch.num_rows), counts_a)
        pair = flat_a[links_a] * len(known.second_bytes) + flat_b[links_b]
        distinct, times = np.unique((owner[links_a] << 40) + pair, return_counts=True)
        places = np.r_[0, np.cumsum(np.bincount(distinct >> 40, minlength=batch.num_rows))].astype(np.int32)
        listed = [pa.ListArray.from_arrays(pa.array(places), pa.array(values)) for values in (distinct & ((1 << 40) - 1), times)]
        return [batch.column("doc_id"), counts_a, counts_b, np.bincount(owner[cuts_a], minlength=batch.num_rows), np.bincount(owner[links_a], minlength=batch.num_rows),
                spell(known, flat_a, flat_b, cuts_a, cuts_b, counts_a, counts_b), *listed]

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, SCHEMA)


def pair_counts(rows: DataFrame, second_size: int) -> DataFrame:
    """(pair, documents, best): documents that hold the pair, and whether no pair with its first id is in more."""
    counts = materialize(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")))
    first_id = F.expr(f"pair DIV {second_size}")
    # One row per id of the first vocabulary at most.
    highest = counts.groupBy(first_id.alias("first_id")).agg(F.max("documents").alias("highest"))
    return (counts.withColumn("first_id", first_id).join(F.broadcast(highest), "first_id")
            .select("pair", "documents", (F.col("documents") == F.col("highest")).alias("best")))


def frequent_from(counts: DataFrame, limit: int) -> int:
    """Smallest power of two so that no more than ``limit`` pairs are in that many documents."""
    level = F.floor(F.log2(F.col("documents"))).cast("int")
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    chosen, held = 1 + max(sizes, default=0), 0
    while chosen and held + sizes.get(chosen - 1, 0) <= limit:
        chosen -= 1
        held += sizes.get(chosen, 0)
    return 1 << chosen


def scored(rows: DataFrame, counts: DataFrame, limit: int = LOOKUP_PAIRS) -> DataFrame:
    """``rows`` (row, pairs, times, ...) with ``n_best``, links whose pair is best, and ``count_sum``, the counts of all links, instead of the lists."""
    counts = materialize(counts)
    threshold = frequent_from(counts, limit)
    table = counts.where(F.col("documents") >= threshold).toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    looked_up = shared(rows, tuple(table.column(name).to_numpy()[order] for name in ("pair", "documents", "best")))
    kept = [c for c in rows.columns if c not in ("pairs", "times")]

    def work(batch):
        keys, documents, best = looked_up.value
        pairs, times = batch.column("pairs"), batch.column("times")
        sizes = pairs.value_lengths().to_numpy()
        pair, weight = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        if len(keys):
            place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            known = keys[place] == pair
            gains = best[place] * weight * known, documents[place] * weight * known
        else:
            known = np.zeros(len(pair), dtype=bool)
            gains = np.zeros(len(pair), dtype=np.int64), np.zeros(len(pair), dtype=np.int64)
        stops = np.cumsum(sizes)
        sums = []
        for gain in gains:
            running = np.r_[0, np.cumsum(gain)]
            sums.append(running[stops] - running[stops - sizes])
        # One row per document, and one per pair that the table lacks, with the document's number alone.
        more = np.flatnonzero(~known)
        source = pa.array(np.r_[np.arange(batch.num_rows), np.repeat(np.arange(batch.num_rows), sizes)[more]])
        extra = np.r_[np.zeros(batch.num_rows, dtype=bool), np.ones(len(more), dtype=bool)]
        carried = [batch.column(c).take(source) for c in kept]
        missing = [pa.array(np.r_[np.zeros(batch.num_rows, dtype=np.int64), values[more]], mask=~extra) for values in (pair, weight)]
        return [*carried, *(np.r_[total, np.zeros(len(more), dtype=np.int64)] for total in sums), *missing]

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    found = map_batches(rows.withColumn("text", F.lit("")), work, f"{fields}, n_best long, count_sum long, pair long, weight long")
    if threshold == 1:
        return found.drop("pair", "weight")
    found = materialize(found)
    rare = counts.where(F.col("documents") < threshold)
    late = (found.where("pair IS NOT NULL").join(rare, "pair").groupBy("row")
            .agg(F.sum(F.col("weight") * F.col("best").cast("long")).alias("late_best"), F.sum(F.col("weight") * F.col("documents")).alias("late_sum")))
    joined = found.where("pair IS NULL").drop("pair", "weight").join(late, "row", "left")
    return (joined.withColumn("n_best", F.col("n_best") + F.coalesce("late_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("late_sum", F.lit(0)))
            .drop("late_best", "late_sum"))


def alignment(documents: DataFrame, first: str, second: str, limit: int = LOOKUP_PAIRS) -> DataFrame:
    """``aligned`` without its lists, with the digest of ``groups``, ``n_best`` and ``count_sum``.

    Texts are tokenized once; the distinct pairs and the digests are written to the shared folder, where a row number
    marks each document. An empty table gives no rows.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    rows = materialize(aligned(documents, first, second).withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id()))
    second_size = len(tokens(first, second).second_bytes)
    return scored(rows, pair_counts(rows, second_size), limit).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark, sf_dir):
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_paths())
