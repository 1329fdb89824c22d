"""Benchmark decontamination: CGK embeddings of item-sized windows, repeated bit sampling, exact edit verification.

Texts are compared as lower-cased words joined by single spaces. Grams of four bytes at every place of every text
are looked up among the half of each item's grams that fewest items have; a hit lies on a diagonal, the difference of the
two places. Windows of an item's size are laid where hits of that item gather within the diagonals its edits may shift
them to; the least number asked for is well under what edits at the lowest similarity leave. CGK random walks embed every
window, so that edit distance becomes Hamming distance, and repeated samples of the walks are the LSH keys: a window
goes on if one of its keys equals the item's. Every candidate is verified by the smallest edit distance between the item
and any part of the text around; a similarity of 0.75 or more is a match. Memory grows with the items and with one piece
of text, not with their product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docweave.llm.arrays import BASE, IN_WORD, map_batches, runs, shared, text_bytes
from docweave.llm.registry import query
from docweave.llm.tables import joined_small
from docweave.runtime import bounded_slices, materialize

GRAM = 4
KEPT = 2
SHARE = 10
SHORT = 24
FACTOR = np.uint32(0x9E3779B1)
SLOT_BITS = 20
PIECE = 1 << 16
WINDOW_STEPS = 8
WALKS = 8
REPETITIONS = 24
SIGNS = 6
NEAR = 24
SEED = 20
WALKED = 8 << 20
SIMILARITY = 0.75
ITEMS_LIMIT = 32 << 20


def normal_bytes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows joined by single spaces, a zero byte after every row; where each row starts, and its size."""
    starts, ends, rows = runs(IN_WORD[raw], offsets)
    sizes = np.bincount(rows, weights=ends - starts + 1, minlength=len(offsets) - 1).astype(np.int64)
    first = np.cumsum(np.maximum(sizes, 1)) - np.maximum(sizes, 1)
    joined = np.zeros(int(np.maximum(sizes, 1).sum()), dtype=np.uint8)
    if len(starts):
        gaps = ends - starts + 1
        before = np.cumsum(gaps) - gaps
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        at = first[rows] + before - np.repeat(before[heads], np.diff(np.append(heads, len(rows))))
        member = IN_WORD[raw]
        joined[np.repeat(at - starts, ends - starts) + np.flatnonzero(member)] = raw[member]
        joined[(at + gaps - 1)[:-1][rows[1:] == rows[:-1]]] = 32
    return joined, first, np.maximum(sizes - 1, 0)


def gram_slots(joined: np.ndarray) -> np.ndarray:
    """Hash slot of the gram at every place, the bytes after the end taken for zeros.

    Grams of four bytes are read as 32-bit numbers, from four shifted views of the stream.
    """
    padded = np.zeros((len(joined) + 3) // 4 * 4 + 8, dtype=np.uint8)
    padded[:len(joined)] = joined
    grams = np.empty((len(joined) + 3) // 4 * 4, dtype=np.uint32)
    for lane in range(4):
        own = grams[lane::4]
        view = padded[lane:]
        own[:] = view[:len(view) // 4 * 4].view(np.uint32)[:len(own)]
    return ((grams[:len(joined)] * FACTOR) >> np.uint32(32 - SLOT_BITS)).astype(np.int32)


def walks(data: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """CGK random walks: byte read at every step, (start, walk, step).

    At every step a walk writes the byte it stands on and moves on if the hash of step and byte says so. Two texts whose
    walks stand on like places read the same bytes and move alike until the next edit; behind it they meet again.
    ``data`` ends with enough zero bytes.
    """
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, (steps, WALKS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((steps, len(starts), WALKS), dtype=np.uint8)
    place = np.repeat(starts[:, None], WALKS, axis=1)
    for step in range(steps):
        read = out[step] = data[place]
        place += (((read.astype(np.uint64) + np.uint64(1)) * factors[step]) >> np.uint64(63)).astype(np.int64)
    return out


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the repeated bit sampling, drawn once for all: the first of (start, walk, repetition), and SIGNS steps
    from there. The steps of one repetition lie within NEAR: walks agree in stretches, so near places agree together far
    more often than places all over the walk, while unlike texts agree on either by chance alone."""
    draw = np.random.default_rng(SEED + 1)
    share, beside = draw.random((WALKS, REPETITIONS)), draw.permuted(np.tile(np.arange(NEAR), (WALKS, REPETITIONS, 1)), axis=2)[..., :SIGNS]
    return (share[None] * np.maximum(2 * sizes - NEAR, 1)[:, None, None]).astype(np.int64), beside


def sampled(walked: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sampled bytes of every walk, (start, walk, repetition, sign): one repetition is one key."""
    first, beside = places(sizes)
    who, walk = np.arange(len(sizes))[:, None, None, None], np.arange(WALKS)[None, :, None, None]
    return walked[first[..., None] + beside, who, walk]


def met(walked: np.ndarray, sizes: np.ndarray, keys: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Whether any key of a start equals that of its item; byte after byte, for the keys still equal."""
    first, beside = places(sizes)
    who, walk, turn = (np.arange(n) for n in first.shape)
    who, walk, turn = (x.ravel() for x in np.broadcast_arrays(who[:, None, None], walk[None, :, None], turn[None, None, :]))
    first = first.ravel()
    for sign in range(SIGNS):
        same = np.flatnonzero(walked[first + beside[walk, turn, sign], who, walk] == keys[items[who], walk, turn, sign])
        first, who, walk, turn = first[same], who[same], walk[same], turn[same]
    return np.bincount(who, minlength=len(sizes)) > 0


class Items:
    """Normalised items, the places of their grams by hash slot, and their keys under every walk and sample."""

    def __init__(self, rows: list[tuple[int, str]]):
        import pyarrow as pa
        self.ids, self.texts, self.short = [], [], []
        joined, first, sizes = normal_bytes(*text_bytes(pa.array([text for _, text in rows], pa.large_string())))
        for (item_id, _), start, size in zip(rows, first, sizes):
            text = joined[start:start + size].tobytes()
            if size:
                self.short += [len(self.ids)] if size < SHORT else []
                self.ids.append(item_id)
                self.texts.append(text)
        self.longest = max(map(len, self.texts), default=0)
        self.piece = max(PIECE, 8 * self.longest)
        made = [gram_slots(np.frombuffer(text, dtype=np.uint8))[:max(0, len(text) - GRAM + 1) if len(text) >= SHORT else 0] for text in self.texts]
        known = np.bincount(np.concatenate([np.zeros(0, dtype=np.int32), *made]), minlength=1 << SLOT_BITS)
        # The grams of an item that fewest items have; places in the item.
        kept = [np.argsort(known[g], kind="stable")[:-(-len(g) // KEPT)] for g in made]
        slots = np.concatenate([np.zeros(0, dtype=np.int32), *(g[k] for g, k in zip(made, kept))])
        # A hit is one number, (item, diagonal): the item's share of it plus the place in the piece.
        self.span = 2 * self.piece + 4 * self.longest
        base = np.concatenate([np.zeros(0, dtype=np.int64), *(item * self.span + self.longest - k for item, k in enumerate(kept))])
        order = np.argsort(slots, kind="stable")
        self.base = base[order]
        self.counts = np.bincount(slots, minlength=1 << SLOT_BITS).astype(np.int32)
        self.starts = (np.cumsum(self.counts, dtype=np.int64) - self.counts)
        self.sizes = np.array([len(text) for text in self.texts], dtype=np.int64)
        self.allowed = ((1 - SIMILARITY) * self.sizes + 1e-9).astype(np.int64)
        self.least = np.maximum(self.sizes // SHARE, 2)
        self.keys = np.zeros((len(self.ids), WALKS, REPETITIONS, SIGNS), dtype=np.uint8)
        for own in self.parts(np.arange(len(self.ids))):
            steps = 2 * int(self.sizes[own].max())
            data, heads = stacked([self.texts[i] for i in own], steps)
            self.keys[own] = sampled(walks(data, heads, steps), self.sizes[own])

    def parts(self, items: np.ndarray):
        """Indices of ``items``, longest items first, in parts whose walks take ``WALKED`` bytes at most (or one item)."""
        order = np.argsort(-self.sizes[items], kind="stable")
        at = 0
        while at < len(order):
            count = max(1, int(WALKED // (2 * WALKS * self.sizes[items[order[at]]])))
            yield order[at:at + count]
            at += count

    def placed(self, joined: np.ndarray):
        """(item, start) of windows over the stream where probed grams of an item gather on near diagonals."""
        slots = gram_slots(joined)
        size, overlap = self.piece, 2 * self.longest
        items, starts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for begin in range(0, len(slots), size - overlap):
            part = slots[begin:begin + size]
            counts = self.counts[part]
            known = np.flatnonzero(counts)
            counts = counts[known]
            shift = np.cumsum(counts, dtype=np.int64) - counts
            pair = np.repeat(self.starts[part[known]] - shift, counts)
            pair += np.arange(len(pair))
            hits = np.sort(self.base[pair] + np.repeat(known, counts))
            item = hits // self.span
            last = np.arange(len(hits)) + self.least[item] - 1
            inside = np.flatnonzero(last < len(hits))
            dense = inside[hits[last[inside]] - hits[inside] <= self.allowed[item[inside]]]
            if len(dense):
                # All hits of the dense stretches.
                cover = np.zeros(len(hits) + 1, dtype=np.int64)
                np.add.at(cover, dense, 1)
                np.add.at(cover, last[dense] + 1, -1)
                member = np.flatnonzero(np.cumsum(cover[:-1]))
                # Of the diagonals in one step the one with the most hits.
                diagonals, votes = np.unique(hits[member], return_counts=True)
                own = diagonals // self.span
                diagonal = diagonals - own * self.span
                cell = own * self.span + diagonal // np.maximum(self.sizes[own] // WINDOW_STEPS, 1)
                order = np.lexsort((-votes, cell))
                lead = order[np.r_[True, np.diff(cell[order]) > 0]]
                items.append(own[lead])
                starts.append(np.maximum(diagonal[lead] - self.longest + begin, 0))
        found = np.unique(np.concatenate(items) * (len(joined) + 1) + np.concatenate(starts))
        return found // (len(joined) + 1), found % (len(joined) + 1)

    def areas(self, joined: np.ndarray):
        """(item, first place, last place) of the parts of a stream that may hold a copy of an item."""
        items, starts = self.placed(joined)
        if len(items):
            data = np.concatenate([joined, np.zeros(4 * self.longest + 8, dtype=np.uint8)])
            near = np.zeros(len(items), dtype=bool)
            for own in self.parts(items):
                sizes = self.sizes[items[own]]
                near[own] = met(walks(data, starts[own], 2 * int(sizes.max())), sizes, self.keys, items[own])
            items, starts = items[near], starts[near]
            slack = 2 * self.allowed[items]
            yield from zip(items.tolist(), np.maximum(starts - slack, 0).tolist(), (starts + self.sizes[items] + slack).tolist())
        stream = joined.tobytes()
        for number in self.short:
            # Short items count only as whole words, unchanged.
            text, at = self.texts[number], -1
            while (at := stream.find(text, at + 1)) >= 0:
                end = at + len(text)
                if (at == 0 or stream[at - 1] in (0, 32)) and (end == len(stream) or stream[end] in (0, 32)):
                    yield number, at, end


def stacked(texts: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other with room for ``steps`` behind each, and where they start."""
    sizes = np.array([len(t) + steps for t in texts])
    heads = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()) + 1, dtype=np.uint8)
    for text, place in zip(texts, heads):
        data[place:place + len(text)] = np.frombuffer(text, dtype=np.uint8)
    return data, heads


def merged(areas) -> list[tuple[int, int, int]]:
    """The areas of each item with those that overlap made one."""
    out: list[tuple[int, int, int]] = []
    for item, low, high in sorted(areas):
        if out and out[-1][0] == item and low <= out[-1][2]:
            out[-1] = item, out[-1][1], max(high, out[-1][2])
        else:
            out.append((item, low, high))
    return out


def last_row(item: str, text: str, limit: int, anchored: bool = False) -> np.ndarray | None:
    """Smallest edit distances between ``item`` and the parts of ``text`` that end at each place, or with ``anchored``
    its beginnings; none if all are above ``limit``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    place = np.arange(len(codes) + 1)
    row = place.copy() if anchored else np.zeros(len(codes) + 1, dtype=np.int64)
    for number, sign in enumerate(item):
        code = ord(sign)
        below = np.empty_like(row)
        below[0] = number + 1
        below[1:] = np.minimum(row[:-1] + (codes != code), row[1:] + 1)
        # Insertions: running minimum along the row.
        row = np.minimum.accumulate(below - place) + place
        if row.min() > limit:
            return None
    return row


def part_distance(item: str, text: str, limit: int) -> int:
    """Smallest edit distance between ``item`` and any part of ``text``; ``limit`` + 1 if it is larger."""
    if item in text:
        return 0
    row = last_row(item, text, limit)
    return limit + 1 if row is None else int(row.min())


def within(item: str, text: str, limit: int) -> bool:
    """Whether the edit distance between ``item`` and some part of ``text`` is at most ``limit``: Myers' bit-parallel columns."""
    places: dict[str, int] = {}
    for number, sign in enumerate(item):
        places[sign] = places.get(sign, 0) | 1 << number
    full, top, distance = (1 << len(item)) - 1, 1 << (len(item) - 1), len(item)
    up, down, get = full, 0, places.get
    if distance <= limit:
        return True
    for sign in text:
        here = get(sign, 0) | down
        same = (((here & up) + up) ^ up) | here
        more, less = down | (full & ~(same | up)), up & same
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
            if distance <= limit:
                return True
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(same | more)), more & same
    return False


def best_part(item: str, text: str, limit: int) -> tuple[int, int] | None:
    """Smallest edit distance between ``item`` and any part of ``text``, and where the first such part starts; none
    above ``limit``."""
    if item in text:
        return 0, text.index(item)
    if not within(item, text, limit):
        return None
    row = last_row(item, text, limit)
    end = int(row.argmin())
    back = last_row(item[::-1], text[:end][::-1], limit, anchored=True)
    return int(row[end]), end - int(back.argmin())


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, distance, similarity, first_word), one row per document and item found in it: the
    best part, the first among equals; first_word is the number of the word it starts in.

    ``documents`` needs doc_id, text_hash and text. Items under ``SHORT`` bytes match unchanged and as whole words only:
    near copies of them would be met by chance. Null and empty texts and items match nothing. The items travel in slices of measured size; each
    slice is one more reading of the texts.
    """
    plain = documents.select("doc_id", "text_hash", F.lower("text").alias("text"))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    found = None
    for part in bounded_slices(items, "item_id", limit=ITEMS_LIMIT):
        rows = [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]
        one = _matches(plain, shared(documents, Items(rows)))
        found = one if found is None else found.unionByName(one)
    return found


def _matches(plain: DataFrame, index) -> DataFrame:
    def work(batch):
        held = index.value
        if not held.ids:
            return None
        joined, first, sizes = normal_bytes(*text_bytes(batch.column("text")))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for number, low, high in merged(held.areas(joined)):
            text = held.texts[number].decode()
            allowed = int((1 - SIMILARITY) * len(text) + 1e-9)
            for row in range(int(np.searchsorted(first, low, side="right")) - 1, int(np.searchsorted(first, high, side="left"))):
                a, b = max(low, int(first[row])), min(high, int(first[row] + sizes[row]))
                known = best.get((row, number))
                if b - a < len(held.texts[number]) - 4 * allowed or known is not None and known[0] == 0:
                    continue
                around = joined[a:b].tobytes()
                found = best_part(text, around.decode("utf-8", "replace"), allowed if known is None else known[0])
                if found is None:
                    continue
                start = a + len(around.decode("utf-8", "replace")[:found[1]].encode())
                word = int((joined[first[row]:start + 1] == 32).sum())
                if known is None or (found[0], word) < known:
                    best[row, number] = found[0], word
        if not best:
            return None
        doc_ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
        out = sorted(best.items())
        distances = [d for _, (d, _) in out]
        return [[doc_ids[r] for (r, _), _ in out], [hashes[r] for (r, _), _ in out], [held.ids[n] for (_, n), _ in out], distances,
                [1 - d / len(held.texts[n].decode()) for ((_, n), (d, _)) in out], [w for _, (_, w) in out]]

    return map_batches(plain, work, "doc_id long, text_hash long, item_id long, distance int, similarity double, first_word long")


def keyed(documents: DataFrame) -> DataFrame:
    """With ``__doc`` and ``__hash``, which tell rows apart that share an id or have none."""
    return documents.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__hash": F.xxhash64("text")})


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark item. Rows are judged one by one."""
    rows = keyed(documents)
    found = matches(rows.select(F.col("__doc").alias("doc_id"), F.col("__hash").alias("text_hash"), "text"), benchmark)
    bad = materialize(found.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct())
    return joined_small(rows, bad, ["__doc", "__hash"], "left_anti").select(*documents.columns)


@query("op3_benchmark_decontamination")
def op3_benchmark_decontamination(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return matches(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
