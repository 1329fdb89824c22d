"""Quality: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates.

Tokens are runs of letters and digits, runs of other visible signs, and line breaks, so markup and shouting
are tokens too. Features are the hashes of one and two consecutive tokens, weighted by log(1 + count) and
normalised to length 1, plus one for the logarithm of the token count. Shards of the labelled rows train
one FTRL-proximal model each, in several passes over their rows; a weight is averaged over the shards that saw its
slot, by their rows. A score is a sparse dot product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docweave.llm.arrays import BASE, IN_WORD, NOT_SPACE, fold, map_batches, mix, runs, shared, slices, small_batches, span_hashes, text_bytes
from docweave.llm.registry import query
from docweave.llm.tables import labelled, summed


@dataclass(frozen=True)
class Setting:
    slots: int = 1 << 18
    folds: int = 4
    held_fold: int = 2
    rows_per_shard: int = 8192
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 1.0
    threshold: float = 0.7


def features(column, setting: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and values of all rows of a slice, and the offsets of the rows in them."""
    raw, offsets = text_bytes(column)
    count = len(offsets) - 1
    spans = []
    for kind, member in enumerate((IN_WORD[raw], NOT_SPACE[raw] & ~IN_WORD[raw], raw == 10)):
        spans.append(runs(member, offsets))
    starts = np.concatenate([s[0] for s in spans])
    ends = np.concatenate([s[1] for s in spans])
    rows = np.concatenate([s[2] for s in spans])
    order = np.argsort(starts, kind="stable")
    starts, ends, rows = starts[order], ends[order], rows[order]
    hashes = span_hashes(raw, starts, ends)
    slots = [(hashes % np.uint64(setting.slots - 16)).astype(np.int64) + 16]
    owners = [rows]
    if len(hashes) > 1:
        same = rows[1:] == rows[:-1]
        pairs = mix(hashes[:-1] * BASE + hashes[1:])[same]
        slots.append((pairs % np.uint64(setting.slots - 16)).astype(np.int64) + 16)
        owners.append(rows[1:][same])
    keys, counts = np.unique(np.concatenate(owners) * setting.slots + np.concatenate(slots), return_counts=True)
    rows_of, slots_of = keys // setting.slots, keys % setting.slots
    values = np.log1p(counts)
    norms = np.sqrt(np.bincount(rows_of, weights=values * values, minlength=count))
    values = values / np.maximum(norms, 1e-12)[rows_of]
    length = np.minimum(np.log2(np.bincount(rows, minlength=count) + 1).astype(np.int64), 14)
    rows_of = np.concatenate([rows_of, np.arange(count), np.arange(count)])
    slots_of = np.concatenate([slots_of, np.zeros(count, dtype=np.int64), length + 1])
    values = np.concatenate([values, np.ones(count), np.full(count, 0.5)])
    order = np.argsort(rows_of, kind="stable")
    return slots_of[order], values[order], np.searchsorted(rows_of[order], np.arange(count + 1))


class Leader:
    """FTRL-proximal state of one shard."""

    def __init__(self, setting: Setting):
        self.setting = setting
        self.z, self.n = np.zeros(setting.slots), np.zeros(setting.slots)

    def weights(self, slots):
        s, z = self.setting, self.z[slots]
        held = np.abs(z) <= s.l1
        return np.where(held, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[slots])) / s.alpha + s.l2))

    def learn(self, slots, values, label):
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip((w * values).sum(), -30, 30)))
        g = (p - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.setting.alpha * w
        self.n[slots] = n + g * g


def train(documents: DataFrame, labels: DataFrame, setting: Setting = Setting()) -> np.ndarray:
    """Averaged weights of all shards. Every labelled row outside the held fold is in one shard, once per epoch.

    The passes are copies of the rows, sorted behind each other, so a shard holds one slice of texts and its model, however
    long its texts are.
    """
    rows = labelled(documents, labels, "quality").where(fold(F.col("doc_id"), setting.folds) != setting.held_fold)
    total = rows.select("doc_id").count()
    shards = max(1, -(-total // setting.rows_per_shard))
    order = F.xxhash64("doc_id")
    passes = F.explode(F.sequence(F.lit(1), F.lit(setting.epochs))).alias("epoch")
    dealt = rows.select("doc_id", "text", "label", passes).repartition(shards, order).sortWithinPartitions("epoch", order)

    def shard(batches):
        leader, rows = Leader(setting), 0
        for batch in batches:
            for start, stop in slices(batch):
                piece = batch.slice(start, stop - start)
                slots, values, offsets = features(piece.column("text"), setting)
                label = piece.column("label").to_numpy(zero_copy_only=False)
                for row in range(len(label)):
                    part = slice(offsets[row], offsets[row + 1])
                    leader.learn(slots[part], values[part], label[row])
                rows += len(label)
        if rows:
            used = np.flatnonzero(leader.n)
            yield pa.RecordBatch.from_pydict({"slots": pa.array([used.astype(np.int32).tobytes()], pa.binary()),
                                              "weights": pa.array([(leader.weights(used) * rows).tobytes()], pa.binary()), "text": pa.array([""]),
                                              "rows": pa.array([rows], pa.int64())})

    def add(table, batch):
        for slots, weights, rows in zip(batch.column("slots"), batch.column("weights"), batch.column("rows")):
            at = np.frombuffer(slots.as_py(), dtype=np.int32)
            table[at] += np.frombuffer(weights.as_py())
            table[at + setting.slots] += rows.as_py()

    table = summed(small_batches(dealt).mapInArrow(shard, "slots binary, weights binary, text string, rows long"), 2 * setting.slots, "float64", add)
    return (table[:setting.slots] / np.maximum(table[setting.slots:], 1)).astype(np.float32)


def score(documents: DataFrame, weights: np.ndarray, setting: Setting = Setting()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a null text scores as an empty one."""
    model = shared(documents, weights)

    def work(batch):
        slots, values, offsets = features(batch.column("text"), setting)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        dot = np.bincount(rows, weights=model.value[slots] * values, minlength=len(offsets) - 1)
        probability = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
        return [batch.column("doc_id"), batch.column("held_out"), probability, (probability >= setting.threshold).astype(np.int32)]

    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), setting.folds) == setting.held_fold, F.lit(False)).alias("held_out"), "text")
    return map_batches(named, work, "doc_id long, held_out boolean, score double, predicted int")


@query("op2_quality")
def op2_quality(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
