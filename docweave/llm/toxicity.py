"""Toxicity: two class-conditional Kneser-Ney models, toxic and ordinary, compared by length-normalised log-likelihood.

Lower-cased words are hashed to slots. Each class has a bigram model (a word after a hashed class of its
predecessor) that backs off to a continuation model (in how many documents the word continues a text), which
backs off to a count that both classes share, the number of classes that know the word: a rare expression
takes its probability from there and says nothing about the class. A repeat within one document counts once. The larger class is scaled to the
size of the smaller, else it would know more rare words. All training rows are counted; the tables have a
fixed length, whatever the input.

Two numbers per text go through a logistic curve: the mean log ratio over the whole text, and the log ratio of
its strongest single expression, the same comparison over one word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docweave.llm.arrays import IN_WORD, fold, map_batches, row_sums, shared, slices, small_batches, words
from docweave.llm.registry import query
from docweave.llm.tables import labelled, summed
from docweave.runtime import materialize


@dataclass(frozen=True)
class Setting:
    word_slots: int = 1 << 20
    pair_slots: int = 1 << 17
    contexts: int = 8
    discount: float = 0.9
    word_discount: float = 1.0
    folds: int = 5
    held_fold: int = 0
    calibration_fold: int = 4
    prior: float = 1.0

    @property
    def size(self) -> int:
        return self.word_slots + self.pair_slots * self.contexts


def events(column, setting: Setting):
    """Word slot, bigram slot and row of every word. The first word of a text follows context 0."""
    hashes, rows, _, _, offsets = words(column, IN_WORD)
    before = np.zeros(len(hashes), dtype=np.int64)
    if len(hashes) > 1:
        before[1:] = np.where(rows[1:] == rows[:-1], (hashes[:-1] >> np.uint64(40)).astype(np.int64) % (setting.contexts - 1) + 1, 0)
    word = (hashes % np.uint64(setting.word_slots)).astype(np.int64)
    pair = setting.word_slots + (hashes % np.uint64(setting.pair_slots)).astype(np.int64) * setting.contexts + before
    return word, pair, rows, len(offsets) - 1


def ratios(counts: np.ndarray, setting: Setting) -> np.ndarray:
    """log p(event | toxic) - log p(event | ordinary) of every word slot and bigram slot.

    ``counts`` is (2, size): ordinary, toxic. If a class has no count, all ratios are 0.
    """
    counts = counts.reshape(2, setting.size).astype(np.float64)
    single = counts[:, :setting.word_slots]
    sizes = single.sum(axis=1)
    if not sizes.all():
        return np.zeros(setting.size, dtype=np.float32)
    counts = counts * (sizes.min() / sizes)[:, None]
    single = counts[:, :setting.word_slots]
    pairs = counts[:, setting.word_slots:].reshape(2, setting.pair_slots, setting.contexts)

    def continuation(kinds):
        classes = (kinds > 0).sum(axis=0) + 0.5
        backoff = classes / classes.sum()
        own = np.maximum(kinds - setting.word_discount, 0) / kinds.sum(axis=1, keepdims=True)
        return own + (1 - own.sum(axis=1, keepdims=True)) * backoff

    word_logs = np.log(continuation(single))
    lower = continuation(pairs.sum(axis=2))
    direct = np.maximum(pairs - setting.discount, 0) / np.maximum(pairs.sum(axis=1, keepdims=True), 1e-9)
    left = 1 - direct.sum(axis=1, keepdims=True)
    pair_logs = np.log(direct + left * lower[:, :, None])
    return np.concatenate([word_logs[1] - word_logs[0], (pair_logs[1] - pair_logs[0]).reshape(-1)]).astype(np.float32)


def fit_logistic(rows: DataFrame, columns: list[str], label: str, prior: float) -> np.ndarray:
    """Weights of ``columns`` and an intercept over all rows, by damped Newton steps with a normal prior on the weights.

    Every step is one aggregate over the rows; the driver gets its sums only. Their last digits depend on the order of the
    rows, so a step that promises less than that noise is the last: where the classes lie apart, the weights themselves never
    stand still.
    """
    penalty = np.array([prior] * len(columns) + [1e-3])
    inputs = [*(F.col(c) for c in columns), F.lit(1.0)]
    pairs = [(i, j) for i in range(len(inputs)) for j in range(i + 1)]

    def sums(w):
        """Loss, gradient and second derivatives at weights ``w``."""
        z = sum((x * F.lit(float(v)) for x, v in zip(inputs, w)), F.lit(0.0))
        p, y = F.col("_p"), F.col(label)
        found = rows.withColumn("_z", z).withColumn("_p", 1 / (1 + F.exp(-F.greatest(F.least("_z", F.lit(500.0)), F.lit(-500.0))))).agg(
            F.sum(F.greatest("_z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - y * F.col("_z")),
            *(F.sum((p - y) * x) for x in inputs), *(F.sum(p * (1 - p) * inputs[i] * inputs[j]) for i, j in pairs)).first()
        second = np.diag(penalty)
        for (i, j), value in zip(pairs, found[1 + len(inputs):]):
            second[i, j] += value
            second[j, i] = second[i, j]
        return found[0] + 0.5 * (penalty * w * w).sum(), np.array(found[1:1 + len(inputs)]) + penalty * w, second

    weights = np.zeros(len(inputs))
    loss, gradient, second = sums(weights)
    for _ in range(100):
        step = np.linalg.solve(second, gradient)
        gain, noise = gradient @ step, 1e-10 * (1 + abs(loss))
        size, made = 1.0, sums(weights - step)
        while made[0] > loss + noise and size > 1e-6:
            size /= 2
            made = sums(weights - size * step)
        weights, (loss, gradient, second) = weights - size * step, made
        if gain < noise:
            break
    return weights


def measures(column, table: np.ndarray, setting: Setting) -> np.ndarray:
    """Per row: mean log ratio over all words, and the largest log ratio of one word; both 0 without words."""
    word, pair, rows, count = events(column, setting)
    mean = row_sums(table[pair], rows, count) / np.maximum(np.bincount(rows, minlength=count), 1)
    peak = np.zeros(count)
    if len(rows):
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        peak[rows[heads]] = np.maximum.reduceat(table[word], heads)
    return np.column_stack([mean, peak])


def train(documents: DataFrame, labels: DataFrame, setting: Setting = Setting()) -> tuple[np.ndarray, np.ndarray]:
    """Ratio table and weights of the logistic curve.

    Folds by crc32(doc_id): ``held_fold`` is never read, all rows of the others are counted. All rows of
    ``calibration_fold`` fit the curve; they are measured with the counts of the other folds, since a row knows its own
    expressions.
    """
    rows = labelled(documents, labels, "toxic").withColumn("fold", fold(F.col("doc_id"), setting.folds))
    size = setting.size

    def add(table, batch):
        word, pair, row, _ = events(batch.column("text"), setting)
        part = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64) + 2 * batch.column("own").to_numpy(zero_copy_only=False).astype(np.int64)
        if len(word):
            keys = np.unique(np.concatenate([row * size + word, row * size + pair]))
            np.add.at(table, keys % size + size * part[keys // size], 1)

    own = F.col("fold") == setting.calibration_fold
    counts = summed(rows.where(F.col("fold") != setting.held_fold).select("text", "label", own.alias("own")), 4 * size, "int32", add).reshape(2, 2 * size)
    table = ratios(counts.sum(axis=0), setting)
    model = shared(documents, ratios(counts[0], setting))

    def work(batch):
        found = measures(batch.column("text"), model.value, setting)
        return [found[:, 0], found[:, 1], batch.column("label")]

    measured = materialize(map_batches(rows.where(own & (F.col("fold") != setting.held_fold)).select("text", "label"), work,
                                       "mean double, peak double, label int"))
    if measured.select("label").distinct().count() < 2:
        return table, np.array([1.0, 1.0, -1.0])
    return table, fit_logistic(measured, ["mean", "peak"], "label", setting.prior)


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], setting: Setting = Setting()) -> DataFrame:
    """(doc_id, held_out, score, predicted, mean_ratio, peak_ratio) for every row, repeated ids included.

    A null or empty text, or one without words, has both ratios 0. Other columns of the input are not kept.
    """
    table, weights = model
    ratio_table = shared(documents, table)

    def work(batch):
        found = measures(batch.column("text"), ratio_table.value, setting)
        probability = 1 / (1 + np.exp(-np.clip(found @ weights[:2] + weights[2], -500, 500)))
        return [batch.column("doc_id"), batch.column("held_out"), probability, (probability >= 0.5).astype(np.int32), found[:, 0], found[:, 1]]

    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                             F.coalesce(fold(F.col("doc_id"), setting.folds) == setting.held_fold, F.lit(False)).alias("held_out"), F.lower("text").alias("text"))
    return map_batches(named, work, "doc_id long, held_out boolean, score double, predicted int, mean_ratio double, peak_ratio double")


def keep_ordinary(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], setting: Setting = Setting()) -> DataFrame:
    """The documents, all columns and rows, that score below 0.5. Rows without an id or with the same id are judged one by one."""
    table, weights = model
    ratio_table = shared(documents, table)

    @F.arrow_udf("boolean")
    def ordinary(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        kept = [measures(texts.slice(start, stop - start), ratio_table.value, setting) @ weights[:2] + weights[2] < 0 for start, stop in slices(batch)]
        return pa.array(np.concatenate(kept) if kept else [], pa.bool_())

    return small_batches(documents).where(ordinary(F.lower("text")))


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, train(documents.withColumn("text", F.lower("text")), spark.read.parquet(f"{sf_dir}/labels.parquet")))
