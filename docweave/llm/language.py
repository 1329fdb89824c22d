"""Language: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased code points; runs of anything but letters count as one space. N-grams of 1 to 3
characters are hashed to a fixed number of slots. The matrix of log probabilities, languages by slots, is
broadcast; a batch is scored as sums of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docweave.llm.arrays import fold, map_batches, mix, shared
from docweave.llm.registry import query
from docweave.llm.tables import summed


@dataclass(frozen=True)
class Setting:
    slots: int = 1 << 16
    orders: tuple[int, ...] = (1, 2, 3)
    folds: int = 4
    held_fold: int = 2
    smoothing: float = 0.1


def grams(column, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Slot and row of every n-gram of the texts, which hold letters and single spaces only; an n-gram stays in its row."""
    texts = pc.fill_null(column, "").to_pylist()
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    slots, owners = [], []
    combined = np.zeros(len(codes), dtype=np.uint64)
    for order in range(1, max(setting.orders) + 1):
        reach = len(codes) - order + 1
        if reach <= 0:
            break
        combined = combined[:reach] * np.uint64(0x100000001B3) + codes[order - 1:] + np.uint64(1)
        if order in setting.orders:
            own = rows[:reach] == rows[order - 1:]
            slots.append((mix(combined + np.uint64(order << 56)) % np.uint64(setting.slots)).astype(np.int32)[own])
            owners.append(rows[:reach][own])
    if not slots:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    return np.concatenate(slots), np.concatenate(owners)


def lettered(text):
    """Letters in lower case; everything between them is one space."""
    return F.lower(F.regexp_replace(text, r"\P{L}+", " "))


def train(documents: DataFrame, setting: Setting = Setting()) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (languages x slots), from all rows with text and language outside the held fold."""
    known = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), setting.folds) != setting.held_fold))
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    place = {name: number for number, name in enumerate(languages)}

    def add(table, batch):
        slots, rows = grams(batch.column("text"), setting)
        number = np.array([place[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
        if len(slots):
            table += np.bincount(number[rows] * setting.slots + slots, minlength=len(table)).astype(table.dtype)

    if not languages:
        return [], np.zeros((0, setting.slots), dtype=np.float32)
    counts = summed(known.select(lettered(F.col("text")).alias("text"), "lang"), len(languages) * setting.slots, "int64", add).reshape(len(languages), -1)
    smooth = counts + setting.smoothing
    return languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], setting: Setting = Setting()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score). Without text, letters or learned languages the prediction is ``und`` with score 0.

    Ties go to the language that sorts first. The score is the posterior under equal priors.
    """
    languages, logs = model
    table = shared(documents, np.ascontiguousarray(logs))

    def work(batch):
        count = batch.num_rows
        slots, rows = grams(batch.column("text"), setting)
        held = [batch.column("doc_id"), batch.column("held_out")]
        if not languages:
            return [*held, ["und"] * count, np.zeros(count)]
        sums = np.stack([np.bincount(rows, weights=part[slots], minlength=count) for part in table.value], axis=1)
        best = sums.argmax(axis=1)
        score = 1 / np.exp(np.clip(sums - sums.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
        lettered_rows = batch.column("lettered").to_numpy(zero_copy_only=False)
        return [*held, [languages[b] if ok else "und" for b, ok in zip(best, lettered_rows)], np.where(lettered_rows, score, 0.0)]

    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), setting.folds) == setting.held_fold, F.lit(False)).alias("held_out"),
                             F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), lettered(F.col("text")).alias("text"))
    return map_batches(named, work, "doc_id long, held_out boolean, lang_pred string, score double")


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(documents, train(documents))
