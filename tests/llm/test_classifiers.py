"""Toxicity, quality and language: held-out accuracy, folds, odd tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import helpers as h
from docweave.llm import language, quality, toxicity

INSULTS = ["snarlwit", "gutterfop", "mudbrain"]


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rng = random.Random(7)
    texts, marks = [], []
    for n in range(700):
        words = h.prose(n, rng.randrange(30, 120)).split()
        bad = n % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS).upper() if rng.random() < 0.3 else rng.choice(INSULTS))
        texts.append(" ".join(words))
        marks.append((n, 1, int(bad)))
    return h.documents(spark, texts), h.labels(spark, marks)


SMALL_TOXIC = toxicity.Setting(word_slots=1 << 14, pair_slots=1 << 11, contexts=4)


def test_toxicity_on_held_out_rows(spark, toxic_corpus):
    documents, labels = toxic_corpus
    scored = toxicity.score(documents, toxicity.train(documents.withColumn("text", F.lower("text")), labels, SMALL_TOXIC), SMALL_TOXIC).toPandas()
    assert len(scored) == 700 and scored.score.between(0, 1).all()
    assert all(held == (h.crc(i, 5) == 0) for i, held in zip(scored.doc_id, scored.held_out))
    right = (scored.predicted == (scored.doc_id % 5 == 0)) | ~scored.held_out
    assert right.mean() > 0.97
    kept = toxicity.keep_ordinary(documents, toxicity.train(documents.withColumn("text", F.lower("text")), labels, SMALL_TOXIC), SMALL_TOXIC)
    assert set(kept.toPandas().doc_id) == set(scored.doc_id[scored.predicted == 0]) and kept.columns == documents.columns


def test_toxicity_never_reads_held_out_labels(spark, toxic_corpus):
    documents, labels = toxic_corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    lowered = documents.withColumn("text", F.lower("text"))
    a, b = (toxicity.train(lowered, marks, SMALL_TOXIC) for marks in (labels, flipped))
    assert np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1])


def test_toxicity_counts_every_row_outside_the_held_out_fold(spark, toxic_corpus):
    documents, labels = toxic_corpus
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    toxic = (F.col("doc_id") % 5 == 0) & (fold == SMALL_TOXIC.calibration_fold)
    marked = documents.withColumn("text", F.when(toxic, F.concat("text", F.lit(" rarescorn"))).otherwise(F.col("text")))
    model = toxicity.train(marked.withColumn("text", F.lower("text")), labels, SMALL_TOXIC)
    peak = {r.doc_id: r.peak_ratio for r in toxicity.score(h.documents(spark, ["rarescorn", "neverseen"]), model, SMALL_TOXIC).collect()}
    assert peak[0] > 1 and peak[0] > peak[1] + 1


def test_toxicity_curve_is_fitted_on_every_calibration_row(spark):
    """Three times 50,000 rows of two kinds; the weights follow the counts of all of them, by plain gradient sums."""
    kinds = [(0.0, 0.5, 0, 60_000), (0.0, 0.5, 1, 15_000), (1.0, 2.0, 0, 5_000), (1.0, 2.0, 1, 70_000)]
    rows = spark.createDataFrame(kinds, "mean double, peak double, label int, n int").select(
        "mean", "peak", "label", F.explode(F.sequence(F.lit(1), "n")))
    weights = toxicity.fit_logistic(rows, ["mean", "peak"], "label", 1.0)
    table = np.array(kinds)
    x = np.column_stack([table[:, :2], np.ones(4)])
    error = table[:, 3] * (1 / (1 + np.exp(-x @ weights)) - table[:, 2])
    assert np.allclose(x.T @ error + np.array([1.0, 1.0, 1e-3]) * weights, 0, atol=1e-5)
    assert not hasattr(toxicity.Setting(), "calibration_rows")


def test_toxicity_curve_stands_still_although_sums_depend_on_the_order_of_rows(spark):
    """On a cluster the parts of a sum arrive in any order, so its last digits differ; that noise must not keep the steps going."""
    kinds = [(0.001, 0.5, 0, 9000), (0.001, 0.5, 1, 200), (0.002, 2.0, 0, 100), (0.002, 2.0, 1, 7000), (0.0, 1.0, 0, 800), (0.0, 1.0, 1, 900)]
    rows = spark.createDataFrame(kinds, "mean double, peak double, label int, n int").select(
        "mean", "peak", "label", F.explode(F.sequence(F.lit(1), "n")))
    draw, passes = np.random.default_rng(7), []

    class Arriving:
        def __init__(self, frame):
            self.frame = frame

        def withColumn(self, *column):
            return Arriving(self.frame.withColumn(*column))

        def agg(self, *sums):
            return Arriving(self.frame.agg(*sums))

        def first(self):
            passes.append(1)
            return [value + 1e-7 * draw.standard_normal() for value in self.frame.first()]

    weights = toxicity.fit_logistic(Arriving(rows), ["mean", "peak"], "label", 1.0)
    table = np.array(kinds)
    x = np.column_stack([table[:, :2], np.ones(len(kinds))])
    error = table[:, 3] * (1 / (1 + np.exp(-x @ weights)) - table[:, 2])
    assert np.allclose(x.T @ error + np.array([1.0, 1.0, 1e-3]) * weights, 0, atol=1e-5)
    assert len(passes) <= 30


def test_kneser_ney_probabilities_sum_to_one():
    setting = toxicity.Setting(word_slots=64, pair_slots=32, contexts=2)
    counts = np.random.default_rng(1).integers(0, 5, (2, setting.size))
    counts[:, :64] = np.maximum(counts[:, :64], 1)
    kinds = counts[:, :64].astype(float)
    own = np.maximum(kinds - setting.word_discount, 0) / kinds.sum(axis=1, keepdims=True)
    classes = (kinds > 0).sum(axis=0) + 0.5
    total = own + (1 - own.sum(axis=1, keepdims=True)) * classes / classes.sum()
    assert np.allclose(total.sum(axis=1), 1)
    assert np.isfinite(toxicity.ratios(counts, setting)).all()


@pytest.mark.parametrize("make", [h.odd, h.empty])
def test_toxicity_of_odd_tables(spark, toxic_corpus, make):
    documents, labels = toxic_corpus
    model = toxicity.train(documents.withColumn("text", F.lower("text")), labels, SMALL_TOXIC)
    table = make(spark)
    found = toxicity.score(table, model, SMALL_TOXIC).toPandas()
    assert len(found) == table.count() and found.score.between(0, 1).all()
    assert toxicity.keep_ordinary(table, model, SMALL_TOXIC).columns == table.columns
    if len(found):
        blank = found[found.doc_id.isin([1, 2, 3, 12])]
        assert blank.score.nunique() == 1


def test_training_without_labels_gives_neutral_ratios(spark):
    model = toxicity.train(h.odd(spark), h.labels(spark, []), SMALL_TOXIC)
    assert not model[0].any()
    assert quality.train(h.odd(spark), h.labels(spark, []), quality.Setting(slots=1 << 12)).sum() == 0


@pytest.fixture(scope="module")
def quality_corpus(spark):
    texts, marks = [], []
    for n in range(600):
        good = n % 4 != 0
        words = h.prose(n, 60).split()
        texts.append(" ".join(words) if good else " | ".join(w.upper() + "!!" for w in words))
        marks.append((n, int(good), 0))
    return h.documents(spark, texts), h.labels(spark, marks)


def test_quality_on_held_out_rows(spark, quality_corpus):
    documents, labels = quality_corpus
    setting = quality.Setting(slots=1 << 14, rows_per_shard=200)
    scored = quality.score(documents, quality.train(documents, labels, setting), setting).toPandas()
    assert all(held == (h.crc(i, 4) == 2) for i, held in zip(scored.doc_id, scored.held_out))
    assert ((scored.predicted == (scored.doc_id % 4 != 0)) | ~scored.held_out).mean() > 0.97
    assert ((scored.score >= 0.7) == (scored.predicted == 1)).all()


def test_leader_updates_follow_the_closed_form():
    setting = quality.Setting(slots=32)
    leader = quality.Leader(setting)
    slots, values = np.array([0, 20]), np.array([1.0, 0.5])
    z, n = np.zeros(32), np.zeros(32)
    for label in (1, 0, 1, 1):
        w = np.where(np.abs(z[slots]) <= setting.l1, 0, -(z[slots] - np.sign(z[slots]) * setting.l1) / ((setting.beta + np.sqrt(n[slots])) / setting.alpha + setting.l2))
        g = (1 / (1 + np.exp(-(w * values).sum())) - label) * values
        z[slots] += g - (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / setting.alpha * w
        n[slots] += g * g
        leader.learn(slots, values, label)
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)


def test_quality_training_passes_over_its_rows_and_averages_by_slot(spark, quality_corpus):
    """One model per shard, trained by hand on the shard's rows in their order, epoch after epoch; each slot over the shards that saw it."""
    documents, labels = quality_corpus
    for rows_per_shard, epochs in ((10_000, 1), (10_000, 3), (150, 2)):
        setting = quality.Setting(slots=1 << 14, rows_per_shard=rows_per_shard, epochs=epochs)
        marked = documents.join(labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label")), "doc_id").where(
            F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
        order = F.xxhash64(F.col("doc_id").cast("long"))
        shards = -(-marked.count() // rows_per_shard)
        rows = marked.select("text", "label", F.pmod(F.hash(order), F.lit(shards)).alias("shard"), order.alias("o")).orderBy("o").collect()
        total, seen = np.zeros(setting.slots), np.zeros(setting.slots)
        for shard in range(shards):
            mine = [r for r in rows if r["shard"] == shard]
            leader = quality.Leader(setting)
            for _ in range(epochs):
                for row in mine:
                    slots, values, _ = quality.features(pa.array([row["text"]], pa.string()), setting)
                    leader.learn(slots, values, row["label"])
            used = np.flatnonzero(leader.n)
            total[used] += leader.weights(used) * len(mine)
            seen[used] += len(mine)
        assert (shards > 1) == (rows_per_shard == 150)
        assert np.allclose(quality.train(documents, labels, setting), total / np.maximum(seen, 1), atol=1e-5)


@pytest.mark.parametrize("make", [h.odd, h.empty])
def test_quality_of_odd_tables(spark, quality_corpus, make):
    documents, labels = quality_corpus
    setting = quality.Setting(slots=1 << 12)
    table = make(spark)
    found = quality.score(table, quality.train(documents, labels, setting), setting).toPandas()
    assert len(found) == table.count() and found.score.between(0, 1).all()


LANGUAGES = {"aa": "the and of with that from this there", "bb": "der die und nicht schön über straße", "cc": "le la où élève très garçon une"}


@pytest.fixture(scope="module")
def language_model(spark):
    rng = random.Random(3)
    rows = []
    for n in range(300):
        lang = ("aa", "bb", "cc")[n % 3]
        rows.append((n, " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(20)), lang, "s", 0))
    frame = spark.createDataFrame(rows, h.DOCUMENT)
    return frame, language.train(frame)


def test_language_on_held_out_rows(spark, language_model):
    frame, model = language_model
    assert model[0] == ["aa", "bb", "cc"] and np.allclose(np.exp(model[1].astype(float)).sum(axis=1), 1, atol=1e-3)
    found = language.predict(frame, model).join(frame.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() == 1.0
    assert all(held == (h.crc(i, 4) == 2) for i, held in zip(found.doc_id, found.held_out))


def test_language_ignores_held_out_rows(spark, language_model):
    frame, model = language_model
    changed = frame.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    again = language.train(changed)
    assert again[0] == model[0] and np.array_equal(again[1], model[1])


def test_language_of_odd_tables(spark, language_model):
    _, model = language_model
    found = language.predict(h.odd(spark), model).toPandas()
    assert len(found) == len(h.odd_rows()) and found.score.between(0, 1).all()
    assert set(found.lang_pred[found.doc_id.isin([1, 2, 3, 12])]) == {"und"}
    assert language.predict(h.empty(spark), model).count() == 0
    untrained = language.predict(h.odd(spark), language.train(h.empty(spark))).toPandas()
    assert set(untrained.lang_pred) == {"und"}
