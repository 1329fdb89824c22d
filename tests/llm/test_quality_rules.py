"""Quality rules against plain restatements: figures, exact binomial tails, certified cut-offs, verdicts."""

import collections
import math
import random
import re
from fractions import Fraction

import pytest

import helpers as h
from docweave.llm import quality_rules as qr


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    times = collections.Counter(windows)
    covered = {k + j for k, window in enumerate(windows) if times[window] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))


def figures_of(spark, texts):
    rows = qr.figures(h.documents(spark, texts)).collect()
    return {r["doc_id"]: tuple(r[name] for name in qr.FIGURES) for r in rows}


def test_figures_of_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b ", "c\n", "#", " ", "\n", "\t", "\r", "é", "日 "]) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in range(100)]
    found = figures_of(spark, texts)
    assert found == {n: plain(t) for n, t in enumerate(texts)}


def test_figures_of_odd_rows(spark):
    rows = qr.figures(h.odd(spark)).collect()
    assert collections.Counter((r["doc_id"], *(r[n] for n in qr.FIGURES)) for r in rows) == collections.Counter((r[0], *plain(r[1])) for r in h.odd_rows())


def exact_tail(x, n, rate):
    p = Fraction(rate)
    return float(sum(math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(x + 1)))


def test_binomial_tail(spark):
    cases = [(x, n) for n in (1, 5, 40, 300, 2000) for x in (0, 1, 2, 5, 9) if x <= n]
    frame = spark.createDataFrame(cases, "x long, n long")
    for rate in (0.005, 0.05, 0.3):
        for r in frame.withColumn("tail", qr.binomial_tail("x", "n", rate)).collect():
            expected = exact_tail(r["x"], r["n"], rate) if r["x"] < r["n"] * rate else 1.0
            assert r["tail"] == pytest.approx(expected, rel=1e-9)


def test_binomial_tail_of_large_counts(spark):
    """Against the sum of all terms in logarithms."""
    n, rate = 2_000_000, 0.005
    for x in (9_000, 9_700, 9_900):
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate) for k in range(x + 1)]
        top = max(logs)
        expected = math.exp(top) * math.fsum(math.exp(v - top) for v in logs)
        tail = spark.createDataFrame([(x, n)], "x long, n long").select(qr.binomial_tail("x", "n", rate)).first()[0]
        assert tail == pytest.approx(expected, rel=1e-5)


def measured(spark, rows):
    """rows: doc_id, stratum, symbols per 1000 words."""
    return spark.createDataFrame([(d, s, False, 1000, 5000, symbols, 0, 0, 10) for d, s, symbols in rows],
                                 "doc_id long, stratum string, base_failed boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")


def test_cutoffs_are_the_best_certified_ones(spark):
    rows, labels = [], []

    def add(stratum, symbols, quality, times):
        for _ in range(times):
            labels.append((len(rows), quality, 0))
            rows.append((len(rows), stratum, symbols))
    add("large", 10, 1, 3000), add("large", 150, 1, 3), add("large", 300, 0, 40), add("large", 120, 0, 10)
    add("strict fails", 10, 1, 3000), add("strict fails", 60, 1, 400), add("strict fails", 300, 0, 40), add("strict fails", 60, 0, 300)
    add("small", 10, 1, 100), add("small", 300, 0, 100)
    add("no bad ones", 10, 1, 3000)
    found = {r["stratum"]: r.asDict() for r in qr.cutoffs(measured(spark, rows), h.labels(spark, labels)).collect()}
    assert found["large"]["cut_symbols"] == 100 and found["strict fails"]["cut_symbols"] == 200
    assert set(found) == {"large", "strict fails"} and all(r[f"cut_{rule.name}"] is None for r in found.values() for rule in qr.RULES if rule.name != "symbols")


def test_guarantee_over_many_holdouts(spark):
    """True false-rejection rates over the limit are certified in no more than the stated share of trials."""
    rng = random.Random(11)
    n, rate, trials = 2000, 0.01, 400
    rows = []
    for trial in range(trials):
        failed = sum(rng.random() < rate * 1.0001 for _ in range(n))
        rows.append((f"s{trial}", n, 10, "symbols", 0, 500, failed, 5))
    cells = spark.createDataFrame(rows, "stratum string, good long, bad long, rule string, level int, cutoff int, good_failed long, bad_failed long")
    one_each = qr.certified(cells, 1, rate, 0.05 * len(qr.RULES))  # 0.05 a test
    assert one_each.where("certified").count() <= 0.05 * trials + 3 * math.sqrt(0.05 * 0.95 * trials)
    assert qr.certified(cells, trials, rate, 0.05).where("certified").count() == 0


def test_first_failure_ends_the_test(spark):
    cells = spark.createDataFrame([("s", 5000, 10, "symbols", level, 500 - level, failed, 5) for level, failed in enumerate((0, 2, 100, 0, 0))],
                                  "stratum string, good long, bad long, rule string, level int, cutoff int, good_failed long, bad_failed long")
    assert sorted(r["level"] for r in qr.certified(cells, 1).where("certified").collect()) == [0, 1]


@pytest.mark.parametrize("make", [h.odd, h.empty])
def test_verdicts_of_odd_tables(spark, make):
    labels = h.labels(spark, [(1, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (7, None, None), (9, 7, 1)])
    rows = qr.quality_rules(make(spark), labels).collect()
    expected = [r for r in h.odd_rows()] if make is h.odd else []
    assert collections.Counter((r["doc_id"], r["kept"]) for r in rows) == collections.Counter(
        (r[0], plain(r[1])[0] >= 10 and 100 * plain(r[1])[4] <= 20 * plain(r[1])[0]) for r in expected)
    assert all(r["failed_rules"] == [] for r in rows)


def test_rules_apply_by_stratum(spark):
    limits = spark.createDataFrame([("a", 100, None, None, None, None, 2000)], "stratum string, " + ", ".join(f"cut_{r.name} int" for r in qr.RULES))
    rows = qr.judge(measured(spark, [(1, "a", 101), (2, "a", 100), (3, "b", 900)]), limits).orderBy("doc_id").collect()
    assert [(r["failed_rules"], r["kept"]) for r in rows] == [(["symbols", "few_words"], False), (["few_words"], False), ([], True)]


def test_main_path_runs_no_python(spark):
    frame = qr.quality_rules(h.documents(spark, ["a b c"]), h.labels(spark, [(0, 1, 0)]))
    for part in (frame, qr.figures(h.documents(spark, ["a b c"])), qr.cutoffs(qr.figures(h.documents(spark, ["a b c"])), h.labels(spark, [(0, 1, 0)]))):
        assert not re.search("Python|Pandas|Arrow", part._jdf.queryExecution().executedPlan().toString())
