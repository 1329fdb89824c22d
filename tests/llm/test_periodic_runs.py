"""Periodic runs against a plain search over all lags."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import helpers as h
from docweave.llm import periodic_runs as pr


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[k] == words[k - q] for k in range(q, len(words))))


def brute_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        k = q
        while k < n:
            if words[k] != words[k - q]:
                k += 1
                continue
            first = k
            while k < n and words[k] == words[k - q]:
                k += 1
            start, length = first - q, k - first + q
            if length >= max(6, 4 * q) and smallest_period(words[start:start + length]) == q:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def found_in(texts):
    numbers = {}
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    flat = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], dtype=np.int64)
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    result = [[] for _ in texts]
    for start, length, period in pr.find_runs(flat, rows, counts):
        result[rows[start]].append((start - firsts[rows[start]], length, period))
    return result


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4))
def test_runs_over_two_words(texts):
    assert found_in(texts) == [brute_runs(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9)), max_size=6))
def test_runs_of_repeated_blocks(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert found_in([words, words[::-1]]) == [brute_runs(words), brute_runs(words[::-1])]


def test_every_period_and_exponent():
    for period in range(1, 40):
        for length in range(4 * period - 1, 4 * period + 6):
            words = ["x"] + [f"w{k % period}" for k in range(length)] + ["y"]
            assert found_in([words]) == [[(1, length, period)] if length >= max(6, 4 * period) else []]


def test_one_word_and_long_periods_stay_cheap():
    words = ["a"] * 300_000
    assert found_in([words]) == [[(0, 300_000, 1)]]
    period = [f"w{k}" for k in range(5000)]
    assert found_in([period * 40]) == [[(0, 200_000, 5000)]]


def expected(doc_id, text, planted):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if planted and doc_id is not None and words:
        digest = zlib.crc32(str(doc_id).encode())
        if digest % 10 == 0:
            g, n = digest // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    runs = brute_runs(words)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest())


def same(rows, wanted):
    return sorted(map(tuple, rows), key=repr) == sorted(wanted, key=repr)


def test_digests_of_odd_rows(spark):
    rows = pr.summary(pr.periodic_runs(h.odd(spark))).collect()
    short = [r for r in h.odd_rows() if len(r[1] or "") < 10_000]
    assert len(rows) == len(h.odd_rows())
    assert same([r for r in rows if r[0] not in (7, 10)], [expected(r[0], r[1], False) for r in short])


def test_query_with_planted_ends(spark):
    rng = random.Random(5)
    texts = [" \n".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))) for _ in range(400)] + [None, "", " \t "]
    frame = h.documents(spark, texts)
    rows = pr.summary(pr.periodic_runs(pr.with_planted_runs(frame))).collect()
    assert same(rows, [expected(n, t, True) for n, t in enumerate(texts)])
    assert sum(r["n_runs"] > 0 for r in rows) >= 15


def test_collapsed_text_and_spans(spark):
    row = pr.periodic_runs(h.documents(spark, ["go  go go\ngo go go home a b a b a b a b"])).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 6, 1), (7, 8, 2)] and row["collapsed"] == "go home a b" and row["n_words"] == 15


@pytest.mark.parametrize("planted", [False, True])
def test_empty_table(spark, planted):
    frame = pr.with_planted_runs(h.empty(spark)) if planted else h.empty(spark)
    assert pr.summary(pr.periodic_runs(frame)).count() == 0
