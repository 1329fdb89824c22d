"""Prefix hashes against plain slices; fingerprints against a plain walk over sorted rows."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import helpers as h
from docweave.llm import fingerprints as fp


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab日", max_size=60), st.text(alphabet="ab日", max_size=60), st.data())
def test_spans_and_extensions(a, b, data):
    x, y = fp.Prefix(fp.codes_of(a)), fp.Prefix(fp.codes_of(b))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    length = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert fp.spans_equal(x, i, y, j, length) == (a[i:i + length] == b[j:j + length])
    common = 0
    while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
        common += 1
    assert fp.longest_common_extension(x, i, y, j) == common


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=200), st.text(alphabet="abc", max_size=200))
def test_likeness_is_the_jaccard_similarity_while_sketches_hold_all_spans(a, b):
    def spans(t):
        width = min(fp.SPAN, len(t))
        return {t[i:i + width] for i in range(len(t) - width + 1)} if t else set()
    sketches = [fp.sketch(fp.Prefix(fp.codes_of(t)))[1] for t in (a, b)]
    x, y = spans(a), spans(b)
    if max(len(x), len(y)) < fp.SKETCH:
        exact = len(x & y) / len(x | y) if x and y else float(len(x) == len(y))
        assert fp.likeness(*sketches) == pytest.approx(exact)
    assert fp.fingerprint_likeness(*(fp.fingerprint(len(t), (0, s)) for t, s in zip((a, b), sketches))) == fp.likeness(*sketches)


def check(rows, found):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for n, (i, text) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half] if half else text
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_successors_across_ranges(spark, partitions):
    texts = [h.prose(n, 5 + n % 40) for n in range(97)]
    documents = h.documents(spark, texts)
    found = fp.fingerprints(documents, partitions).collect()
    check(list(enumerate(texts)), found)


@pytest.mark.parametrize("partitions", [1, 5])
def test_odd_rows(spark, partitions):
    found = fp.fingerprints(h.odd(spark), partitions).collect()
    check([(r[0], r[1]) for r in h.odd_rows()], found)
    same = {r.fingerprint for r in found if r.n_chars == 31}
    assert len(same) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_empty_and_single(spark):
    assert fp.fingerprints(h.empty(spark)).count() == 0
    check([(4, "one single text")], fp.fingerprints(h.documents(spark, ["one single text"], 4)).collect())


def test_half_replaced_texts_are_about_a_third_alike(spark):
    found = fp.fingerprints(h.documents(spark, [h.prose(n, 400, 5000) for n in range(30)])).toPandas()
    assert 0.2 < found.near_edited.mean() < 0.5 and found.near_next.mean() < 0.05
    assert (found.common_start >= found.n_chars - found.n_chars // 2).all()
    assert np.isfinite(found.near_edited).all()
