"""Alignment of two tokenizers against plain loops over token spans."""

import collections
import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import helpers as h
from docweave.llm import alignment as al

os.environ["TOKENIZERS_PARALLELISM"] = "false"
_held = []


def both():
    if not _held:
        first, second = al.default_paths()
        a = Tokenizer.from_file(first)
        a.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        value = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        _held.append((a, SentencePieceProcessor(model_file=second), value, al.Tokens(first, second)))
    return _held[0]


def spans_of(text):
    """Ids with byte spans of both sides, or nothing."""
    a, b, value, _ = both()
    if not text:
        return [], []
    encoded = a.encode(" " + text, add_special_tokens=False)
    first = [(i, bytes(value[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens)]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    sides = []
    for side in (first, second):
        if b"".join(p for _, p in side) != (" " + text).encode():
            return [], []
        at, spans = 0, []
        for i, p in side:
            spans.append((i, at, at + len(p)))
            at += len(p)
        sides.append(spans)
    return sides


def brute(rows):
    """doc rows -> result rows, all pairs of tokens of a document compared."""
    linked, docs = collections.Counter(), []
    for doc_id, text in rows:
        first, second = spans_of(text)
        links, low = [], 0
        for i, s, e in first:
            while low < len(second) and second[low][2] <= s:
                low += 1
            k = low
            while k < len(second) and second[k][1] < e:
                links.append((i, second[k][0]))
                k += 1
        cuts = sorted({e for _, _, e in first} & {e for _, _, e in second})
        groups = []
        for side in (first, second):
            parts, cut = [[] for _ in cuts], 0
            for i, _, e in side:
                parts[cut].append(str(i))
                cut += e == cuts[cut]
            groups.append([",".join(part) for part in parts])
        groups = ["|".join(pair) for pair in zip(*groups)]
        linked.update(set(links))
        docs.append((doc_id, len(first), len(second), len(cuts), links, ";".join(groups)))
    highest = {}
    for (i, _), times in linked.items():
        highest[i] = max(times, highest.get(i, 0))
    return [(d, a, b, c, len(links), sum(linked[x] == highest[x[0]] for x in links), sum(linked[x] for x in links),
             hashlib.sha256(groups.encode()).hexdigest() if a else "") for d, a, b, c, links, groups in docs]


def texts_of(count, seed=1):
    rng = random.Random(seed)
    signs = ["the ", "of ", "Straße ", "naïve ", "日本", "  ", "\n", "\t", "😀", "1234 ", "don't ", "<|endoftext|>", "<s>", "▁", "\r\n", "x" * 30, "ﬁ", "\x00", " "]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(count)]
    return made + [h.prose(n, rng.randint(1, 400)) for n in range(count)] + [None, "", " ", "a"]


def same(frame, rows):
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("limit", [10 ** 6, 300, 0])
def test_all_columns_against_brute_force(spark, limit):
    """With every pair looked up, with most pairs joined, and with all of them joined."""
    texts = texts_of(60)
    same(al.alignment(h.documents(spark, texts), *al.default_paths(), limit=limit), list(enumerate(texts)))


def test_odd_rows(spark):
    same(al.alignment(h.odd(spark), *al.default_paths()), [(r[0], r[1]) for r in h.odd_rows()])


def test_empty_table(spark):
    assert al.alignment(h.empty(spark), *al.default_paths()).count() == 0


def test_given_tables(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same(al.alignment(documents, *al.default_paths()), [(r["doc_id"], r["text"]) for r in documents.collect()])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 6), min_size=0, max_size=40), max_size=6), st.integers(1, 9), st.randoms(use_true_random=False))
def test_lockstep_equals_all_overlaps(sizes, lane, rng):
    """Random token sizes on both sides, with lanes of all lengths."""
    other = []
    for some in sizes:
        total, parts = sum(some), []
        while total:
            parts.append(rng.randint(1, min(5, total)))
            total -= parts[-1]
        other.append(parts)
    flat_a, flat_b = (np.array([x for some in side for x in some], dtype=np.int64) for side in (sizes, other))
    ends_a, ends_b = np.cumsum(flat_a), np.cumsum(flat_b)
    stops = np.cumsum([len(s) for s in sizes]).astype(np.int64)
    begins = stops - np.array([len(s) for s in sizes], dtype=np.int64)
    links_a, links_b, cuts_a, cuts_b = al.merge(ends_a, ends_b, begins, stops, lane)
    expected = {(i, j) for i in range(len(flat_a)) for j in range(len(flat_b))
                if max(ends_a[i] - flat_a[i], ends_b[j] - flat_b[j]) < min(ends_a[i], ends_b[j])}
    assert len(links_a) == len(expected) and set(zip(links_a.tolist(), links_b.tolist())) == expected
    common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert ends_a[cuts_a].tolist() == common and ends_b[cuts_b].tolist() == common


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(min_codepoint=1, max_codepoint=0x2FF), st.sampled_from("ab  \n\t\r' .1　 ▁é日😀")), max_size=40))
def test_chunks_are_read_like_the_whole_text(text):
    a, b, _, known = both()
    assert known.divisible
    (first, second), (n_first, n_second) = known.encode(["x", text, "y z"])
    at_a, at_b = n_first[0], n_second[0]
    whole = spans_of(text)
    assert first[at_a:at_a + n_first[1]].tolist() == [i for i, _, _ in whole[0]] and second[at_b:at_b + n_second[1]].tolist() == [i for i, _, _ in whole[1]]


def test_long_chunks_leave_the_cache():
    known = al.Tokens(*al.default_paths())
    known.encode(["short " + "y" * 5000])
    assert set(known.cache) == {"short"}
