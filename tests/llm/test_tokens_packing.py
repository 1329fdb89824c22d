"""Tokenizer ids, packing and token rollups against plain restatements."""

import array
import collections
import zlib

import pytest
from hypothesis import given, settings, strategies as st

import helpers as h
from docweave.llm import packing, token_counts
from docweave.llm.tokens import WordIds, default_path


@pytest.fixture(scope="module")
def cache():
    return WordIds(default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(min_codepoint=1, max_codepoint=0x24F), st.sampled_from("ABcd 's'T \n  　İßẞσΣς́²½ªº日😀<|>")), max_size=60))
def test_ids_equal_the_tokenizer(text):
    cache = _shared()
    assert cache.ids(text) == array.array("I", cache.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_held = []


def _shared():
    if not _held:
        _held.append(WordIds(default_path()))
    return _held[0]


def test_special_strings_and_separators(cache):
    for text in ("a<|endoftext|>b <|startoftext|>", "x\x1cy\x1f z", "it's WE'LL !!'s ''t", "<| endoftext|>"):
        assert cache.ids(text) == array.array("I", cache.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def expected_pieces(tokenizer, doc_id, text, size):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    return [(doc_id, k // size, k, len(ids[k:k + size]), zlib.crc32(array.array("I", ids[k:k + size]).tobytes())) for k in range(0, len(ids), size)]


@pytest.mark.parametrize("size", [64, 4096])
def test_packing_of_odd_rows(spark, cache, size):
    rows = packing.pack(h.odd(spark), default_path(), size, buckets=4).collect()
    expected = [p for r in h.odd_rows() for p in expected_pieces(cache.tokenizer, r[0], r[1], size)]
    assert collections.Counter(tuple(r)[:5] for r in rows) == collections.Counter(expected)
    ends = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= size


def test_packing_of_an_empty_table(spark):
    assert packing.pack(h.empty(spark), default_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_uses_every_piece_once_and_fills_well(lengths):
    counts = collections.Counter(lengths)
    lines = packing.plan(counts, 40)
    used = collections.Counter()
    for parts, times in lines:
        assert sum(parts) <= 40 and times > 0
        for part in parts:
            used[part] += times
    assert used == counts
    bins, total = sum(t for _, t in lines), sum(lengths)
    assert bins >= -(-total // 40)
    assert bins <= 1.7 * total / 40 + 1  # no two sequences are half empty


def test_plan_finds_exact_pairs_triples_and_quadruples():
    assert sorted(packing.plan({10: 2, 30: 2}, 40)) == [((30, 10), 2)]
    assert sum(t for _, t in packing.plan({20: 3, 12: 3, 8: 3}, 40)) == 3
    assert sum(t for _, t in packing.plan({19: 1, 11: 1, 7: 1, 3: 1}, 40)) == 1


def test_token_rollup_against_brute_force(spark, cache, tmp_path):
    texts = ["a b c", "a b c", "x\ny\nx\nlonger line here", None, "", "x\ny\nx\nlonger line here", "It's 42!"]
    documents = h.documents(spark, texts).unionByName(h.documents(spark, ["a b c"], 20))
    rollup = token_counts.history(documents, default_path(), str(tmp_path / "rollup"))
    seen, expected = set(), collections.defaultdict(lambda: [0, 0])
    for doc_id, text, lang, source, _ in sorted(h.rows_of(texts) + h.rows_of(["a b c"], 20)):
        if (text or "") in seen:
            continue
        seen.add(text or "")
        kept = "\n".join(dict.fromkeys((text or "").split("\n")))
        for version, count in (("word_bpe_49k", len(cache.tokenizer.encode(kept, add_special_tokens=False).ids)), ("white_space", len(kept.split()))):
            expected[source, lang, version][0] += 1
            expected[source, lang, version][1] += count
    assert {(r[0], r[1], r[2]): [r[3], r[4]] for r in rollup.totals().collect()} == dict(expected)
    assert rollup.batches() == ["1-load", "2-revise", "3-delete-copies"]


def test_commits_are_idempotent_and_unfinished_batches_are_replaced(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    rows = spark.createDataFrame([("s", "en", "v", 1, 10), ("s", None, "v", 1, 5), ("s", "en", "v", 1, 7)], token_counts.SCHEMA)
    assert rollup.commit("one", rows) and not rollup.commit("one", rows)
    half = tmp_path / "r" / "batch=two"
    half.mkdir()
    (half / "part-00000.parquet").write_bytes(b"cut off")
    assert rollup.batches() == ["one"]
    assert rollup.commit("two", token_counts.signed(spark.createDataFrame([("s", "en", "v", 7)], "source string, lang string, tokenizer_version string, tokens long"), -1))
    assert {tuple(r) for r in rollup.totals().collect()} == {("s", "en", "v", 1, 10), ("s", None, "v", 1, 5)}


@pytest.mark.parametrize("make", [h.odd, h.empty])
def test_token_history_of_odd_tables(spark, tmp_path, make):
    totals = token_counts.history(make(spark), default_path(), str(tmp_path / "r")).totals().toPandas()
    distinct = {r[1] or "" for r in h.odd_rows()} if make is h.odd else set()
    assert totals[totals.tokenizer_version == "white_space"].documents.sum() == len(distinct)
