"""Names in texts by window hashes: the rows of a regular expression per name and text."""

import random
import re

from docweave.operators import mentions

SIGNS = "ab_A1 .-é索😀\n"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(texts, names, shortest):
    folded = {lowered(n) for n in names if n}
    return sorted((k, n) for k, t in texts for n in folded if t and len(n) >= shortest
                  and re.search(rf"(?<![A-Za-z0-9_]){re.escape(n)}(?![A-Za-z0-9_])", lowered(t)))


def found(spark, texts, names, shortest=1):
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    rows = mentions.mentioned_names(frame, "doc_id", "text", spark.createDataFrame([(n,) for n in names], "term string"), shortest)
    return sorted((r["doc_id"], r["term"]) for r in rows.collect())


def test_same_names_as_by_regular_expressions(spark):
    rng = random.Random(7)
    texts = [(n, "".join(rng.choices(SIGNS, k=rng.choice([0, 1, 4, 30, 300])))) for n in range(150)] + [(900, None), (901, "a b"), (901, "a b"), (902, "a b" * 20000)]
    names = ["".join(rng.choices(SIGNS, k=rng.randint(1, 6))) for _ in range(300)] + [None, "", "a b", "A B", ".", "a"]
    for shortest in (1, 3):
        got = found(spark, texts, names, shortest)
        assert got == sorted(set(brute(texts, names, shortest))) and len(got) > 100


def test_windows_that_only_share_a_hash_are_not_names(spark, monkeypatch):
    texts = [(n, f"alpha{n} beta") for n in range(20)]
    monkeypatch.setattr(mentions, "BASE", mentions.np.uint64(1))
    monkeypatch.setattr(mentions, "INVERSE", mentions.np.uint64(1))
    assert found(spark, texts, ["eatb", "alpha3", "3ahpla", "beta"]) == sorted([(n, "beta") for n in range(20)] + [(3, "alpha3")])


def test_hot_name_and_empty_tables(spark):
    assert len(found(spark, [(n, "the Pump pump PUMP") for n in range(3000)], ["pump", "Pump"])) == 3000
    assert found(spark, [], ["pump"]) == [] and found(spark, [(1, "pump")], []) == []


def test_names_beyond_the_broadcast_limit_are_shuffled(spark, monkeypatch):
    texts, names = [(n, f"pump {n % 7} valve") for n in range(300)], ["pump", "valve", "3 valve", "8"]
    small = found(spark, texts, names)
    monkeypatch.setattr(mentions, "BROADCAST_LIMIT_BYTES", -1)
    assert found(spark, texts, names) == small and len(small) > 600
