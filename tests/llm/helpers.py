"""Fixtures of the training-data operators: odd tables and plain restatements."""

import random
import re
import zlib

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, start=0):
    return [(start + n, t, "en", f"src{n % 3}", None if t is None else len(t)) for n, t in enumerate(texts)]


def documents(spark, texts, start=0):
    return spark.createDataFrame(rows_of(texts, start), DOCUMENT)


def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows and ids, ties, long and foreign texts."""
    long = " ".join(f"word{n % 977} filler{n % 13}" for n in range(30_000))
    return [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", "en", None, 7), (None, "a text without an id and five words", None, None, None),
            (5, "same words again and again here", "en", "a", 31), (5, "same words again and again here", "en", "a", 31), (5, "other text under the same number", "fr", "b", 32),
            (6, "same words again and again here", "de", "a", 31), (7, long, "en", "a", len(long)), (8, "ÀÉÎ ßtraße 日本語 ​ x́ \U0001f600 12½", "de", "b", 5),
            (9, "one", "en", "b", 3), (10, "x" * 50_000, "en", "b", 50_000), (11, "tab\x1cseparated\x1fthings it's DON'T 3.14 <|endoftext|>", "en", "b", 10), (12, "\n\n\n", "en", "b", 3)]


def odd(spark):
    """The odd rows with columns whose names operators might use for themselves."""
    frame = spark.createDataFrame(odd_rows(), DOCUMENT)
    for name in ("length", "rank", "mark", "class", "fold", "label", "score", "component", "host", "token", "_bucket"):
        frame = frame.selectExpr("*", f"doc_id as `{name}`")
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary):x}" for _ in range(words))


def shingle_set(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]
