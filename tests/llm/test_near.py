"""Jaccard join, line dedup, components, decontamination and license scan against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import helpers as h
from docweave.llm import decontamination as dc, jaccard_join as jj, licenses, line_dedup as ld
from docweave.llm.arrays import text_bytes
from docweave.llm.components import components


def edited(text, seed, rate):
    rng = random.Random(seed)
    return " ".join(h.prose(rng.random(), 1) if rng.random() < rate else w for w in text.split())


def near_texts():
    texts = []
    passage = h.prose("passage", 40)
    for n in range(25):
        base = h.prose(n, 20 + 7 * n)
        texts.append(base)
        texts.extend(edited(base, (n, k).__hash__(), rate) for k, rate in enumerate((0.01, 0.03, 0.1)))
        if n % 3 == 0:
            texts.append(base.upper())
        if n % 2:
            texts.append(h.prose(n + 500, 30) + " " + passage)
    chain = h.prose("chain", 60).split()
    texts.extend(" ".join(chain[2 * k:2 * k + 40]) for k in range(10))  # neighbours are linked, ends are not
    family = h.prose("family", 80)
    texts.extend(edited(family, 1000 + k, 0.012) for k in range(60))  # one large group of near copies
    return texts


def brute(rows):
    sets = [h.shingle_set(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = h.smallest_reachable(range(len(rows)), links)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[group[n]] = min(least.get(group[n], i), i)
    return [(i, len(sets[n]), least[group[n]]) for n, (i, _) in enumerate(rows)], group


@pytest.mark.parametrize("chunk", [1024, 7])
def test_jaccard_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(jj, "CHUNK_CLASSES", chunk)
    texts = near_texts()
    found = jj.jaccard_components(h.documents(spark, texts))
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(brute(list(enumerate(texts)))[0])


def test_keep_one_of_each_group(spark):
    texts = near_texts()
    documents = h.documents(spark, texts)
    _, group = brute(list(enumerate(texts)))
    kept = jj.keep_one(documents)
    assert {r.doc_id for r in kept.collect()} == set(group.values()) and kept.columns == documents.columns


def test_jaccard_of_odd_tables(spark):
    rows = [((1 << 63) - 1 if r[0] is None else r[0], r[1]) for r in h.odd_rows()]
    assert collections.Counter(map(tuple, jj.jaccard_components(h.odd(spark)).collect())) == collections.Counter(brute(rows)[0])
    assert jj.jaccard_components(h.empty(spark)).count() == 0
    kept = jj.keep_one(h.odd(spark))
    assert sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 1, 2, 3, 5, 5, 5, 7, 8, 9, 10, 11, 12]
    assert jj.keep_one(h.empty(spark)).count() == 0


def test_tree_traversal_lets_every_link_through():
    sets = [np.unique(np.random.default_rng(n % 40).integers(0, 1 << 40, 50 + n % 9).astype(np.uint64)) for n in range(150)]
    sets = [np.sort(np.concatenate([s[:-(n % 5) or None], np.array([n], dtype=np.uint64)])) if n % 2 else s for n, s in enumerate(sets)]
    sizes, bits = np.array([len(s) for s in sets]), [jj.bitmap(s) for s in sets]
    everything = list(range(len(sets)))

    def pairs(groups):
        return {(int(a), int(b)) for p, q in jj.candidates(everything, everything, sizes, groups, bits) for a, b in zip(p, q)}

    found = pairs(np.array(everything))
    links = {(a, b) for a, b in itertools.permutations(everything, 2) if jj.linked(sets[a], sets[b])}
    assert links <= found and len(found) < len(sets) ** 2 / 5
    halves = np.array([n // 75 for n in everything])
    assert pairs(halves) == {(a, b) for a, b in found if halves[a] != halves[b]}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + n, 1001 + n) for n in range(40)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    proper = [(a, b) for a, b in links if a != b]
    assert dict(map(tuple, found.collect())) == h.smallest_reachable({x for pair in proper for x in pair}, proper)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def normal(line):
    return re.sub("[0-9]", "0", re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", line.lower())).strip()


def brute_lines(rows):
    """Lines left of every (doc_id, text): classes, marks, and links as the operator defines them, over all pairs."""
    classes, occurrences = {}, collections.defaultdict(list)
    for n, (i, text) in enumerate(rows):
        for number, line in enumerate((text or "").split("\n")):
            found = ld.lines_of(pa.array([line.lower()], pa.string()), ld.MIN_WORDS)
            if found is not None and len(found[2]):
                key = int(found[2][0])
                classes[key] = (int(found[3][0]) & (1 << 64) - 1, normal(line))
                assert bool(found[5][0]) == (len(normal(line).split()) >= ld.MIN_WORDS)
                assert int(found[4][0]) == len(normal(line))
                occurrences[key].append((i, n, number))
    first = {}
    fuzzy = {key: made for key, made in classes.items() if len(made[1].split()) >= ld.MIN_WORDS}
    for key, (mark, text) in fuzzy.items():
        unit = mark, len(text)
        first[unit] = min(first.get(unit, key), key, key=lambda k: (-len(occurrences[k]), k))
    links = []
    for key, (mark, text) in fuzzy.items():
        for (other_mark, _), head in first.items():
            if head != key and (mark ^ other_mark).bit_count() <= ld.DISTANCE:
                longest = max(len(text), len(classes[head][1]))
                if h.edit_distance(text, classes[head][1]) <= int(0.1 * longest + 1e-9):
                    links.append((key, head))
    group = h.smallest_reachable(classes, links)
    leader = {}
    for key, places in occurrences.items():
        leader[group[key]] = min([leader.get(group[key], places[0]), *places])
    gone = {p for key, places in occurrences.items() for p in places if p != leader[group[key]]}
    return ["\n".join(line for number, line in enumerate(text.split("\n")) if (i, n, number) not in gone) if text is not None else None for n, (i, text) in enumerate(rows)]


def line_texts():
    common = [h.prose(("line", n).__hash__(), 9 + n) for n in range(12)]
    texts = []
    for n in range(40):
        rng = random.Random(n)
        lines = [h.prose(n * 100 + k, rng.randrange(1, 25)) for k in range(5)]
        lines.insert(rng.randrange(5), rng.choice(common) + f" {n} pages")
        lines.insert(rng.randrange(5), rng.choice(common).upper().replace(" ", ", "))
        near = rng.choice(common).split() * 3
        near[rng.randrange(len(near))] = "changed"
        lines.append(" ".join(near))
        texts.append("\n".join(lines))
    return texts


def test_line_dedup(spark):
    texts = line_texts()
    documents = h.documents(spark, texts)
    found = ld.dedup_lines(documents).orderBy("doc_id").collect()
    assert [r.text for r in found] == brute_lines(list(enumerate(texts)))
    assert [r.n_chars for r in found] == [len(r.text) for r in found]
    assert sum(r["__lost"] for r in found) > 20


@pytest.mark.parametrize("chunk", [1024, 2])
def test_line_dedup_compares_classes_unlike_the_first(spark, monkeypatch, chunk):
    monkeypatch.setattr(ld, "CHUNK_CLASSES", chunk)
    rng = random.Random(3)
    words = [f"{a}{b}{c}{d}" for a, b, c, d in zip("bcdfglmnprst" * 2, "aeiou" * 5, "zyxwvkjhgfdc" * 2, "uoiea" * 5)]
    orders = [rng.sample(words, len(words)) for _ in range(8)]  # of one SimHash and one length, all unlike
    swapped = [order[:9] + [order[10], order[9]] + order[11:] for order in orders]
    lines = [" ".join(order) for order in [orders[0]] * 3 + orders[1:] + swapped[1:]]
    texts = [r.text for r in ld.dedup_lines(h.documents(spark, lines)).orderBy("doc_id").collect()]
    assert texts == [lines[0], "", ""] + lines[3:10] + [""] * 7


def test_near_marks_against_all_pairs(spark):
    rng = random.Random(2)
    marks = set()
    for _ in range(150):
        base = rng.getrandbits(64)
        for flips in range(5):
            mark = base
            for bit in rng.sample(range(64), flips):
                mark ^= 1 << bit
            marks.add(mark - (1 << 64) if mark >> 63 else mark)
    frame = spark.createDataFrame([(m, 100, None) for m in marks], "mark long, length int, label long")
    found = collections.Counter((r.a, r.b) for r in ld.near_marks(ld.dealt(frame)).collect())
    near = {frozenset(p) for p in itertools.combinations(marks, 2) if ((p[0] ^ p[1]) & (1 << 64) - 1).bit_count() <= ld.DISTANCE}
    assert {frozenset(p) for p in found} == near and set(found.values()) <= {1} and len(found) == len(near)
    first = ld.met_heads(frame.select("mark", "length", F.xxhash64("mark").alias("label"), F.lit(1).alias("classes"))).cache()
    stars = {frozenset((r.a, r.b)) for r in first.where("key is null").collect()}
    second = ld.near_marks(first.where("key is not null").selectExpr("a mark", "a_length length", "cast(null as long) label", "key"))
    assert stars <= near == stars | {frozenset((r.a, r.b)) for r in second.collect()}
    labelled = ld.near_marks(ld.dealt(frame.withColumn("label", F.pmod("mark", F.lit(2))))).collect()
    assert {frozenset((r.a, r.b)) for r in labelled} == {p for p in near if len({m % 2 for m in p}) == 2}
    lengths = ld.near_marks(ld.dealt(frame.withColumn("length", F.when(F.pmod("mark", F.lit(3)) == 0, 120).otherwise(100).cast("int")))).collect()
    assert {frozenset((r.a, r.b)) for r in lengths} == {p for p in near if len({m % 3 == 0 for m in p}) == 1}


def test_distance_within():
    rng = random.Random(8)
    for _ in range(400):
        a = "".join(rng.choice("ab ") for _ in range(rng.randrange(30)))
        b = list(a) if rng.random() < 0.7 else [rng.choice("ab ") for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("ab "))
        b = "".join(b)
        exact = h.edit_distance(a, b)
        for allowed in (0, 1, exact - 1, exact, exact + 1, 10):
            assert ld.distance_within(a, b, allowed) == (exact <= allowed) or allowed < 0


def test_simhash_is_the_majority_of_the_bits():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 2, 3, 255, 256, 700, 5])
    hashes = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    heads = np.cumsum(sizes) - sizes
    for mark, head, size in zip(ld.simhashes(hashes, heads), heads, sizes):
        own = [int(w) for w in hashes[head:head + size]]
        assert int(mark) == sum(1 << bit for bit in range(64) if 2 * sum(w >> bit & 1 for w in own) > size)


def test_equal_short_lines_go_and_numbers_stay(spark):
    script = "".join(chr(0x4E00 + n) for n in range(20))
    texts = ["Subscribe now!\n2019\n" + script, "subscribe NOW\n2020\n--\n" + script, "2019\n--\nSubscribe later"]
    assert [r.text for r in ld.dedup_lines(h.documents(spark, texts)).orderBy("doc_id").collect()] == [texts[0], "2020\n--", "--\nSubscribe later"]


def test_line_dedup_of_odd_tables(spark):
    found = ld.dedup_lines(h.odd(spark))
    assert found.columns[:-1] == h.odd(spark).columns
    texts = collections.defaultdict(list)
    for r in found.collect():
        texts[r.doc_id].append(r.text)
    assert texts[1] == [None] and texts[2] == [""] and sorted(texts[5]) == ["other text under the same number", "same words again and again here", "same words again and again here"]
    assert texts[6] == [""] and texts[9] == ["one"] and texts[12] == ["\n\n\n"]
    assert ld.dedup_lines(h.empty(spark)).count() == 0


ITEMS = [(n, h.prose(("item", n).__hash__(), 30 + n % 10)) for n in range(30)] + [(90, "too short"), (91, None), (92, "")]


def test_decontamination(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts, expected = [], {}
    for n, (item, text) in enumerate(ITEMS[:30]):
        host = h.prose(n + 40, 60)
        texts += [host + "\n" + text.upper().replace(" ", ", ") + "\n" + host, text + " " + host, host + " " + edited(text, n, 0.08), host]
        expected |= {4 * n: item, 4 * n + 1: item, 4 * n + 2: item}
    documents = h.documents(spark, texts)
    found = {(r.doc_id, r.item_id): r for r in dc.matches(documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), items).collect()}
    sure = {(d, i) for d, i in expected.items() if d % 4 < 2}
    assert sure <= set(found) <= set(expected.items())
    assert all(found[pair].distance == 0 for pair in sure)
    assert len(found) >= 0.9 * len(expected)
    words = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    for (d, i), r in found.items():
        text, item = words(texts[d]), words(dict(ITEMS)[i])
        best = min(h.edit_distance(item, text[a:b]) for a in range(max(0, len(text) - len(item) - 40), len(text) - len(item) + 20, 1) for b in [len(text)]) if d % 4 == 2 else 0
        assert r.distance <= best or d % 4 != 2
    kept = dc.decontaminate(documents, items)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in found} and kept.columns == documents.columns


def test_part_distance():
    rng = random.Random(3)
    for _ in range(60):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        best = min(h.edit_distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        assert dc.part_distance(item, text, 20) == best
        assert dc.part_distance(item, text, best - 1) == best or best == 0


def test_decontamination_of_odd_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(h.odd(spark), items).count() == len(h.odd_rows())
    assert dc.decontaminate(h.odd(spark), none).count() == len(h.odd_rows())
    assert dc.decontaminate(h.empty(spark), items).count() == 0
    twice = spark.createDataFrame([(None, ITEMS[0][1], "en", "s", 1), (3, ITEMS[0][1], "en", "s", 1), (3, "clean", "en", "s", 1)], h.DOCUMENT)
    assert [r.text for r in dc.decontaminate(twice, items).collect()] == ["clean"]


def brute_licenses(text):
    """(template, best containment) of every template with a window of its own length that holds enough of its shingles."""
    def shingles(t):
        words = re.findall("[a-z0-9]+", t.lower())
        return [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    made, found = shingles(text), set()
    for n, (_, template) in enumerate(licenses.TEMPLATES):
        own = set(shingles(template))
        if any(len(own & set(made[a:a + len(own)])) >= licenses.CONTAINMENT * len(own) for a in range(max(1, len(made) - len(own) + 1))):
            found.add(n)
    return found


def test_license_scan(spark):
    texts = []
    for n, (_, template) in enumerate(licenses.TEMPLATES):
        texts.append(h.prose(n, 30) + " " + template + " " + h.prose(n + 1, 200))
        words = template.split()
        words[-1] = "other"
        texts.append(h.prose(n + 70, 13) + "\n" + " ".join(words).upper())
        texts.append(template + " " + h.prose(n + 9, 40) + " " + template)
        texts.append(h.prose(n + 300, 50))
    found = collections.defaultdict(list)
    for r in licenses.scan(h.documents(spark, texts)).collect():
        found[r.doc_id].append(r)
        assert r.license == licenses.TEMPLATES[r.template][0] and r.containment >= licenses.CONTAINMENT and r.first_word < r.last_word
    for n, text in enumerate(texts):
        assert {r.template for r in found[n]} == brute_licenses(text), n
        if n % 4 == 2:
            assert sum(r.template == n // 4 for r in found[n]) == 2
        if n % 4 == 0:
            assert [r.first_word for r in found[n] if r.template == n // 4] == [30]


def test_license_scan_of_odd_tables(spark):
    assert licenses.scan(h.odd(spark)).count() == 0 and licenses.scan(h.empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "Released under the MIT License.", "en", "s", 1)] * 2, h.DOCUMENT)
    assert [tuple(r) for r in licenses.scan(rows).collect()] == [(None, "MIT", 0, 0, 4, 1.0)] * 2
    with pytest.raises(ValueError):
        licenses.Templates([("X", "two words")])


def spoiled(text, way, seed):
    """A near copy: ``way`` is the share of characters edited at random, or k for one changed character in every k-th word."""
    rng, signs = random.Random(seed), "abcdefghijklmnopqrstuvwxyz"
    if way >= 1:
        words = text.split()
        for place in range(way - 1, len(words), way):
            middle = len(words[place]) // 2
            words[place] = words[place][:middle] + "q" + words[place][middle + 1:]
        return " ".join(words)
    out = list(text)
    for place in rng.sample(range(len(text)), int(way * len(text))):
        out[place] = rng.choice([rng.choice(signs), rng.choice(signs), "", out[place] + rng.choice(signs)])
    return "".join(out)


@pytest.mark.parametrize("way", [0.05, 0.1, 0.15, 0.2, 0.25, 3, 2])
def test_decontamination_finds_near_copies_alone(spark, way):
    items = ITEMS[:30]
    texts = [h.prose(n + 40, 30) + " " + spoiled(text, way, n) + " " + h.prose(n + 90, 30) for n, text in items]
    plain = [" ".join(re.findall("[a-z0-9]+", t)) for t in texts]
    due = {n for n, text in items if dc.part_distance(text, plain[n], len(text)) <= int(0.25 * len(text))}
    found = {(r.doc_id, r.item_id): r for r in dc.matches(h.documents(spark, texts).withColumn("text_hash", F.xxhash64("text")), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {d for d, i in found if d != i} == set() and len(due) > 20
    assert len(due & {d for d, _ in found}) >= 0.9 * len(due)
    for (n, _), r in found.items():
        assert r.distance == dc.part_distance(items[n][1], plain[n], len(items[n][1])) and abs(r.first_word - 30) <= 2


def test_decontamination_of_short_items_and_unspaced_scripts(spark):
    script = "".join(chr(0x4E00 + n * n % 2000) for n in range(40))
    items = spark.createDataFrame([(1, "rare pair"), (2, script), (3, "a"), (4, "x" * 40)], "item_id long, text string")
    texts = ["It is a Rare, pair", "rare pairs b", "unrare pair", "頭" + script + "尾", script[:20] + "頭" + script[21:], "b" * 60]
    found = {(r.doc_id, r.item_id): r for r in dc.matches(h.documents(spark, texts).withColumn("text_hash", F.xxhash64("text")), items).collect()}
    assert {k: (r.distance, r.first_word) for k, r in found.items()} == {(0, 1): (0, 3), (0, 3): (0, 2), (3, 2): (0, 0), (4, 2): (1, 0)}


def test_walks_keep_edits_apart_from_other_texts():
    texts = [h.prose(("walk", n).__hash__(), 30) for n in range(60)]
    items = dc.Items(list(enumerate(texts)))

    def keys(changed):
        data, places = dc.stacked([t.encode() for t in changed], 2 * items.longest)
        return dc.sampled(dc.walks(data, places, 2 * items.longest), items.sizes)

    def met(changed):
        data, places = dc.stacked([t.encode() for t in changed], 2 * items.longest)
        found = dc.met(dc.walks(data, places, 2 * items.longest), items.sizes, items.keys, np.arange(len(texts)))
        assert (found == (keys(changed) == items.keys).all(axis=-1).any(axis=(1, 2))).all()
        return found.mean()

    assert met(texts) == 1 and (keys(texts) == items.keys).all()
    assert met([spoiled(t, 0.2, n)[:len(t)] for n, t in enumerate(texts)]) >= 0.95
    assert met(texts[1:] + texts[:1]) <= 0.2


def test_every_place_of_a_text_is_looked_at():
    """Grams at even and at odd places: a copy at either meets every gram of its item."""
    stream = np.frombuffer(bytes(np.random.default_rng(4).integers(97, 123, 403, dtype=np.uint8)), dtype=np.uint8)
    padded = np.concatenate([stream, np.zeros(8, dtype=np.uint8)])
    grams = np.array([padded[n:n + 4].copy().view(np.uint32)[0] for n in range(len(stream))])
    expected = ((grams * dc.FACTOR) >> np.uint32(32 - dc.SLOT_BITS)).astype(np.int32)
    for size in (0, 1, 2, 3, 4, 5, 7, 402, 403):
        whole = dc.gram_slots(stream[:size])
        assert len(whole) == size and np.array_equal(whole[:max(0, size - 3)], expected[:max(0, size - 3)])
    text = h.prose(5, 30)
    items = dc.Items([(1, text)])
    items.least[:] = len(items.base)  # every gram kept has to be met
    for shift in (0, 1, 2, 3):
        joined = np.frombuffer((" " * shift + text).encode(), dtype=np.uint8)
        assert (0, shift) in set(zip(*(part.tolist() for part in items.placed(joined))))


def test_windows_in_long_streams(spark):
    """A copy is found wherever it lies, also across the pieces a long text is read by."""
    item = h.prose("here", 30)
    filler = h.prose("filler", 40_000)
    for at in (0, 65_300, 65_536, 130_000, len(filler)):
        text = filler[:at] + " " + item + " " + filler[at:]
        joined, _, _ = dc.normal_bytes(*text_bytes(pa.array([text])))
        items = dc.Items([(7, item)])
        assert any(dc.part_distance(item, joined[low:high].tobytes().decode(), 0) == 0 for _, low, high in items.areas(joined)), at


def test_within():
    rng = random.Random(6)
    for _ in range(200):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(2))
        best = dc.part_distance(item, text, len(item))
        assert [dc.within(item, text, limit) for limit in range(len(item))] == [limit >= best for limit in range(len(item))]
        distance, start = dc.best_part(item, text, len(item))
        assert distance == best == min(h.edit_distance(item, text[start:end]) for end in range(start, len(text) + 1))
