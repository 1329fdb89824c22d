"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A text is its lower-cased words in five-word shingles. For every template length there are windows of as many
shingles, an eighth of their length apart. A window's MinHash signature is cut into bands; templates that share a
band are retrieved. With ``ROWS`` rows and ``BANDS`` bands a window that holds a template at Jaccard similarity s
is retrieved with probability 1 - (1 - s**ROWS)**BANDS: above 0.999 from s = 0.6 and 0.99 from s = 0.5, the worst
a containment of 0.75 leaves after the offset of the nearest window. A window without any shingle of a template
cannot share a minimum with one, so signatures are computed only around such shingles; nothing is lost by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docweave.llm.arrays import BASE, IN_WORD, chained, map_batches, mix, shared, words
from docweave.llm.registry import query

SHINGLE = 5
CONTAINMENT = 0.75
ROWS, BANDS = 2, 16
FILTER_BITS = 20

# Public license notices by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def shingles(column):
    """Shingle hashes of the texts, their first words, and the shingle range of every row."""
    hashes, rows, _, _, offsets = words(column, IN_WORD)
    made, first = chained(hashes, rows, SHINGLE)
    owners = rows[first]
    word_base = np.searchsorted(rows, np.arange(len(offsets) - 1))
    return made, first, owners, np.searchsorted(owners, np.arange(len(offsets))), word_base


class Templates:
    """Shingle sets, a bit filter over all of them, and band tables by template length."""

    def __init__(self, templates):
        import pyarrow as pa
        self.names = [name for name, _ in templates]
        made, _, owners, _, _ = shingles(pa.array([text for _, text in templates], pa.string()))
        self.sets = [np.unique(made[owners == n]) for n in range(len(templates))]
        for name, held in zip(self.names, self.sets):
            if not len(held):
                raise ValueError(f"template of {name} has fewer than {SHINGLE} words")
        self.known = np.unique(made)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.bands: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(s) for s in self.sets}):
            numbers = [n for n, s in enumerate(self.sets) if len(s) == size]
            keys = np.concatenate([banded(signature(self.sets[n][None, :], np.ones((1, size), dtype=bool)))[0] for n in numbers])
            owners = np.repeat(numbers, BANDS)
            order = np.argsort(keys, kind="stable")
            self.bands[size] = keys[order], owners[order]


def signature(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """MinHash values of rows of shingles; ``valid`` marks the used cells."""
    made = np.empty((len(values), ROWS * BANDS), dtype=np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for number in range(ROWS * BANDS):
        hashed = mix(values ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        made[:, number] = np.where(valid, hashed, full).min(axis=1)
    return made


def banded(signatures: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signatures), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(signatures), band + 1, dtype=np.uint64)
        for row in range(ROWS):
            key = mix(key * BASE + signatures[:, band * ROWS + row])
        keys[:, band] = key
    return keys


def windows(hits: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one shingle of every grid window that holds a hit, each once. ``low`` and ``high`` bound the hit's row."""
    step = max(1, size // 8)
    first = np.maximum(-(-(hits - size + 1 - low) // step), 0)
    last = (hits - low) // step
    counts = last - first + 1
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(low, counts) + (np.repeat(first, counts) + number) * step
    starts, place = np.unique(starts, return_index=True)
    return starts, np.minimum(starts + size, np.repeat(high, counts)[place])


def scan(documents: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, template, first_word, last_word, containment), one row per occurrence of a template.

    Overlapping windows that verify are one occurrence: it spans the template shingles in them, its containment is
    that of its best window. Null, empty and shorter texts have none; repeated ids are scanned each; other columns
    are not kept.
    """
    index = shared(documents, Templates(templates))

    def work(batch):
        held = index.value
        made, first, owners, offsets, word_base = shingles(batch.column("text"))
        hits = np.flatnonzero(held.filter[(made >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        hits = hits[np.isin(made[hits], held.known)]
        if not len(hits):
            return None
        doc_ids, out = batch.column("doc_id").to_pylist(), []
        low, high = offsets[owners[hits]], offsets[owners[hits] + 1]
        for size, (keys, numbers) in held.bands.items():
            starts, ends = windows(hits, low, high, size)
            found = []
            for at in range(0, len(starts), max(1, 200_000 // size)):
                part = slice(at, at + max(1, 200_000 // size))
                place = starts[part, None] + np.arange(size)
                valid = place < ends[part, None]
                got = banded(signature(made[np.minimum(place, len(made) - 1)], valid))
                left, right = np.searchsorted(keys, got, side="left"), np.searchsorted(keys, got, side="right")
                for window, band in zip(*np.nonzero(right > left)):
                    found.extend((int(numbers[k]), at + int(window)) for k in range(left[window, band], right[window, band]))
            step = max(1, size // 8)
            open_: tuple | None = None
            for number, window in sorted(set(found)):
                row = int(owners[starts[window]])
                begin, end = max(int(starts[window]) - step, offsets[row]), min(int(ends[window]) + step, offsets[row + 1])
                inside = begin + np.flatnonzero(np.isin(made[begin:end], held.sets[number]))
                best = len(np.unique(made[inside])) / len(held.sets[number])
                if best < CONTAINMENT:
                    continue
                span = (number, row, int(inside[0]), int(inside[-1]), best)
                if open_ is not None and open_[:2] == span[:2] and span[2] <= open_[3] + 1:
                    open_ = (number, row, min(open_[2], span[2]), max(open_[3], span[3]), max(open_[4], best))
                else:
                    if open_ is not None:
                        out.append(open_)
                    open_ = span
            if open_ is not None:
                out.append(open_)
        return [[doc_ids[o[1]] for o in out], [held.names[o[0]] for o in out], [o[0] for o in out], [int(first[o[2]] - word_base[o[1]]) for o in out],
                [int(first[o[3]] - word_base[o[1]]) + SHINGLE - 1 for o in out], [o[4] for o in out]]

    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(named, work, "doc_id long, license string, template int, first_word long, last_word long, containment double")


@query("op5_license_scan")
def op5_license_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
