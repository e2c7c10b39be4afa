"""License notices in documents: MinHash bands over text windows, then exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import chunks, fold_case, mix, shingle_hashes, span_hashes, word_spans

SHINGLE = 5
CONTAINMENT = 0.8
#: Rows of a band and number of bands.  A window holds all of a template's run and at most three
#: times the least template of its class, so at the containment above their similarity is 0.25 or
#: more, and a window misses its template with a chance below (1 - 0.25 ** 2) ** 160, 0.004 %.
ROWS, BANDS = 2, 160

# Notices of common licenses, as their authors state them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of "
                         "the GNU General Public License as published by the Free Software Foundation, either "
                         "version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def _words(data: np.ndarray, at: np.ndarray):
    """Hash, row, start and end of each word; words are runs of letters, digits and non-ASCII."""
    folded = fold_case(data)
    letter = (folded >= 97) & (folded <= 122) | (folded >= 48) & (folded <= 57) | (folded >= 128)
    folded = np.where(letter, folded, np.uint8(32))
    starts, ends, rows = word_spans(folded, at)
    return span_hashes(folded, starts, ends), rows, starts, ends


@dataclass(frozen=True)
class TemplateIndex:
    """Templates by size class, with their shingles and band hashes."""

    names: tuple[str, ...]
    shingles: list
    every: np.ndarray
    classes: dict
    bands: dict

    @staticmethod
    def of(templates: tuple[tuple[str, str], ...]) -> "TemplateIndex":
        """Templates are (name, text) of at least SHINGLE words."""
        sets, classes, bands = [], {}, {}
        for k, (name, text) in enumerate(templates):
            raw = np.frombuffer(text.encode(), np.uint8)
            words, rows, _, _ = _words(raw, np.array([0, len(raw)]))
            if len(words) < SHINGLE:
                raise ValueError(f"template of {name} has fewer than {SHINGLE} words")
            own = np.unique(shingle_hashes(words, rows, SHINGLE, short=False)[0])
            sets.append(own)
            low = 1 << (len(own).bit_length() - 1)
            classes.setdefault(low, []).append(k)
            for band in band_hashes(own):
                bands.setdefault((low, int(band)), []).append(k)
        every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        return TemplateIndex(tuple(n for n, _ in templates), sets, every, classes, bands)


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS MinHash values each, of a set of shingles."""
    seeds = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64))
    values = (shingles[None, :] ^ seeds[:, None]) * (seeds[::-1, None] | np.uint64(1))
    least = (values ^ (values >> np.uint64(32))).min(1).reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return total


def _row_matches(index: TemplateIndex, shingles: np.ndarray, known: np.ndarray) -> dict:
    """(containment, first, last shingle) of the best place of each template found in one text.

    A window without any template's shingle has no equal MinHash value with a template, so only
    windows around ``known`` shingles are hashed.
    """
    found: dict[int, tuple[float, int, int]] = {}
    places = np.flatnonzero(known)
    for low in index.classes:
        # Windows of 3 * low shingles from each multiple of low: one holds any run of up to 2 * low.
        firsts = np.unique((places // low)[:, None] - np.arange(3)[None, :])
        for first in (firsts[firsts >= 0] * low).tolist():
            window = shingles[first:first + 3 * low]
            near = {k for b in band_hashes(np.unique(window)).tolist() for k in index.bands.get((low, b), ())}
            for k in near:
                inside = np.flatnonzero(np.isin(window, index.shingles[k]))
                share = len(np.unique(window[inside])) / len(index.shingles[k])
                best = found.get(k)
                if share >= CONTAINMENT and (best is None or share > best[0]):
                    found[k] = share, first + int(inside[0]), first + int(inside[-1])
    return found


def license_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``doc_id, license, containment, start, end``: one row per document and license found.

    ``containment`` is the share of a template's 5-word shingles in the best window, at least 0.8;
    [start, end) are the bytes from the first to the last of them.  Of a license with several
    templates, and of places that overlap, the fullest and then longest counts.  Words are runs of
    letters and digits in lower case.  Null, empty and short texts match nothing; repeated rows
    match each; the whole of a long text is scanned.  The templates are a fixed list.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex.of(templates)
        for batch in batches:
            for low, high, data, at in chunks(batch.column(1)):
                words, rows, starts, ends = _words(data, at)
                hashes, owner, first = shingle_hashes(words, rows, SHINGLE, short=False)
                place = np.searchsorted(index.every, hashes)
                place[place == len(index.every)] = 0
                known = index.every[place] == hashes if len(index.every) else np.zeros(len(hashes), bool)
                out = []
                for row in np.unique(owner[known]).tolist():
                    a, b = np.searchsorted(owner, [row, row + 1])
                    spans = [(-share, x - y, index.names[k], int(starts[first[a + x]] - at[row]),
                              int(ends[first[a + y] + SHINGLE - 1] - at[row]))
                             for k, (share, x, y) in _row_matches(index, hashes[a:b], known[a:b]).items()]
                    taken: list[tuple] = []
                    for share, _, name, start, end in sorted(spans):
                        if all(end <= t[3] or t[4] <= start for t in taken) and all(t[1] != name for t in taken):
                            taken.append((row, name, -share, start, end))
                    out += taken
                if out:
                    r, names, shares, starts_, ends_ = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(low, high - low).take(pa.array(r)), pa.array(names),
                         pa.array(shares, pa.float64()), pa.array(starts_, pa.int64()), pa.array(ends_, pa.int64())],
                        ["doc_id", "license", "containment", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, license string, containment double, start long, end long")
