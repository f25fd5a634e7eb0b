"""License scan: winnowed fingerprints pick candidates, banded alignment decides.

Words are runs of word characters, compared in lower case. A text's fingerprints are the hashes of
its three-word grams that are smallest in some window of three grams (the last one on
ties), so any run of five words that two texts share has a fingerprint of both. The templates'
fingerprints form an inverted index: hash to (template, position). Hits of one template
that go forward on near diagonals are one candidate, and a banded longest common
subsequence of the template and the document's words around it gives the matched words, their
share of the template (coverage), and the span from the first to the last matched word.

Documents are scanned where they are read: nothing is shuffled. The index depends on the
templates alone; its size is checked and it travels with the tasks.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import text_of

GRAM, WINDOW = 3, 3
COVERAGE, BAND = 0.8, 8
#: Diagonals of one candidate's neighbouring hits differ by this at most; below the length of any template.
NEAR = GRAM + WINDOW - 2
MOST_POSTINGS = 2_000_000
_CACHE = 500_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Common license notices in their own words.
LICENSES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


class _WordHashes(dict):
    """64-bit hashes of lower-cased words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.lower())
        return value


def gram_hashes(words: list[str], known: _WordHashes) -> np.ndarray:
    """Hash of every gram of GRAM words."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < GRAM:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(len(h) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        mixed = (mixed ^ h[i : len(h) - GRAM + 1 + i]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: the last smallest hash of every window; of a shorter text, the smallest."""
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, np.int64)
    windows = len(hashes) - WINDOW + 1
    least, place = hashes[:windows].copy(), np.arange(windows)
    for i in range(1, WINDOW):
        here = hashes[i : windows + i]
        lower = here <= least
        least[lower] = here[lower]
        place[lower] = np.flatnonzero(lower) + i
    chosen = np.zeros(len(hashes), bool)
    chosen[place] = True
    return np.flatnonzero(chosen)


class TemplateIndex:
    """Templates' words and their inverted index of fingerprints."""

    def __init__(self, templates: Mapping[str, str]):
        known = _WordHashes()
        self.names = sorted(templates)
        self.words = [[w.lower() for w in _WORD.findall(templates[n])] for n in self.names]
        if any(len(w) < GRAM + WINDOW - 1 for w in self.words):
            raise ValueError(f"a template needs {GRAM + WINDOW - 1} words")
        prints = [(int(h[p]), t, int(p)) for t, w in enumerate(self.words) for h in [gram_hashes(w, known)] for p in winnow(h)]
        if len(prints) > MOST_POSTINGS:
            raise ValueError(f"more than {MOST_POSTINGS} fingerprints of templates")
        postings = np.array(sorted(prints), dtype=[("hash", np.uint64), ("template", np.int64), ("at", np.int64)])
        self.hashes, self.template, self.at = (np.ascontiguousarray(postings[n]) for n in ("hash", "template", "at"))

    def hits(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, position, diagonal) of every fingerprint of a text that a template has too."""
        at = winnow(hashes)
        low = np.searchsorted(self.hashes, hashes[at], "left")
        found = []
        for i in np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == hashes[at]).tolist():
            for j in range(low[i], int(np.searchsorted(self.hashes, hashes[at[i]], "right"))):
                found.append((int(self.template[j]), int(at[i]), int(at[i] - self.at[j])))
        return sorted(found)


def aligned(template: list[str], words: list[str], low: int, high: int) -> tuple[int, int, int]:
    """Banded longest common subsequence: matched words, first and last matched position in ``words``.

    Word i of the template may meet positions i + low .. i + high. Of equally long ones,
    the one that begins nearest to the middle of the band wins, then the shorter.
    """
    width, middle = high - low + 1, (low + high) // 2
    better = lambda c: (c[0], -abs(c[1] - middle), -c[2])
    # One cell per diagonal: (matched, first, last).
    none = (0, middle, -1)
    row = [none] * (width + 1)
    for i, word in enumerate(template):
        for d in range(width):
            j = i + low + d
            # row[d] still holds (i - 1, j - 1), row[d + 1] (i - 1, j), and row[d - 1] already (i, j - 1).
            best = max(row[d], row[d + 1], row[d - 1] if d else none, key=better)
            if 0 <= j < len(words) and words[j] == word:
                matched, first, _ = row[d]
                best = max(best, (matched + 1, first if matched else j, j), key=better)
            row[d] = best
    return max(row, key=better)


def scan_text(text: str, index: TemplateIndex, known: _WordHashes, coverage: float = COVERAGE, band: int = BAND) -> list[tuple[str, int, int, int, float]]:
    """Matches of a text: (template, first character, end character, matched words, coverage), by position."""
    hits = index.hits(gram_hashes(_WORD.findall(text), known))
    if not hits:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    found = []
    at = 0
    while at < len(hits):
        # A candidate: hits that go forward in text and template, on diagonals near the last one.
        stop, low, high = at + 1, hits[at][2], hits[at][2]
        while stop < len(hits) and hits[stop][0] == hits[at][0]:
            (_, before, was), (_, position, diagonal) = hits[stop - 1], hits[stop]
            if position - diagonal <= before - was or abs(diagonal - was) > NEAR:
                break
            low, high, stop = min(low, diagonal), max(high, diagonal), stop + 1
        template = index.words[hits[at][0]]
        matched, first, last = aligned(template, words, low - band, high + band)
        if matched >= coverage * len(template):
            found.append((index.names[hits[at][0]], first, last, matched, matched / len(template)))
        at = stop
    # Of matches of one template that overlap, the fuller one stays.
    kept: list[tuple[str, int, int, int, float]] = []
    taken: dict[str, list[tuple[int, int]]] = {}
    for match in sorted(found, key=lambda m: (m[0], -m[4], m[1], m[2])):
        row = taken.setdefault(match[0], [])
        place = bisect(row, (match[1], match[2]))
        if (place == 0 or row[place - 1][1] < match[1]) and (place == len(row) or match[2] < row[place][0]):
            row.insert(place, (match[1], match[2]))
            kept.append(match)
    return sorted((n, spans[a][0], spans[b][1], m, c) for n, a, b, m, c in kept)


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = LICENSES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """Matches of templates in every row's whole text.

    Returns one row per match: id_col, template, span_start and span_end (code points of the text,
    end exclusive), matched_words, coverage (matched share of the template's words, ``coverage``
    at least). Null and empty texts match nothing; rows are scanned one by one, so a repeated row
    repeats its matches. Templates have five words at least. Other columns are not
    read; an empty table gives no rows.
    """
    index = TemplateIndex(templates)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for part in parts:
            rows, owner = [], []
            for i, text in enumerate(part.column(1)):
                found = scan_text(text.as_py(), index, known, coverage, band)
                rows += found
                owner += [i] * len(found)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *columns], names=[id_col, "template", "span_start", "span_end", "matched_words", "coverage"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(id_col, text_of(text_col).alias("_text"))
    return source.mapInArrow(batches, f"{id_col} {kind}, template string, span_start long, span_end long, matched_words long, coverage double")
