"""License scan: an inverted index of template words and banded alignment.

A match leaves out at most so many words of its template, so it holds one of any one word more than
that: the rarest ones are indexed, and no match can be without an indexed word.  All words of a
document are looked up.  Around every hit each band of diagonals in which enough template words
occur is aligned; of these alignments those that do not overlap and match most words are reported.
Templates are not winnowed: words put in cost nothing, so a match need not hold any run of words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import session, texts_of

WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")

#: Public license notices, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
}


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words with where they begin and end in the text."""
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]


@dataclass
class Index:
    """Words of each template, its places by word, and indexed template places by word."""

    words: dict[str, list[str]] = field(default_factory=dict)
    places: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    rare: dict[str, list[tuple[str, int]]] = field(default_factory=lambda: defaultdict(list))


def enough(length: int, least: float) -> int:
    """The fewest matched words, one at least, with which a template reaches the coverage."""
    return next((n for n in range(1, length + 1) if n / length >= least), length + 1)


def build_index(templates: dict[str, str], least: float) -> Index:
    """Of each template so many places, its rarest words first, that a match of ``least`` coverage holds one; a template without words is left out."""
    index = Index()
    for name, text in sorted(templates.items()):
        words = [w for w, _, _ in words_of(text)]
        if not words:
            continue
        index.words[name] = words
        index.places[name] = defaultdict(list)
        for i, w in enumerate(words):
            index.places[name][w].append(i)
    common = Counter(w for words in index.words.values() for w in words)
    for name, words in index.words.items():
        rarest = sorted(range(len(words)), key=lambda i: (common[words[i]], -len(words[i]), i))
        for i in rarest[: len(words) - enough(len(words), least) + 1]:
            index.rare[words[i]].append((name, i))
    return index


def align(hits: dict[int, list[int]], reach: int) -> dict[int, tuple[int, int]]:
    """By document place of the last matched word: the most template words in order, then the latest first place.

    ``hits`` has the document places of each template place within the band.  Words left out or put in
    cost nothing; two matched words that follow each other are at most ``reach`` places apart.
    """
    best: dict[int, tuple[int, int]] = {}
    for at in sorted(hits):
        found = []
        for j in hits[at]:
            count, start = max((best[p] for p in range(j - reach, j) if p in best), default=(0, j))
            found.append((j, (count + 1, start)))
        for j, here in found:
            if here > best.get(j, (0, 0)):
                best[j] = here
    return best


def apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of alignments (first place, last place, words) those that do not overlap and match most words, on the shortest spans."""
    order = sorted(found, key=lambda r: (r[1], -r[0], r[2]))
    ends = [r[1] for r in order]
    best, taken = [(0, 0)], []
    for a, b, n in order:
        before = bisect_left(ends, a)
        with_it = (best[before][0] + n, best[before][1] - (b - a))
        taken.append(before if with_it > best[-1] else None)
        best.append(max(with_it, best[-1]))
    out, k = [], len(order)
    while k:
        if taken[k - 1] is None:
            k -= 1
        else:
            out.append(order[k - 1])
            k = taken[k - 1]
    return out


def matches(names: list[str], length: int, places: dict[str, list[int]], shifts: list[int], band: int, least: float) -> list[tuple[int, int, int]]:
    """First and last document word and matched words of one template in all bands that hold one of the diagonals ``shifts``."""
    need = enough(length, least)
    groups: list[list[int]] = []
    for shift in sorted(set(shifts)):
        if groups and shift - band <= groups[-1][1] + 1:
            groups[-1][1] = shift + band
        else:
            groups.append([shift - band, shift + band])
    found: set[tuple[int, int, int]] = set()
    for low, high in groups:
        on: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for j in range(max(0, low - band), min(len(names), high + band + length)):
            for at in places.get(names[j], ()):
                if low - band <= j - at <= high + band:
                    on[j - at].append((at, j))
        live = Counter(at for d, pairs in on.items() if d < low + band for at, _ in pairs)
        changed = True
        for shift in range(low, high + 1):
            for at, _ in on.get(shift + band, ()):
                live[at] += 1
                changed = True
            for at, _ in on.get(shift - band - 1, ()):
                changed = True
                live[at] -= 1
                if not live[at]:
                    del live[at]
            if changed and len(live) >= need:
                hits: dict[int, list[int]] = defaultdict(list)
                for d in range(shift - band, shift + band + 1):
                    for at, j in on.get(d, ()):
                        hits[at].append(j)
                found.update((a, b, n) for b, (n, a) in align(hits, 2 * band + 1 + length - need).items() if n >= need)
            changed = False
    return apart(found)


def scan_text(text: str, index: Index, band: int, least: float) -> list[tuple[str, float, int, int, int]]:
    """Matches of a whole text: template, coverage, matched words, begin and end in code points; by begin, then template."""
    words = words_of(text)
    names = [w for w, _, _ in words]
    hits: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(names):
        for name, at in index.rare.get(w, ()):
            hits[name].append(i - at)
    out = []
    for name, shifts in hits.items():
        length = len(index.words[name])
        for a, b, n in matches(names, length, index.places[name], shifts, band, least):
            out.append((name, n / length, n, words[a][1], words[b][2]))
    return sorted(out, key=lambda r: (r[3], r[0], r[4]))


def scan_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] | None = None,
    band: int = 8,
    least: float = 0.8,
    index_bytes: int = 16 << 20,
) -> DataFrame:
    """Return ``key, license, coverage, matched_words, span_start, span_end`` for each match of ``least`` coverage or more.

    A row without a match gives no row; null and empty texts have none.  A text may match several
    templates and one template in several places.  Spans are code points of the whole text.
    Repeated rows give equal matches; other columns are not read; empty tables give empty results.
    Template sets of more than ``index_bytes`` are scanned in blocks of that size, one pass each.
    """
    spark = session(docs.sparkSession)
    own = sorted((TEMPLATES if templates is None else templates).items())
    blocks: list[dict[str, str]] = [{}]
    size = 0
    for name, value in own:
        if size + len(value) > index_bytes and blocks[-1]:
            blocks.append({})
            size = 0
        blocks[-1][name] = value
        size += len(value)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, license string, coverage double, matched_words long, span_start long, span_end long"
    rows = docs.select(F.col(key), F.col(text))
    found = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(build_index(block, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                at, rows = [], []
                for i, x in enumerate(texts_of(batch.column(1), 0, batch.num_rows)):
                    for r in scan_text(x, index, band, least):
                        at.append(i)
                        rows.append(r)
                if rows:
                    a, b, c, d, e = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at, pa.int64())), pa.array(a), pa.array(b, pa.float64()), *(pa.array(v, pa.int64()) for v in (c, d, e))],
                        [key, "license", "coverage", "matched_words", "span_start", "span_end"],
                    )

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found
