"""License scans by patience alignment.

Texts and templates are compared word by word. Words that occur once in both are anchors; the longest increasing
subsequence of their places is kept, and the gaps between anchors are aligned in the same way. A gap without such words
is matched from its two ends. ``coverage`` is the share of the template's words that are aligned within one window of
the text; a license is found from ``COVERAGE`` on, if the words that tell it from others (its name and version, ``NAMES``)
are among those aligned. The templates are mentions, notices and short license texts; longer texts can be given as
templates too. Of those over ``LONG`` words, all windows that can reach the coverage are aligned as one region, and what
a finding leaves of it is searched again.

Only texts that can reach that coverage are aligned: a text that lacks too many of a template's words can't. The test
for this is exact: of any ``missing + 1`` words of a template, each text that is found has one, so the rarest such words
are searched first. Alignment then runs in windows around them, so a template that is found twice is found at both places
and words spread over a long text don't add up to a license.

Defined results: null and empty texts have no findings and no rows. Texts of any length are scanned whole. Repeated rows
each give their rows; ties in coverage at one place go to the longer template, then to the name. Other columns are
ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from factlake.llm._common import lean, no_clash

COVERAGE = 0.8

LONG = 100
#: Mentions, notices and short license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "BSD": "Released under the BSD License",
    "ISC": "Released under the ISC License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0",
    "CC-BY-3.0": "Licensed under CC BY 3.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-text": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "Zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "WTFPL-text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
}
#: Words of a template without which a text is not that license.
NAMES = {
    "Apache-2.0": "apache 2 0", "MIT": "mit", "BSD": "bsd", "ISC": "isc", "CC-BY-NC-4.0": "cc nc 4 0", "CC-BY-4.0": "cc 4 0", "CC-BY-SA-4.0": "cc sa 4 0", "CC-BY-SA-3.0": "cc sa 3 0", "CC-BY-3.0": "cc 3 0",
    "GPL-3.0": "general public 3", "GPL-2.0": "general public 2", "LGPL-2.1": "lesser public 2 1", "LGPL-3.0": "lesser public 3", "AGPL-3.0": "affero public 3", "MPL-2.0": "mozilla 2 0", "EPL-2.0": "eclipse 2 0",
    "Apache-2.0-notice": "apache 2 0", "GPL-notice": "general public version", "LGPL-notice": "lesser public version", "AGPL-notice": "affero public version",
}
_WORD = re.compile(r"[^\W_]+")
#: Words of licenses that other prose uses too; they are the last choice for the search.
_COMMON = frozenset("the a an of to in and or is are be by this that it you with without as at for on any use not may work version form file free person rights text under".split())


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, ascending in the first place, that ascends in the second too: patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        p = bisect_left(tops, b)
        back[i] = piles[p - 1] if p else -1
        tops[p : p + 1] = [b]
        piles[p : p + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of equal words in a and b, ascending."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i0 + 1, i1, j0 + 1, j1) for (i0, j0), (i1, j1) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    """The templates with the words to search for."""

    def __init__(self, templates: dict[str, str], coverage: float, names: dict[str, str] | None = None):
        self.least = coverage
        self.words = {name: w for name, t in templates.items() if (w := tokens(t))}
        self.need = {name: frozenset(tokens((names or {}).get(name, ""))) for name in self.words}
        use = Counter(w for ws in self.words.values() for w in set(ws))
        self.search: dict[str, list[str]] = {}
        for name, ws in self.words.items():
            missing = len(ws) - max(1, -(-int(round(coverage * len(ws) * 1e6)) // 1_000_000))
            chosen: list[str] = []
            left = missing + 1

            def rank(w: str) -> tuple:
                return (w in _COMMON or len(w) < 3, use[w] if len(w) > 2 else 99, -len(w), w)

            if self.need[name]:  # each finding has all of these: the rarest will do
                chosen, left = [min(self.need[name], key=rank)], 0
            for w in sorted(set(ws), key=rank):
                if left <= 0:
                    break
                chosen.append(w)
                left -= ws.count(w)
            for w in chosen:
                self.search.setdefault(w, []).append(name)
        self.pattern = rf"(?i)(?:^|[^0-9a-z])(?:{'|'.join(map(re.escape, sorted(self.search)))})(?:[^0-9a-z]|$)" if self.search else r"[^\s\S]"

    def _aligned(self, name: str, own: list[str], lo: int, hi: int) -> tuple[str, float, int, int, int] | None:
        """A finding in that part of a text."""
        t = self.words[name]
        pairs = align(t, own[lo:hi])
        if len(pairs) / len(t) < self.least or not self.need[name] <= {t[i] for i, _ in pairs}:
            return None
        return name, len(pairs) / len(t), len(pairs), lo + pairs[0][1], lo + pairs[-1][1]

    def _regions(self, name: str, own: list[str], at: list[int]) -> list[tuple[str, float, int, int, int]]:
        """Findings of a long template: windows that have enough of its words are aligned together."""
        t = self.words[name]
        known = frozenset(t)
        total = [0, *accumulate(w in known for w in own)]
        regions: list[list[int]] = []
        for i in at:
            lo, hi = max(0, i - len(t) - 4), min(len(own), i + len(t) + 5)
            if total[hi] - total[lo] >= self.least * len(t):
                if regions and lo <= regions[-1][1]:
                    regions[-1][1] = hi
                else:
                    regions.append([lo, hi])
        found = []
        while regions:
            lo, hi = regions.pop()
            if total[hi] - total[lo] >= self.least * len(t) and (f := self._aligned(name, own, lo, hi)):
                found.append(f)
                regions += [[lo, f[3]], [f[4] + 1, hi]]
        return found

    def __call__(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(name, coverage, matched, first word, last word) of each license found in text, first place first."""
        own = tokens(text)
        spots: dict[str, list[int]] = {}
        for i, w in enumerate(own):
            for name in self.search.get(w, ()):
                spots.setdefault(name, []).append(i)
        found: list[tuple[str, float, int, int, int]] = []
        for name, at in spots.items():
            t = self.words[name]
            if len(t) > LONG:
                found += self._regions(name, own, at)
                continue
            known = frozenset(t)
            done = -1
            for i in at:
                if i <= done:
                    continue
                lo, hi = max(0, i - len(t) - 4, done + 1), min(len(own), i + len(t) + 5)
                if sum(w in known for w in own[lo:hi]) < self.least * len(t):
                    continue
                f = self._aligned(name, own, lo, hi)
                if f:
                    found.append(f)
                    if f[1] == 1:  # a spot after a partial finding may give a better one; the best is kept below
                        done = f[4]
        # of findings that overlap, the one with most aligned words stays
        kept: list[tuple[str, float, int, int, int]] = []
        for f in sorted(found, key=lambda f: (-f[2], -f[1], -len(self.words[f[0]]), f[0])):
            if all(f[4] < k[3] or f[3] > k[4] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: (f[3], f[0]))


_scanners: dict[tuple, Scanner] = {}


def scan(df: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, names: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, coverage, matched_words, first_word, last_word), one row for each license found in a text.

    Own templates may come with the words that each must have; without, coverage alone decides.
    """
    chosen, needed = dict(templates or TEMPLATES), dict(names or (NAMES if templates is None else {}))
    key = (tuple(sorted(chosen.items())), tuple(sorted(needed.items())), coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners[key] = Scanner(chosen, coverage, needed)
        work = _scanners[key]
        for b in batches:
            hit = b.filter(pc.fill_null(pc.match_substring_regex(b.column(1), work.pattern), False))
            rows = [(d, *f) for d, t in zip(hit.column(0).to_pylist(), hit.column(1).to_pylist()) for f in work(t)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))],
                                             ["doc_id", "license", "coverage", "matched_words", "first_word", "last_word"])

    return no_clash(df, "doc_id", "text").mapInArrow(lean(run), "doc_id long, license string, coverage double, matched_words long, first_word long, last_word long")
