"""License scans: winnowed fingerprints find candidates, banded alignment measures them.

Template words are numbered; k-word shingles of numbers are hashed and winnowed
(the least hash of each window of shingles), and the chosen ones go into an inverted
index from hash to (template, position).  A text is winnowed by the same rule, so
any run of ``k + window - 1`` equal words gives at least one common fingerprint.
Hits of one template whose diagonals lie within a band make one candidate, and each
candidate is aligned once: a local alignment inside the band reports which template
words are matched and where in the text.  A candidate whose stretch of text lacks too
many of the template's words is not aligned.  Of matches that share a place, that with
the most matched, then the fewest missing template words is reported.

The index is as large as the templates: those in the code, or a table of them up to
a stated size (``templates_from``), which go with the task.  A null, empty or short text
has no match; equal best matches of one place are all reported by template name;
repeated rows give repeated matches; an empty table gives an empty result; other
columns are not read.  A text is read whole; its words are held as numbers.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import map_rows

SHINGLE, WINDOW = 3, 2
#: Least share of a template's words that must be matched.
COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+")

# Public license notices and declaration lines.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def winnow(ids: np.ndarray, k: int = SHINGLE, window: int = WINDOW) -> list[tuple[int, int]]:
    """(position, hash) of the chosen shingles.  Shingles with an unknown word (0) are never chosen."""
    n = len(ids) - k + 1
    if n < 1:
        return []
    h, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for j in range(k):
        part = ids[j : j + n].astype(np.uint64)
        known &= part > 0
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    if not known.any():
        return []
    h[~known] = np.uint64(2**64 - 1)
    window = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.unique(np.arange(len(views)) + views.argmin(axis=1))
    return [(int(i), int(h[i])) for i in at if known[i]]


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int) -> tuple[int, int, int, int, int] | None:
    """Local alignment of template ids ``a`` with text ids ``b`` for cells with |j - i - shift| <= band.

    A match is +2, a mismatch or gap -1.  Returns matched words, and the ranges in a and b.
    A row of the band is one array step: gaps in the template carry scores to the right,
    which is a running maximum.
    """
    n, width = len(a), 2 * band + 1
    score = np.zeros((n + 1, width + 1), dtype=np.int32)  # column c is j = i + shift - band + c; the last one stays 0
    c = np.arange(width)
    padded = np.full(n + width, -1, dtype=np.int64)  # b from j = 1 + shift - band on
    lo, hi = max(0, shift - band), min(len(b), shift - band + n + width)
    if hi > lo:
        padded[lo - shift + band : hi - shift + band] = b[lo:hi]
    for i in range(1, n + 1):
        part = padded[i - 1 : i - 1 + width]
        s = np.maximum(score[i - 1, :width] + np.where(part == a[i - 1], 2, -1), score[i - 1, 1 : width + 1] - 1)
        s = np.maximum.accumulate(np.maximum(s, 0) + c) - c
        score[i, :width] = np.where(part >= 0, s, 0)
    if not score.any():
        return None
    i, col = (int(x) for x in np.unravel_index(int(score.argmax()), score.shape))
    end_a, end_b, matched = i, i + shift - band + col, 0
    while i > 0 and score[i, col] > 0:
        same = a[i - 1] == padded[i - 1 + col]
        if score[i, col] == score[i - 1, col] + (2 if same else -1):
            matched += int(same)
            i -= 1
        elif score[i, col] == score[i - 1, col + 1] - 1:
            i, col = i - 1, col + 1
        else:
            col -= 1
    return matched, i, end_a, i + shift - band + col, end_b


class Scanner:
    def __init__(self, templates: dict[str, str] | list[tuple[str, str]] | None = None, coverage: float = COVERAGE):
        self.coverage = coverage
        self.vocabulary: dict[str, int] = {}
        self.names, self.ids = [], []
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        templates = templates or TEMPLATES
        for name, text in sorted(templates.items() if isinstance(templates, dict) else templates):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=np.int64)
            for at, h in winnow(ids):
                self.index[h].append((len(self.ids), at))
            self.names.append(name)
            self.ids.append(ids)

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int, float]]:
        """(template, start, end, matched words, template words, coverage), places in code points, by place and name."""
        if not text:
            return []
        found = _WORD.findall(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w.lower(), 0) for w in found), dtype=np.int64, count=len(found))
        hits: dict[int, set[int]] = defaultdict(set)
        for at, h in winnow(ids):
            for t, p in self.index.get(h, ()):
                hits[t].add(at - p)
        out: list[tuple[int, int, int, int]] = []  # matched words, template, first and last word
        for t, diagonals in sorted(hits.items()):
            for shift, reach in self._diagonals(diagonals, self._band(t)):
                got = self._match(t, ids, shift, reach)
                if got and got not in out[-1:]:
                    out.append(got)
        if not out:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        # from the best on (most matched words, then fewest missing ones): a match goes if a better one has most of its place
        best, kept = np.full(len(ids), -(2**60)), []
        for matched, t, first, last in sorted(set(out), key=lambda x: (-x[0], len(self.ids[x[1]]), *x[1:])):
            worth = (matched << 32) - len(self.ids[t])
            if (best[first:last] > worth).mean() <= 0.5:
                kept.append((self.names[t], spans[first][0], spans[last - 1][1], matched, len(self.ids[t]), matched / len(self.ids[t])))
                best[first:last] = np.maximum(best[first:last], worth)
        return sorted(kept, key=lambda x: (x[1], x[0], x[2]))

    def _band(self, t: int) -> int:
        return max(2, len(self.ids[t]) // 10)

    @staticmethod
    def _diagonals(found: set[int], band: int) -> Iterator[tuple[int, int]]:
        """(middle, reach) of runs of diagonals, each at most ``band`` wide."""
        run: list[int] = []
        for d in [*sorted(found), None]:
            if run and (d is None or d - run[0] > band):
                yield (run[0] + run[-1]) // 2, (run[-1] - run[0] + 1) // 2
                run = []
            if d is not None:
                run.append(d)

    def _match(self, t: int, ids: np.ndarray, shift: int, reach: int) -> tuple[int, int, int, int] | None:
        own, band = self.ids[t], self._band(t) + reach
        lo = max(0, shift - band)
        part = ids[lo : max(lo, shift + len(own) + band)]
        there = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        there[part] = True
        if there[own].sum() < self.coverage * len(own):
            return None
        got = align(own, part, shift - lo, band)
        return None if got is None or got[0] < self.coverage * len(own) else (got[0], t, lo + got[3], lo + got[4])


def templates_from(table: DataFrame, most_bytes: int = 16 << 20) -> list[tuple[str, str]]:
    """Templates of a table (columns template, text), whose texts may have ``most_bytes`` in all; null texts are left out.

    A name may have several texts; each is a template.
    """
    rows = table.select(F.col("template").cast("string").alias("template"), "text").filter("template is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"templates have {size} bytes, more than {most_bytes}")
    return sorted({(r[0], r[1]) for r in rows.collect()})  # at most most_bytes


def scan_documents(docs: DataFrame, templates: dict[str, str] | list[tuple[str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each match: doc_id, template, start, end, matched_words, template_words, coverage."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        scanner = Scanner(templates, coverage)

        def run(c) -> Iterator[tuple]:
            for doc_id, text in zip(*c, strict=True):
                for m in scanner.scan(text):
                    yield doc_id, *m

        return run

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, template string, start long, end long, matched_words long, template_words long, coverage double", make)
