"""Operator 1: license scan by patience alignment.

A text's stretch around a template's key words is aligned with the template.  These are its least common words, one more
than ``COVERAGE`` lets be missing (``KEYS`` at least), each at all its places, so no stretch of that coverage lacks all of
them.  A stretch ends before the same key of the notice before and after, so that copies side by side leave that word unique.  Texts and
stretches that lack more of the template's distinct words than that are not aligned.  Words that occur once in both are anchors, the
longest increasing subsequence of anchors is kept, and the gaps between them are aligned in the same way, down to common first and
last words.  Coverage is the share of the template's words that are aligned.  Of
the stretches and templates that overlap, the one with the most aligned words is reported, if its coverage reaches
``COVERAGE``.

Texts without any key word of any template are passed over where they are read; such texts cannot reach ``COVERAGE``.

Edge cases: null and empty texts give no rows; a license named several times is one row for each place; repeated rows give
repeated results; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices

COVERAGE = 0.8
#: The license notices that are looked for.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_TOKEN = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
KEYS = 3


def tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words without case (letters and digits, and version numbers), their starts and ends in code points."""
    found = list(_TOKEN.finditer(text))
    return [m[0].lower() for m in found], [m.start() for m in found], [m.end() for m in found]


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    places: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(places[k - 1] if k else -1)
        tops[k : k + 1], places[k : k + 1] = [v], [i]
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words in a and b, increasing in both."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        anchors = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        if anchors:
            out += anchors
            for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
                if k > i + 1 and m > j + 1:
                    work.append((i + 1, k, j + 1, m))
    return sorted(out)


def own_words(words: list[str], lo: int, hi: int, template: list[str]) -> list[tuple[int, int]]:
    """The alignment of words[lo:hi], whose first and last words are not those of a notice beside it: a few words that stand
    further off than twice their number are left out, and what is left is aligned anew."""
    while True:
        pairs = [(lo + i, j) for i, j in align(words[lo:hi], template)]
        off = [i - j for i, j in pairs]
        gaps = [k for k in range(1, len(off)) if off[k] - off[k - 1] > 2 * min(k, len(off) - k)]
        if not gaps:
            return pairs
        k = min(gaps, key=lambda k: min(k, len(off) - k))
        lo, hi = (pairs[k - 1][0] + 1, hi) if k <= len(off) - k else (lo, pairs[k][0])


class Scanner:
    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: tokens(t)[0] for name, t in templates.items()}
        uses = Counter(w for words in self.words.values() for w in set(words))
        self.distinct = {name: set(words) for name, words in self.words.items()}
        #: How many words of a template may be missing.
        self.spare = {name: len(words) - math.ceil(COVERAGE * len(words)) for name, words in self.words.items()}
        common = Counter(w for words in self.words.values() for w in words)
        #: By key word: (template, place in it, its number of places there).
        self.keys: dict[str, list[tuple[str, int, int]]] = {}
        for name, words in self.words.items():
            for w in sorted(set(words), key=lambda w: (uses[w], common[w], -len(w), w))[: max(KEYS, self.spare[name] + 1)]:
                self.keys.setdefault(w, []).extend((name, i, words.count(w)) for i, x in enumerate(words) if x == w)

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, aligned words, start, end) of each notice, in order."""
        words, starts, ends = tokens(text)
        have = set(words)
        near = {name for name, own in self.distinct.items() if len(own - have) <= self.spare[name]}
        if not near:
            return []
        tried, found = set(), []
        places: dict[str, list[int]] = {}
        for at, w in enumerate(words):
            if w in self.keys:
                places.setdefault(w, []).append(at)
        for w, own in places.items():
            for name, place, uses in self.keys[w]:
                if name not in near:
                    continue
                template = self.words[name]
                slack = len(template) // 4 + 2
                for i, at in enumerate(own):
                    lo = max(0, at - place - slack, own[i - uses] + 1 if i >= uses else 0)
                    hi = min(len(words), at - place + len(template) + slack, own[i + uses] if i + uses < len(own) else len(words))
                    if (name, lo, hi) in tried:
                        continue
                    tried.add((name, lo, hi))
                    if len(self.distinct[name].difference(words[lo:hi])) > self.spare[name]:
                        continue
                    pairs = own_words(words, lo, hi, template)
                    if len(pairs) >= COVERAGE * len(template):
                        found.append((len(pairs), len(pairs) / len(template), name, pairs[0][0], pairs[-1][0]))
        taken: list[tuple[int, int]] = []
        out = []
        waiting = [(-n, -share, first, last, name, 0) for n, share, name, first, last in found]
        heapify(waiting)
        while waiting:
            n, share, first, last, name, again = heappop(waiting)
            k = bisect_left(taken, (last + 1,)) - 1
            if k < 0 or taken[k][1] < first:
                insort(taken, (first, last))
                out.append((name, -share, -n, starts[first], ends[last]))
            elif not again:  # what a better notice beside it leaves of it
                template, middle = self.words[name], (first + last) // 2
                k = bisect_left(taken, (middle + 1,)) - 1
                if k < 0 or taken[k][1] < middle:
                    lo = max(first - len(template) // 4, taken[k][1] + 1 if k >= 0 else 0)
                    pairs = own_words(words, lo, min(last + 1 + len(template) // 4, taken[k + 1][0] if k + 1 < len(taken) else len(words)), template)
                    if len(pairs) >= COVERAGE * len(template):
                        heappush(waiting, (-len(pairs), -len(pairs) / len(template), pairs[0][0], pairs[-1][0], name, 1))
        return sorted(out, key=lambda f: f[3])


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each notice: id, license, coverage, matched_words, start, end (code points)."""
    kind = docs.schema[id_col].dataType.simpleString()
    known = Scanner(templates)
    any_key = "(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(k) for k in sorted(known.keys)) + ")(?![a-z0-9])"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(i, *f) for i, text in enumerate(part.column(1).to_pylist()) for f in known.scan(text)]
                if rows:
                    place, name, share, n, start, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place)), pa.array(name), pa.array(share), pa.array(n, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["id", "license", "coverage", "matched_words", "start", "end"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(any_key))
    return read.mapInArrow(scan, f"id {kind}, license string, coverage double, matched_words long, start long, end long").withColumnRenamed("id", id_col)
