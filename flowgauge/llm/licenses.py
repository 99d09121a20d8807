"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

Runs of consecutive sentences and lines, up to the text as a whole, are candidates. The Dice
coefficient 2 |A & B| / (|A| + |B|) can only reach a threshold t while the
smaller of two bigram counts is at least t / (2 - t) of the larger: templates
sorted by size are cut to that range before any is compared.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.license_texts import TEXTS

#: Short notices of common licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
}
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Passages: between line ends, and between a sentence's end and white space.
CUT = re.compile(r"\n+|(?<=[.!?;])\s+")
RESULT = "array<struct<license:string,dice:double,start:int,end:int>>"


def bigrams(text: str) -> Counter:
    """Counts of the pairs of neighbouring words, lower-cased, between marks for start and end."""
    w = ["", *WORD.findall(text.lower()), ""]
    return Counter(zip(w, w[1:])) if len(w) > 2 else Counter()


def dice(a: Counter, b: Counter) -> float:
    """2 |A & B| / (|A| + |B|) of two bags; 0 where both are empty."""
    both = sum((a & b).values())
    size = a.total() + b.total()
    return 2 * both / size if size else 0.0


class Templates:
    """Templates by size, and which words may neighbour each other in any of them."""

    def __init__(self, texts: dict[str, str | list[str]], threshold: float):
        self.threshold = threshold
        each = [(name, t) for name, ts in texts.items() for t in ([ts] if isinstance(ts, str) else ts)]
        bags = sorted(((bigrams(t).total(), name, bigrams(t)) for name, t in each), key=lambda b: b[:2])
        self.entries = [(n, name, bag) for n, name, bag in bags if n]
        self.smallest = self.entries[0][0] if self.entries else 0
        self.largest = self.entries[-1][0] if self.entries else 0
        #: word numbers; 0 is the mark for start and end, 1 any word outside all templates
        self.numbers = {"": 0}
        for _, _, bag in self.entries:
            for pair in bag:
                for w in pair:
                    self.numbers.setdefault(w, len(self.numbers) + (len(self.numbers) > 0))
        self.base = len(self.numbers) + 1
        self.bags = [{self.numbers[a] * self.base + self.numbers[b]: c for (a, b), c in bag.items()} for _, _, bag in self.entries]
        self.pairs = np.array(sorted({code for bag in self.bags for code in bag}), np.int64)

    def known(self, codes: np.ndarray) -> np.ndarray:
        """Which pairs of words some template has."""
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        return self.pairs[at] == codes

    def runs(self, words: list[str], cuts: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """``(common, template, a, b, dice)`` of the runs of words between two cuts that reach the threshold.

        Of a run just its best template; ties go to the first name.
        """
        share = self.threshold / (2 - self.threshold)
        if len(words) == 0 or not self.entries or (len(words) + 1) < share * self.smallest - 1e-9:
            return []
        ids = np.fromiter((self.numbers.get(w, 1) for w in words), np.int64, len(words))
        codes = ids[:-1] * self.base + ids[1:]
        # a run's bigrams that some template has are at least ``share`` of its own: only such runs are compared
        inner = np.concatenate([[0], np.cumsum(self.known(codes))])
        opens = self.known(ids[cuts[:-1]]).astype(np.int64)
        closes = self.known(ids[cuts[1:] - 1] * self.base).astype(np.int64)
        left = opens - inner[cuts[:-1]] + share * cuts[:-1]
        right = closes + inner[cuts[1:] - 1] - share * (cuts[1:] + 1)
        best_right = np.maximum.accumulate(right[::-1])[::-1]
        found = []
        for i in np.nonzero(left + best_right >= -1e-9)[0].tolist():
            sizes = cuts[i + 1 :] - cuts[i] + 1
            stop = int(np.searchsorted(sizes, self.largest / share + 1e-9, "right"))
            ends = np.nonzero((left[i] + right[i : i + stop] >= -1e-9) & (sizes[:stop] >= share * self.smallest - 1e-9))[0] + i
            if len(ends):
                found += self._from(ids, codes, cuts, int(i), ends.tolist(), share)
        return found

    def _from(self, ids, codes, cuts, i: int, ends: list[int], share: float) -> list[tuple[int, int, int, int, float]]:
        """Matches of the runs from cut ``i``: a bag for each template runs along."""
        a, best = int(cuts[i]), {}
        span = [int(cuts[e + 1]) for e in ends]
        run = codes[a : span[-1] - 1].tolist()
        for t, bag in enumerate(self.bags):
            m = self.entries[t][0]
            if (span[-1] - a + 1) < m * share - 1e-9 or (span[0] - a + 1) * share > m + 1e-9:
                continue
            left, both, at = dict(bag), 0, 0
            first = bag.get(int(ids[a]), 0) > 0
            for b in span:
                n = b - a + 1
                if n * share > m + 1e-9:
                    break
                for code in run[at : b - 1 - a]:
                    if left.get(code, 0) > 0:
                        left[code] -= 1
                        both += 1
                at = max(at, b - 1 - a)
                if n < m * share - 1e-9:
                    continue
                common = both + first + (bag.get(int(ids[b - 1]) * self.base, 0) > 0)
                score = 2 * common / (n + m)
                key = (-score, self.entries[t][1])
                if score >= self.threshold and (b not in best or key < best[b][0]):
                    best[b] = key, (common, t, a, b, score)
        return [m for _, m in best.values()]


def find_licenses(text: str | None, templates: Templates) -> list[tuple[str, float, int, int]]:
    """Matches ``(license, dice, start, end)`` of a text, in order, none of which overlap.

    Of overlapping runs of passages, the one with most bigrams in common stays,
    then the one with the higher coefficient: a licence's text before a notice
    inside it.
    """
    if not text:
        return []
    spans, at = [], 0
    for m in CUT.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    words, cuts, held = [], [0], []
    for s, e in spans:
        w = WORD.findall(text[s:e].lower())
        if w:
            words += w
            cuts.append(len(words))
            held.append((s, e))
    of = {c: k for k, c in enumerate(cuts)}
    out, taken = [], np.zeros(len(words), bool)
    for _, t, a, b, score in sorted(templates.runs(words, np.array(cuts)), key=lambda m: (-m[0], -m[4], m[2], m[3])):
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((templates.entries[t][1], score, held[of[a]][0], held[of[b] - 1][1]))
    return sorted(out, key=lambda m: m[2])


def scan_licenses(docs: DataFrame, templates: dict[str, str | list[str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """``docs`` with ``licenses``: ``(license, dice, start, end)`` of each run of passages that is a licence.

    ``templates`` maps names to texts, one or several each (the notices in ``TEMPLATES`` and
    the bodies and headers in ``license_texts`` if none are given); they
    travel with the task, as a list of licences is small. Offsets are code points.
    Line breaks count as white space. Matches don't overlap. Null and empty texts have none,
    nor have templates without words. Whole texts are scanned, and all columns
    and rows are kept; a column ``licenses`` is replaced.
    """
    both = {k: [t[k] for t in (TEMPLATES, TEXTS) if k in t] for k in [*TEMPLATES, *TEXTS]}
    chosen = both if templates is None else templates

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.Series:
        prepared = Templates(chosen, threshold)
        names = ("license", "dice", "start", "end")
        return pd.Series([[dict(zip(names, m)) for m in find_licenses(t, prepared)] for t in texts], dtype=object)

    return docs.withColumn("licenses", scan(F.col("text")))
