"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

The inverted index maps the fingerprint hash of GRAM words to the places where
templates hold it. A document's fingerprints that it holds give candidate
diagonals (document place minus template place); around each of them the template
is aligned inside a band of BAND words, and the stretches that do not overlap are kept.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .license_texts import TEXTS
from .shared import as_bytes, chunks_by_bytes, mix64, word_spans

GRAM, WINNOW, BAND = 3, 2, 12
#: Share of a template's words that a report needs.
COVERAGE = 0.8

# Public licence notices and opening paragraphs; whole texts and file headers come after them.
TEMPLATES = {
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-notice": "Released under the BSD License. Use of this source code is governed by a BSD-style license.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
} | TEXTS

_PARTS = np.ones(256, bool)
_PARTS[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = False
_PARTS[128:] = False


def _grams(h: np.ndarray) -> np.ndarray:
    n = max(len(h) - GRAM + 1, 0)
    return mix64(sum((h[j : j + n] * np.uint64(2 * 7919**j + 1) for j in range(GRAM)), np.zeros(n, np.uint64)))


def _winnowed(g: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of each WINNOW consecutive ones."""
    if len(g) < WINNOW:
        return np.arange(len(g))
    least = np.min([g[j : len(g) - WINNOW + 1 + j] for j in range(WINNOW)], axis=0)
    keep = np.zeros(len(g), bool)
    for j in range(WINNOW):
        keep[j : len(g) - WINNOW + 1 + j] |= g[j : len(g) - WINNOW + 1 + j] == least
    return np.flatnonzero(keep)


@dataclass
class Index:
    """Templates' words and the inverted index of their fingerprints, sorted by hash."""

    names: list[str]
    words: list[np.ndarray]
    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, templates: dict[str, str]) -> "Index":
        names = sorted(templates)
        h, at, _, _ = word_spans(as_bytes([templates[n] for n in names], ascii_lower=True), _PARTS)
        words = [h[a:b] for a, b in zip(at, at[1:])]
        rows = [(g[i], t, i) for t, w in enumerate(words) for g in [_grams(w)] for i in _winnowed(g)]
        rows.sort()
        return cls(names, words, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of g, entry of the index) of all equal pairs."""
        lo, hi = np.searchsorted(self.hashes, g, "left"), np.searchsorted(self.hashes, g, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(g)), n)
        return which, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def stretches(template: np.ndarray, words: np.ndarray, shift: int, least: int, band: int = BAND) -> list[tuple[int, int, int]]:
    """(end, first, matched) of the stretches of ``words`` that match ``least`` or more words of the template around one diagonal.

    Template word i may match words i + shift - band .. i + shift + band; gaps are
    free inside the band, so the score of a stretch is the longest common
    subsequence there. For each score come the stretches that hold no shorter one of it.
    """
    n = len(template)
    lo, hi = max(shift - band, 0), min(shift + n + band, len(words))
    least = max(least, 1)
    if hi - lo < least:
        return []
    off = np.arange(lo - shift, hi - shift)[:, None] - np.arange(n)
    match = (words[lo:hi, None] == template) & (np.abs(off) <= band)
    if match.any(0).sum() < least:
        return []
    at = np.flatnonzero(match.any(1))
    # score[a, j]: the best of the template's first j words and the words from the a-th of ``at`` on.
    score = np.zeros((len(at), n + 1), np.int32)
    reached = np.zeros((len(at), len(at)), np.int32)
    for e, w in enumerate(at):
        old = score[: e + 1]
        new = np.maximum(old[:, 1:], np.where(match[w], old[:, :-1] + 1, 0))
        score[: e + 1, 1:] = np.maximum.accumulate(new, axis=1)
        reached[e] = score[:, n]
    out = []
    for m in range(least, int(reached[-1].max()) + 1):
        a = np.flatnonzero(reached[-1] >= m)
        e = (reached[:, a] >= m).argmax(0)
        last = np.append(e[1:] != e[:-1], True)  # of one end the latest start
        out += [(lo + int(at[y]) + 1, lo + int(at[x]), m) for x, y in zip(a[last], e[last])]
    return out


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment around one diagonal; among the best the shortest stretch, then the first."""
    found = [(m, a - e, -a, e) for e, a, m in stretches(template, words, shift, 1, band)]
    m, _, a, e = max(found, default=(0, 0, 0, 0))
    return m, -a, e


def apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (end, first, matched) those without overlap that match most words in all; then the fewest, the shortest, the first."""
    ends, best, back = [0], [(0, 0, 0)], [(0, (0, 0, 0))]
    for one in sorted(found):
        e, a, m = one
        i = bisect_right(ends, a) - 1
        value = (best[i][0] + m, best[i][1] - 1, best[i][2] - (e - a))
        if value > best[-1]:
            if ends[-1] == e:
                best[-1], back[-1] = value, (i, one)
            else:
                ends.append(e), best.append(value), back.append((i, one))
    out, i = [], len(ends) - 1
    while i:
        i, one = back[i]
        out.append(one)
    return out[::-1]


def scan_text(words: np.ndarray, index: Index, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, end word) of the reports in one text.

    Every diagonal with a fingerprint is aligned. Stretches of one template do not
    overlap: of all that cover it, those are kept that match most words in all.
    """
    g = _grams(words)
    at = _winnowed(g)
    which, entry = index.hits(g[at])
    found: dict[int, set[tuple[int, int, int]]] = {}
    for t, shift in set(zip(index.template[entry].tolist(), (at[which] - index.place[entry]).tolist())):
        n = len(index.words[t])
        least = next(m for m in range(n + 2) if m >= coverage * n or m > n)
        found.setdefault(t, set()).update(stretches(index.words[t], words, shift, least))
    return sorted((t, m, a, e) for t, some in found.items() for e, a, m in apart(some))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, matched, template_words, coverage, start, end: one row for each stretch of a text that covers a template.

    Words are runs of ASCII letters and digits, A-Z lower-cased, and non-ASCII
    characters. start and end are code points of the text, end exclusive. Null
    and empty texts, and texts without a stretch, give no row; rows that repeat
    report each. Stretches of one license in one text do not overlap; of equally good
    choices the fewest, the shortest and then the first stretches are reported. Texts
    of any length are scanned whole, a portion of bytes or one text at a time; other
    columns are not read. Templates are a parameter and go to every task.
    """
    index = Index.of(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            texts = b["text"].tolist()
            ids = b["doc_id"].tolist()
            for part in chunks_by_bytes([len(t or "") for t in texts]):
                i = part.start
                data = as_bytes(texts[part], ascii_lower=True)
                h, at, start, end = word_spans(data, _PARTS)
                g = _grams(h)
                known = np.isin(g, index.hashes)  # texts without any indexed run are done
                doc = np.searchsorted(at, np.flatnonzero(known), "right") - 1
                for d in np.unique(doc):
                    s = slice(at[d], at[d + 1])
                    found = scan_text(h[s], index, coverage)
                    # Code points before each byte: all bytes but those that continue a character.
                    before = np.concatenate([[0], np.cumsum((np.frombuffer(data[d], np.uint8) & 0xC0) != 0x80)]) if found else None
                    for t, matched, first, last in found:
                        n = len(index.words[t])
                        out.append((ids[i + d], index.names[t], matched, n, matched / n, int(before[start[s][first]]), int(before[end[s][last - 1]])))
            yield pd.DataFrame(out, columns=["doc_id", "license", "matched", "template_words", "coverage", "start", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, license string, matched long, template_words long, coverage double, start long, end long")
