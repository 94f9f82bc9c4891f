"""License scan: winnowed fingerprints, then banded alignment.

Words are lower-case runs of letters and digits. Of each template's k-word
hashes, the smallest of each window of W is a fingerprint (all of a template
shorter than such a window); they form an inverted index. All k-word hashes of
a document probe it, so wherever a document has W + k - 1 words of a template
in a row, it hits. Hits of one template on nearly one diagonal are a candidate,
and the words of the template are aligned with the document's words in a band
around it: the best local alignment gives the matched words and the span. The
candidates of a batch advance together, one template word at a time.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm import wordhash as W
from newslake.llm.common import row_blocks, text_buffers
from newslake.llm.toxicity import BETWEEN

K, WINDOW = 3, 4
MATCH, OTHER, GAP = 2, -1, -1

# Texts of public licence notices: fixed values.
NOTICES = [
    ("MIT-notice", "Released under the MIT License."),
    ("MIT-licensed", "Licensed under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-network", "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."),
    ("EPL-2.0-header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
]
#: Words from which paragraphs of a whole text are a part of their own.
PART = 60


def parts_of(name: str, text: str) -> list[tuple[str, str]]:
    """A whole text cut into runs of paragraphs, so that each can be aligned in
    a narrow band and a document that holds a part of the text is found by it."""
    runs: list[str] = [""]
    for paragraph in re.split(r"\n\s*\n", text):
        if len(runs[-1].split()) >= PART:
            runs.append("")
        runs[-1] = f"{runs[-1]} {' '.join(paragraph.split())}"
    if len(runs) > 1 and len(runs[-1].split()) < PART // 2:
        last = runs.pop()
        runs[-1] += last
    runs = [re.sub(r"^[\W_]+|[\W_]+$", "", r) for r in runs]
    return [(f"{name}-text" if len(runs) == 1 else f"{name}-text-{i}/{len(runs)}", r) for i, r in enumerate(runs, 1)]


# Whole texts of public licences, in files beside this module.
TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
TEMPLATES = NOTICES + [part for name, text in TEXTS.items() for part in parts_of(name, text)]


def _words(texts: pa.Array) -> W.Words:
    data, offsets = text_buffers(texts)
    return W.Words(data, offsets, space=BETWEEN)


class Index:
    """The inverted index of the templates: sorted fingerprints with their
    template and place, and the word hashes of each template."""

    def __init__(self, templates: list[tuple[str, str]], k: int = K, window: int = WINDOW):
        self.names, self.k = [n for n, _ in templates], k
        w = _words(pa.array([t for _, t in templates], pa.string()))
        h = w.hashes()
        self.words = [h[a:b] for a, b in zip(w.at[:-1], w.at[1:])]
        self.own = [np.unique(x) for x in self.words]
        entries = set()
        for t, word in enumerate(self.words):
            n = len(word)
            if not n:
                continue
            grams = grams_of(word, min(k, n))
            for lo in range(max(1, len(grams) - window + 1)):
                part = grams[lo: lo + window]
                picks = [int(np.argmin(part))] if len(grams) >= window else range(len(part))
                entries |= {(int(grams[lo + i]), t, lo + i) for i in picks}
        entries = sorted(entries)
        self.hash = np.array([e[0] for e in entries], np.uint64)
        self.template = np.array([e[1] for e in entries], np.int64)
        self.place = np.array([e[2] for e in entries], np.int64)
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.hash & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.short = sorted({len(x) for x in self.words if 0 < len(x) < k})


def grams_of(word: np.ndarray, k: int) -> np.ndarray:
    n = len(word) - k + 1
    out = np.full(max(n, 0), np.uint64(k), np.uint64)
    for j in range(k):
        out = out + word[j: j + n] * W._PLACE[j]
    return W.mix(out)


def band(m: int) -> int:
    return 2 + m // 8


def align(template: np.ndarray, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, diagonal: np.ndarray):
    """Best local alignment of a template with the words ``lo .. hi`` of each
    candidate, in a band around ``diagonal`` (the word where the template would
    begin): matched words, first and last word of the span."""
    m, b, n = len(template), band(len(template)), len(diagonal)
    width = 2 * b + 1
    score = np.zeros((width + 1, n), np.int64)
    hits = np.zeros((width + 1, n), np.int64)
    begin = np.full((width + 1, n), -1, np.int64)
    best = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)]
    for i in range(m):
        s2, h2, b2 = np.zeros_like(score), np.zeros_like(hits), np.full_like(begin, -1)
        for c in range(width):
            j = diagonal + i + c - b
            inside = (j >= lo) & (j < hi)
            same = inside & (word[np.clip(j, 0, len(word) - 1)] == template[i])
            s = score[c] + np.where(same, MATCH, OTHER)
            h = hits[c] + same
            g = np.where(score[c] > 0, begin[c], j)
            up = score[c + 1] + GAP  # a word of the template is missing
            use = up > s
            s, h, g = np.where(use, up, s), np.where(use, hits[c + 1], h), np.where(use, begin[c + 1], g)
            if c:
                left = s2[c - 1] + GAP  # the document has a word more
                use = left > s
                s, h, g = np.where(use, left, s), np.where(use, h2[c - 1], h), np.where(use, b2[c - 1], g)
            s = np.where(inside, s, 0)
            live = s > 0
            s2[c], h2[c], b2[c] = np.where(live, s, 0), np.where(live, h, 0), np.where(live, g, -1)
            better = s2[c] > best[0]
            for k, v in enumerate((s2[c], h2[c], b2[c], j)):
                best[k] = np.where(better, v, best[k])
        score, hits, begin = s2, h2, b2
    return best[1], best[2], best[3]


def find(texts: pa.Array, index: Index, percent: int):
    """(row, template, matched words, first and end code point) of the matches in a block of texts."""
    data, offsets = text_buffers(texts)
    out = []
    for a, z in row_blocks(offsets):
        part, at = data[offsets[a]: offsets[z]], offsets[a: z + 1] - offsets[a]
        w = W.Words(part, at, space=BETWEEN)
        if not len(w.start) or not len(index.hash):
            continue
        h = w.hashes()
        found = []
        for k in [*index.short, index.k]:
            g = grams_of(h, k)
            inside = w.row[: len(g)] == w.row[k - 1: k - 1 + len(g)] if len(g) else np.zeros(0, bool)
            p = np.flatnonzero(inside & index.quick[(g & np.uint64(0xFFFF)).astype(np.int64)])
            first, last = np.searchsorted(index.hash, g[p], "left"), np.searchsorted(index.hash, g[p], "right")
            count = last - first
            e = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            p = np.repeat(p, count)
            found.append(np.stack([w.row[p], index.template[e], p - index.place[e]]))
        hit = np.unique(np.concatenate(found, axis=1), axis=1)
        lead = None
        for t in np.unique(hit[1]):
            m = len(index.words[t])
            row, d = hit[0][hit[1] == t], hit[2][hit[1] == t]
            b = band(m)
            # Hits near the first one of a candidate are that candidate; near each other is not enough, a chain would leave the band.
            key = row * (1 << 40) + d
            picks, i = [], 0
            while i < len(d):
                picks.append(i)
                i = int(np.searchsorted(key, key[i] + b // 2, "right"))
            row, d = row[picks], d[picks]
            # Only words of the template that stand in the band can match: too few of them, and there is no match.
            lo, hi = np.maximum(w.at[row], d - b), np.minimum(w.at[row + 1], d + m + b)
            n = np.maximum(hi - lo, 0)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            own = index.own[t]
            same = own[np.minimum(np.searchsorted(own, h[place]), len(own) - 1)] == h[place]
            enough = 100 * np.bincount(np.repeat(np.arange(len(d)), n)[same], minlength=len(d)) >= percent * m
            row, d = row[enough], d[enough]
            if not len(d):
                continue
            n, s, e = align(index.words[t], h, w.at[row], w.at[row + 1], d)
            for i in np.flatnonzero(100 * n >= percent * m):
                if lead is None:
                    lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                base = lead[at[row[i]]]
                out.append((a + int(row[i]), int(t), int(n[i]), int(lead[w.start[s[i]]] - base), int(lead[w.end[e[i]]] - base)))
    # Of overlapping matches of one template in a row, the one with more words stays, then the first.
    kept, last = [], {}
    for r in sorted(set(out), key=lambda x: (x[0], x[1], -x[2], x[3], x[4])):
        spans = last.setdefault(r[:2], [])
        if all(r[4] <= s or r[3] >= e for s, e in spans):
            spans.append((r[3], r[4]))
            kept.append(r)
    # A match inside the span of one with more words is a part of that.
    rows: dict[int, list] = {}
    for r in kept:
        rows.setdefault(r[0], []).append(r)
    return [r for own in rows.values() for r in sorted(own, key=lambda x: (x[3], x[4], x[1])) if not any(o[2] > r[2] and o[3] <= r[3] and r[4] <= o[4] for o in own)]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, template, matched, words, coverage, start, end)`` of each
    place where a document holds ``percent`` % or more of a template's words in
    alignment; ``start`` and ``end`` are code points of the text. Whole texts
    are scanned. Null and empty texts have no match; repeated rows give repeated
    matches; templates without words match nothing; an empty table gives an
    empty one; other columns are ignored. The index holds the templates only."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches):
        x = index.value
        for b in batches:
            found = find(b.column("text"), x, percent)
            ids = b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            words = [len(x.words[f[1]]) for f in found]
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([x.names[f[1]] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64()), pa.array(words, pa.int64()),
                pa.array([round(f[2] / n, 6) for f, n in zip(found, words)], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                ["doc_id", "template", "matched", "words", "coverage", "start", "end"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, template string, matched long, words long, coverage double, start long, end long")
