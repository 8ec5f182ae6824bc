"""License scans by Patience alignment.

Words (letters and digits, lower case) of a text are aligned with those of each template: words that are unique in
both are anchors, the longest increasing subsequence of them is kept, and the gaps between are aligned
in the same way; equal words at the ends of a gap are matched first. Coverage is the share of a template's
words that are matched. The alignment looks at the text around anchor words, as far as the template can reach from them,
so a text that states a license twice has unique words in each place. Anchors are all places of the template's words that
are rarest in the text, so many of these words that coverage cannot be reached without one of them.

Defined results: null text is empty; a text without a license has license null, coverage 0 and n_found 0; of matches that
overlap the one with more matched words stays; each input row gives one output row; null ids stay null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import texts_of

COVERAGE = 0.8
#: Share of a match's span in the text that is matched, at least.
DENSITY = 0.6

# Wordings by which licenses are stated.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This {what} is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details."
)
_GPL = {"what": "program", "kind": "General Public"}
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TWO + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_TWO + _BSD_NAMES + _BSD_TAIL),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _GNU.format(v=2, **_GPL)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _GNU.format(v=3, **_GPL)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", _GNU.format(v="2.1", what="library", kind="Lesser General Public")),
    ("LGPL-3.0", _GNU.format(v=3, what="library", kind="Lesser General Public")),
    ("LGPL-3.0", _GNU.format(v=3, what="program", kind="Lesser General Public")),
    ("AGPL-3.0", _GNU.format(v=3, what="program", kind="Affero General Public")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for k, name in
      (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"))),
    *((k, f"SPDX-License-Identifier: {k}") for k in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0")),
)
_WORD = re.compile(r"[^\W_]+")


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        before.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of an alignment of two word lists."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        ca, cb = Counter(a[i:n]), Counter(b[j:m])
        where = {w: j + k for k, w in enumerate(b[j:m]) if cb[w] == 1 and ca.get(w) == 1}
        anchors = [(i + k, where[w]) for k, w in enumerate(a[i:n]) if w in where]
        anchors = [anchors[k] for k in longest_increasing([q for _, q in anchors])]
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (n, m)], strict=True):
            todo.append((p + 1, r, q + 1, s))
    return sorted(out)


def _spots(template: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, w in enumerate(template):
        out.setdefault(w, []).append(k)
    return out


_SPLIT = [(name, t, _spots(t)) for name, t in ((name, [w.lower() for w in _WORD.findall(text)]) for name, text in TEMPLATES)]


def matches(text: str) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, first word, end word, matched words) of what a text states, in order, without overlaps."""
    words = _WORD.findall(text.lower())
    known = set(words)
    at: dict[str, list[int]] | None = None
    found: dict[tuple[str, int, int], tuple[float, int]] = {}
    for name, template, spots in _SPLIT:
        if sum(w in known for w in template) < COVERAGE * len(template):
            continue
        at = at or _spots(words)
        # the words that are rarest in the text, so many that a match has one of them: the others fall short of COVERAGE
        anchors: list[tuple[int, str]] = []
        left = len(template)
        for w in sorted(spots, key=lambda w: (len(at.get(w, ())), len(spots[w]), w)):
            if left < COVERAGE * len(template):
                break
            anchors += ((k, w) for k in at.get(w, ()))
            left -= len(spots[w])
        # no match spans more of the text than this
        reach = int(len(template) / DENSITY) + 1
        done = -1
        for c, w in sorted(anchors):
            if c < done:  # inside what the last alignment matched
                continue
            lo, hi = max(0, c - reach), min(len(words), c + reach)
            if sum(x in spots for x in words[lo:hi]) < COVERAGE * len(template):
                continue
            pairs = patience(words[lo:hi], template)
            # outlying words that stand far from the rest are no part of the statement
            while pairs and len(pairs) < DENSITY * (pairs[-1][0] - pairs[0][0] + 1):
                pairs = pairs[1:] if len(pairs) > 1 and pairs[1][0] - pairs[0][0] > pairs[-1][0] - pairs[-2][0] else pairs[:-1]
            if len(pairs) >= COVERAGE * len(template):
                span = (lo + pairs[0][0], lo + pairs[-1][0] + 1)
                found[(name, *span)] = max(found.get((name, *span), (0.0, 0)), (len(pairs) / len(template), len(pairs)))
                done = span[1]
    out: list[tuple[int, int, str, float, int]] = []  # by place, without overlaps
    for (name, s, e), (coverage, n) in sorted(found.items(), key=lambda x: (-x[1][1] * x[1][0], -x[1][0], x[0])):
        k = bisect_left(out, (s,))
        if (k == 0 or out[k - 1][1] <= s) and (k == len(out) or out[k][0] >= e):
            out.insert(k, (s, e, name, coverage, n))
    return [(name, coverage, s, e, n) for s, e, name, coverage, n in out]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in texts_of(batch.column("text")).to_pylist():
            found = matches(text)
            best = max(found, key=lambda m: (m[4], m[1], -m[2]), default=(None, 0.0, None, None, 0))
            rows.append((*best[:4], len(found), "; ".join(sorted({m[0] for m in found}))))
        kinds = {"license": pa.string(), "coverage": pa.float64(), "start_word": pa.int64(), "end_word": pa.int64(), "n_found": pa.int64(), "licenses": pa.string()}
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True))], ["doc_id", *kinds])


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, license, coverage, start_word, end_word, n_found, licenses)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scanned, "doc_id long, license string, coverage double, start_word long, end_word long, n_found long, licenses string")
