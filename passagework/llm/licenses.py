"""License scan: patience alignment of texts with license templates.

Text and template are words (ASCII lower case, letters, digits, dots and hyphens
within). Words that occur once in both are anchors; the longest increasing
subsequence of them is kept, common beginnings and ends are peeled off, and the
gaps between anchors are aligned in the same way. Coverage is the share of the
template's words that are matched; at ``LEAST`` a finding is reported.

Two exact filters come before. In one pass over a batch, a text must contain one of the
templates' rarest words: coverage c of n words leaves at most m = n - ceil(cn)
unmatched, so of any m + 1 words one is matched. In the worker, each occurrence of
such a word sets a window in which the template would lie, so that a license
that occurs twice, or in a very long text, is found at each place. Of findings of
one license that overlap the best stays (ties: the first).

Cases: null and empty texts have no findings; rows are treated one by one, so
repeated rows give repeated findings; other columns are not read, whatever their names.
A text may have several licenses in one place, as the longer hold the shorter.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LEAST = 0.8
WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."

#: By the ids of the SPDX list; whole texts, and (with what is behind "/") the shorter ones by which they are often named.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "MIT/line": "Released under the MIT License.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": _MIT + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT/permission": _MIT,
    "ISC": _ISC + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC/permission": _ISC,
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_END,
    "BSD-2-Clause/conditions": _BSD,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of ``a`` and ``b``, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        left, right = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if right[w] == 1}
        pairs = [(p, place[w]) for p, w in enumerate(a[i:j], i) if left[w] == 1 and w in place]
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(pairs)
        for n, (_, q) in enumerate(pairs):
            x = bisect_left(tails, q)
            back[n] = ends[x - 1] if x else -1
            tails[x : x + 1], ends[x : x + 1] = [q], [n]
        chain, n = [], ends[-1] if ends else -1
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        if not chain:
            continue
        out.extend(chain)
        bounds = [(i - 1, k - 1), *reversed(chain), (j, m)]
        todo.extend((p + 1, r, q + 1, s) for (p, q), (r, s) in zip(bounds, bounds[1:], strict=False))
    return sorted(out)


def rare_words(words: list[str], least: float = LEAST) -> set[str]:
    """Words of which a text must have one to cover ``least`` of the template: long ones, few occurrences."""
    miss = len(words) - math.ceil(least * len(words))
    out: set[str] = set()
    held = 0
    for word, n in sorted(Counter(words).items(), key=lambda x: (-len(x[0]), x[1], x[0])):
        if held > miss:
            break
        out.add(word)
        held += n
    return out


def scan_text(text: str, templates: dict[str, list[str]], rare: dict[str, set[str]], least: float = LEAST) -> list[tuple[str, float, int, int, int]]:
    """Findings (license, coverage, matched words, first and last word) of one text."""
    words = tokens(text)
    places: dict[str, list[int]] = {}
    for p, w in enumerate(words):
        places.setdefault(w, []).append(p)
    out = []
    for name, template in templates.items():
        n = len(template)
        slack, found, windows = n // 4 + 2, [], set()
        for offset, word in enumerate(template):
            if word in rare[name]:
                windows |= {(max(0, p - offset - slack), p - offset + n + slack) for p in places.get(word, ())}
        for lo, hi in sorted(windows):
            hits = align(words[lo:hi], template)
            if hits and len(hits) >= least * n:
                found.append((-len(hits), lo + hits[0][0], lo + hits[-1][0]))
        taken: list[tuple[int, int]] = []
        for minus, first, last in sorted(found):
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                out.append((name, -minus / n, -minus, first, last))
    return sorted(out, key=lambda x: (x[3], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, coverage, matched, first_word, last_word) for every finding."""
    words = {name: tokens(t) for name, t in templates.items() if tokens(t)}
    rare = {name: rare_words(w, least) for name, w in words.items()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    needed = "|".join(sorted(set().union(*rare.values()))).replace(".", "[.]") if rare else "$."
    # case folded by the matcher, which is wider than lower(): a filter may let more through

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.match_substring_regex(batch.column(1), needed, ignore_case=True))  # one pass for all words; null doesn't pass
            rows = [(doc, *f) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in scan_text(text, words, rare, least)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [batch.schema.field(0).type, pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "license", "coverage", "matched", "first_word", "last_word"])

    return texts.where("text is not null").mapInArrow(run, f"doc_id {kind}, license string, coverage double, matched int, first_word int, last_word int")
