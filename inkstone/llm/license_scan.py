"""Licence scans: normalised text against licence templates, by the Dice coefficient over word bigrams.

Texts and templates are lower-cased (A-Z) and cut into words of letters and digits. Compared are the whole text, each
of its paragraphs, lines and sentences, and all windows of its words wherever they begin and end, as sets of word
bigrams. Two sets of sizes a and b can reach a Dice coefficient t only if a is between b * t / (2 - t) and
b * (2 - t) / t, and share at least b * t / (2 - t) bigrams. So a text is searched only for templates of which it holds
as many bigrams; a unit meets only templates of such sizes that share a bigram with it. Templates are a bounded
parameter, sent with the function.

The best windows of a template begin and end with a bigram of it that they hold once, so no others are looked at: for
each such begin, up to where the bigram comes again or the window holds too many bigrams. Of windows that overlap, the
better one stays, unless they are of different licences and most bigrams found are not in the other's template.

More than MAX_TEMPLATES templates are refused. Defined results: null and empty texts, and units of fewer than two words,
match nothing. The best match is that with
the highest coefficient, then the larger template, then the first name, then a unit rather than a window. A window is
counted in n_matches unless it overlaps a unit that matches the same licence. Rows that repeat are reported each; extra
columns are ignored. A very long text is searched whole, as one row of a batch. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM_TABLE, blobs, map_batches

THRESHOLD = 0.8
MAX_TEMPLATES = 10_000

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_LIABILITY = (
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
    "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions:"
)
_ZLIB_RULES = (
    " 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If "
    "you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means."
)
_UNLICENSE_REST = (
    " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
    "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity "
    "of all present and future rights to this software under copyright law. "
)
#: (licence, kind, text): notices, and licences of up to a page whole, in their public wording.
TEMPLATES = [
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive", _MIT + _WARRANTY),
    ("MIT", "permissive", _MIT + _WARRANTY + _LIABILITY),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "permissive", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "permissive", _BSD),
    ("BSD-2-Clause", "permissive", _BSD + _BSD_WARRANTY),
    ("BSD-3-Clause", "permissive", _BSD + _BSD_THIRD + _BSD_WARRANTY),
    ("ISC", "permissive", _ISC + _ISC_NOTICE),
    ("ISC", "permissive", _ISC + _ISC_NOTICE + _ISC_WARRANTY),
    ("0BSD", "permissive", _ISC + "." + _ISC_WARRANTY),
    ("Zlib", "permissive", _ZLIB),
    ("Zlib", "permissive", _ZLIB + _ZLIB_RULES),
    ("Unlicense", "public-domain", _UNLICENSE),
    ("Unlicense", "public-domain", _UNLICENSE + _UNLICENSE_REST + _WARRANTY + _LIABILITY),
    ("CC0-1.0", "public-domain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "copyleft", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "non-commercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "non-commercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "no-derivatives", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "proprietary", "All rights reserved."),
]

Bigrams = frozenset[tuple[bytes, bytes]]


def bigrams(text: bytes) -> Bigrams:
    words = text.translate(ALNUM_TABLE).split()
    return frozenset(zip(words, words[1:], strict=False))


def dice(a: Bigrams, b: Bigrams) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass(frozen=True)
class Template:
    name: str
    kind: str
    grams: Bigrams


class Index:
    """Templates by bigram; and for each size of a unit, the sizes that can reach the threshold."""

    def __init__(self, templates: Iterable[tuple[str, str, str]], threshold: float):
        self.threshold = threshold
        self.templates = [Template(n, k, bigrams(t.encode())) for n, k, t in templates]
        if len(self.templates) > MAX_TEMPLATES:
            raise ValueError(f"{len(self.templates)} templates; at most {MAX_TEMPLATES} can be sent to every task")
        self.by_gram: dict[tuple, list[int]] = {}
        for k, t in enumerate(self.templates):
            for g in t.grams:
                self.by_gram.setdefault(g, []).append(k)
        ratio = threshold / (2 - threshold)
        sizes = [len(t.grams) for t in self.templates if t.grams]
        self.least, self.most = (min(sizes) * ratio, max(sizes) / ratio) if sizes else (1, 0)
        self.ratio = ratio
        # every match holds a word that starts a bigram of a template
        self.words = {g[0] for g in self.by_gram}

    def held(self, words: list[bytes]) -> list[int]:
        """The templates of which the words hold enough bigrams for a match of any part of them."""
        by_gram, first = self.by_gram, self.words
        grams = {g for k, w in enumerate(words[:-1]) if w in first and (g := (w, words[k + 1])) in by_gram}
        shared: dict[int, int] = {}
        for g in grams:
            for k in by_gram[g]:
                shared[k] = shared.get(k, 0) + 1
        # dice as it is computed below for the best set with these bigrams, the set of them alone
        return sorted(k for k, both in shared.items() if 2 * both / (both + len(self.templates[k].grams)) >= self.threshold)

    def best(self, grams: Bigrams) -> tuple[float, int, str, str] | None:
        n = len(grams)
        if not self.least <= n <= self.most or grams.isdisjoint(self.by_gram):
            return None
        shared: dict[int, int] = {}
        for g in grams & self.by_gram.keys():
            for k in self.by_gram[g]:
                shared[k] = shared.get(k, 0) + 1
        found = []
        for k, both in shared.items():
            t = self.templates[k]
            m = len(t.grams)
            if m * self.ratio <= n <= m / self.ratio and (d := 2 * both / (n + m)) >= self.threshold:
                found.append((-d, -m, t.name, t.kind))
        return min(found, default=None)


_SENTENCE = re.compile(rb"(?<=[.!?])\s+")
_WORD = re.compile(rb"[^ ]+")


def places(text: bytes) -> Iterator[tuple[str, int, int]]:
    """Where the units of a text begin and end."""
    yield "text", 0, len(text)
    at = 0
    for paragraph in (blocks := text.split(b"\n\n")):
        if len(blocks) > 1:
            yield "paragraph", at, at + len(paragraph)
        start = at
        for line in (lines := paragraph.split(b"\n")):
            if len(lines) > 1:
                yield "line", start, start + len(line)
            gaps = [m.span() for m in _SENTENCE.finditer(line)]
            if gaps:
                for (_, a), (z, _) in zip([(0, 0), *gaps], [*gaps, (len(line), 0)], strict=True):
                    yield "sentence", start + a, start + z
            start += len(line) + 1
        at += len(paragraph) + 2


def units(text: bytes) -> Iterable[tuple[str, bytes]]:
    """The whole text, its paragraphs, lines and sentences; a unit equal to a larger one is left out."""
    return ((unit, text[a:z]) for unit, a, z in places(text))


def search(grams: list, t: Template, threshold: float, lo: int, hi: int) -> list[tuple[float, int, int]]:
    """(-dice, start, stop) of windows of the bigrams lo to hi that match the template and don't overlap, the best first."""
    own, m, found = t.grams, len(t.grams), []
    ranges = [(lo, hi)]
    while ranges:
        lo, hi = ranges.pop()
        hits = [p for p in range(lo, hi) if grams[p] in own]
        most = len({grams[p] for p in hits})
        if not most or 2 * most / (most + m) < threshold:
            continue
        some, again = [], {}
        for a in reversed(hits):
            seen, both, best = set(), 0, None
            for p in range(a, again.get(grams[a], hi)):
                if (g := grams[p]) in seen:
                    continue
                seen.add(g)
                if g in own:
                    both += 1
                    d = 2 * both / (len(seen) + m)
                    if d >= threshold and (best is None or -d < best[0]):
                        best = (-d, a, p + 1)
                elif 2 * most / (len(seen) - both + most + m) < threshold:
                    break
            again[grams[a]] = a
            if best:
                some.append(best)
        taken: list[tuple[int, int]] = []
        used = bytearray(hi - lo)
        for d, a, z in sorted(some):
            if not any(used[a - lo : z - lo]):
                used[a - lo : z - lo] = b"\1" * (z - a)
                taken.append((a, z))
                found.append((d, a, z))
        if taken:  # what lies between may hold shorter ones
            taken.sort()
            ranges += [(x, y) for x, y in zip([lo, *(z for _, z in taken)], [*(a for a, _ in taken), hi], strict=True) if x < y]
    return sorted(found)


def windows(words: list[bytes], held: list[int], index: Index) -> list[tuple[float, int, str, str, int, int]]:
    """-dice, -size, licence, kind, and first and last word of the windows that match, the best first."""
    grams = list(zip(words, words[1:], strict=False))
    found = []
    for k in held:
        t = index.templates[k]
        found += [(d, -len(t.grams), t.name, t.kind, a, z, k) for d, a, z in search(grams, t, index.threshold, 0, len(grams))]
    out, owners = [], {}
    for *row, a, z, k in sorted(found):
        own = index.templates[k].grams & set(grams[a:z])
        better = {x for p in range(a, z) for x in owners.get(p, ())}
        if any(index.templates[x].name == row[2] or 2 * len(own & index.templates[x].grams) >= len(own) for x in better):
            continue
        for p in range(a, z):
            owners.setdefault(p, []).append(k)
        out.append((*row, a, z))
    return out


OUT = "doc_id long, license string, kind string, dice double, unit string, n_matches long, licenses array<string>"


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, kind, dice and unit of the best match (null and 0 without one), n_matches (units that match, and
    windows apart from them), licenses (names found, sorted) for each row."""
    index = Index(templates, threshold)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("license", "kind", "dice", "unit", "n_matches", "licenses")}
        for text in blobs(batch.column(1)):
            best, names, n = None, set(), 0
            words = text.translate(ALNUM_TABLE).split() if text else []
            if held := index.held(words):
                starts = [m.start() for m in _WORD.finditer(text.translate(ALNUM_TABLE))]
                covered: dict[str, bytearray] = {}
                for unit, a, z in places(text):
                    if found := index.best(bigrams(text[a:z])):
                        n += 1
                        names.add(found[2])
                        best = min(best or (*found, unit), (*found, unit))
                        a, z = bisect_left(starts, a), bisect_left(starts, z) - 1
                        covered.setdefault(found[2], bytearray(len(words)))[a:z] = b"\1" * (z - a)
                for *found, a, z in windows(words, held, index):
                    n += not any(covered.get(found[2], b"")[a:z])
                    names.add(found[2])
                    best = min(best or (*found, "window"), (*found, "window"))
            row = (best[2], best[3], -best[0], best[4]) if best else (None, None, 0.0, None)
            for k, v in zip(out, (*row, n, sorted(names)), strict=True):
                out[k].append(v)
        return out | {"doc_id": batch.column(0)}

    return map_batches(docs.select("doc_id", "text"), run, OUT)
