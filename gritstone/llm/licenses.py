"""License scan by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import slices

# Public license texts and notices. Where two differ in a few words, both are here.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_ADVERT = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_APACHE_OLD = 'The end-user documentation included with the redistribution, if any, must include the following acknowledgment: "This product includes software developed by the Apache Software Foundation (http://www.apache.org/)." Alternately, this acknowledgment may appear in the software itself, if and wherever such third-party acknowledgments normally appear. The names "Apache" and "Apache Software Foundation" must not be used to endorse or promote products derived from this software without prior written permission. Products derived from this software may not be called "Apache", nor may "Apache" appear in their name, without prior written permission of the Apache Software Foundation.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. {0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/{0}/."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."
_GNU_MAY = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{either} version {version} of the License, or (at your option) any later version."
_GNU_ONLY = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by the Free Software Foundation."
_GNU_NAMES = (
    ("GPL", "General Public License", "program", ("2", "3")),
    ("LGPL", "Lesser General Public License", "library", ("2.1", "3")),
    ("AGPL", "Affero General Public License", "program", ("3",)),
)
_CC_NAMES = (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
_SHORT = "Released under the {} License."


@dataclass(frozen=True)
class Template:
    """A license's text. Each of `must` (a word, or words that stand for each other with | between) has to be aligned,
    and none of `never` may stand between aligned words."""

    name: str
    text: str
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


def _gnu() -> list[Template]:
    out = []
    for short, name, what, versions in _GNU_NAMES:
        for v in versions:
            full, own = (v if "." in v else f"{v}.0"), {"GPL": ("general",), "LGPL": ("lesser",), "AGPL": ("affero",)}[short]
            later = _GNU_MAY.format(what=what, colon=":" if v == "3" else ";", name=name, either=", either" if v == "3" else ";  either", version=v)
            never = tuple(w for w in ("lesser", "affero") if w not in own)
            out.append(Template(f"{short}-{full}-or-later", later, (*own, f"{v}|{full}", "later"), never))
            out.append(Template(f"{short}-{full}-only", _GNU_ONLY.format(what=what, colon=":" if v == "3" else ";", name=name, version=v), (*own, f"{v}|{full}"), (*never, "later")))
            out.append(Template(f"{short}-{full}-short", f"This work is licensed under the GNU {name}, version {v}.", (*own, f"{v}|{full}", "gnu"), never))
    return out


def _creative_commons() -> list[Template]:
    out = []
    for short, name in _CC_NAMES:
        word = f"{short}|cc-{short}".lower()
        for v in ("3.0", "4.0"):
            kind = "International" if v == "4.0" else "Unported"
            out.append(Template(f"CC-{short}-{v}", f"This work is licensed under the Creative Commons {name} {v} {kind} License.", (name.lower(), v, "commons")))
            out.append(Template(f"CC-{short}-{v}-short", f"Licensed under CC {short} {v}.", (word, v, "cc")))
    return out


TEMPLATES = (
    Template("Apache-2.0-short", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    Template("Apache-2.0", _APACHE, ("apache", "2.0")),
    Template("Apache-1.1", f"{_BSD_GRANT} {_BSD_ONE} {_BSD_TWO} {_APACHE_OLD}", ("apache", "endorse", "called")),
    Template("MIT-short", _SHORT.format("MIT"), ("mit",)),
    Template("MIT", f"{_MIT_GRANT} {_MIT_WARRANTY}", ("sublicense", "sell", "noninfringement")),
    Template("MIT-grant", _MIT_GRANT, ("sublicense", "sell")),
    *_gnu(),
    *_creative_commons(),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.", ("waived", "cc0")),
    Template("BSD-short", _SHORT.format("BSD"), ("bsd",)),
    Template("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_ONE} {_BSD_TWO} {_BSD_WARRANTY}", ("reproduce", "disclaimed"), ("endorse", "neither")),
    Template("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_ONE} {_BSD_TWO} {_BSD_NAME} {_BSD_WARRANTY}", ("reproduce", "endorse", "neither", "disclaimed"), ("advertising", "apache")),
    Template("BSD-4-Clause", f"{_BSD_GRANT} {_BSD_ONE} {_BSD_TWO} {_BSD_ADVERT} {_BSD_NAME} {_BSD_WARRANTY}", ("reproduce", "endorse", "neither", "advertising", "disclaimed")),
    Template("ISC-short", _SHORT.format("ISC"), ("isc",)),
    Template("ISC", f"{_ISC_GRANT} {_ISC_WARRANTY}", ("fee", "disclaims")),
    Template("ISC-grant", _ISC_GRANT, ("fee", "granted")),
    Template("0BSD", _ISC_GRANT.split(", provided")[0] + ". " + _ISC_WARRANTY, ("fee", "disclaims")),
    Template("Unlicense", _UNLICENSE, ("unencumbered", "domain")),
    Template("MPL-2.0", _MPL.format("2.0"), ("mozilla", "2.0")),
    Template("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/", ("mozilla", "1.1")),
    Template("Zlib", _ZLIB, ("misrepresented", "altered")),
    Template("BSL-1.0", _BOOST, ("organization", "transmit")),
)

_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


def license_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def patience(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Places (i, j) of words that an alignment of a with b matches, ascending in both.

    Equal words at both ends match. Between them, words that stand once in a and once in b are anchors: the longest
    increasing subsequence of their places in b stays, and the gaps between those are aligned the same way.
    """
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
        if a0 == a1 or b0 == b1:
            continue
        in_b = _once(b, b0, b1)
        in_a = _once(a, a0, a1)
        anchors = sorted((i, in_b[w]) for w, i in in_a.items() if w in in_b)
        chain = _increasing(anchors)
        if not chain:
            continue
        out.extend(chain)
        ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False) if k - i > 1 and m - j > 1]
    return sorted(out)


def _once(words: Sequence[str], start: int, end: int) -> dict[str, int]:
    found: dict[str, int] = {}
    for i in range(start, end):
        found[words[i]] = -1 if words[i] in found else i
    return {w: i for w, i in found.items() if i >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ascending in the first, that ascends in the second too."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(last[at - 1] if at else -1)
        tops[at : at + 1], last[at : at + 1] = [j], [n]
    out = []
    n = last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


@dataclass(frozen=True)
class Found:
    """Words [start, end) of the text, of which `matched` align with the template."""

    name: str
    coverage: float
    start: int
    end: int
    matched: int


class Scanner:
    """Looks for templates in whole texts: places that share enough words are aligned."""

    def __init__(self, templates: Sequence[Template | tuple[str, str]] = TEMPLATES, coverage: float = 0.8):
        self.coverage = coverage
        known = [t if isinstance(t, Template) else Template(*t) for t in templates]
        self.templates = [(t.name, license_words(t.text)) for t in known]
        #: For each template, for each thing that must be aligned, its places and the words that may stand there.
        self.must: list[list[tuple[list[int], frozenset[str]]]] = []
        self.never: list[frozenset[str]] = []
        for t, (name, words) in zip(known, self.templates, strict=True):
            wanted = [frozenset(w for x in m.lower().split("|") for w in license_words(x)) for m in t.must]
            self.must.append([([i for i, w in enumerate(words) if w in m], m) for m in wanted])
            self.never.append(frozenset(t.never))
            if any(not places for places, _ in self.must[-1]):
                raise ValueError(f"{name}: a word that must be aligned is not in the text")
        counts = Counter(w for _, words in self.templates for w in set(words))
        #: To hold `coverage` of a template a text holds one of any len - ceil(coverage * len) + 1 of its words.
        self.rare: dict[str, list[int]] = {}
        for n, (_, words) in enumerate(self.templates):
            need = -int(-coverage * len(words) // 1)
            order = sorted(range(len(words)), key=lambda i: (counts[words[i]], -len(words[i]), i))
            for w in {words[i] for i in order[: len(words) - need + 1]}:
                self.rare.setdefault(w, []).append(n)

    def scan(self, text: str) -> list[Found]:
        """The licenses of a text, in order. Of finds that overlap the one with the most words aligned stays."""
        words = license_words(text)
        here = set(words)
        wanted = {n for w in self.rare.keys() & here for n in self.rare[w]}
        out: list[Found] = []
        for n in sorted(wanted):
            name, template = self.templates[n]
            if any(m.isdisjoint(here) for _, m in self.must[n]):
                continue
            own = Counter(template)
            if sum(c for w, c in own.items() if w in here) >= self.coverage * len(template):
                out += [found for at in self._regions(words, own, len(template)) for found in self._copies(n, name, template, words, *at)]
        return self._apart(out)

    @staticmethod
    def _apart(found: list[Found]) -> list[Found]:
        best: list[Found] = []
        for f in sorted(found, key=lambda f: (-f.matched, -f.coverage, f.start, f.end, f.name)):
            if all(f.end <= g.start or g.end <= f.start for g in best):
                best.append(f)
        return sorted(best, key=lambda f: (f.start, f.name))

    def _holds(self, n: int, words: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether all that must be aligned is: at one of its places, or by a word that may stand beside its neighbours there."""
        at = {j: i for i, j in pairs}
        aligned = set(at.values())
        if self.never[n] and any(words[i] in self.never[n] and i not in aligned for i in range(pairs[0][0], pairs[-1][0])):
            return False
        last = len(self.templates[n][1]) - 1
        for places, may in self.must[n]:
            if any(j in at for j in places):
                continue
            beside = []
            for j in places:
                before, after = at.get(j - 1), at.get(j + 1)
                if before is not None and (after is not None or j == last):
                    beside += words[before + 1 : after if after is not None else before + 2]
                elif after is not None and j == 0:
                    beside += words[max(after - 1, 0) : after]
            if not any(w in may for w in beside):
                return False
        return True

    def _copies(self, n: int, name: str, template: list[str], words: list[str], a: int, b: int) -> list[Found]:
        """Every copy in [a, b): the best of those that begin in the next two lengths, then those before and after its span."""
        size, least = len(template), -int(-self.coverage * len(template) // 1)
        todo, out = [(a, b)], []
        while todo:
            a, b = todo.pop()
            while b - a >= max(least, 1):
                found = self._align(n, name, template, words, a, min(b, a + 2 * size), b)
                if not found:
                    a += size
                    continue
                if found.end - found.start > size:  # it may have begun in the copy before
                    found = self._align(n, name, template, words, found.start, found.end, found.end) or found
                while found.end - found.start >= 2 * least and (one := self._align(n, name, template, words, found.start, found.start + 1, found.end - least)):
                    found = one  # the head of a copy had been aligned with the tail of the next
                out.append(found)
                todo.append((a, found.start))
                a = found.end
        return out

    def _regions(self, words: list[str], own: Counter, size: int) -> list[tuple[int, int]]:
        """Stretches of the text in which the template's words are dense.

        In a window of the template's length, at least half of `coverage` of the template must be there, counted
        with multiplicity; windows that overlap are one stretch.
        """
        inside: Counter = Counter()
        have, spans = 0, []
        need = self.coverage * size / 2
        for i, w in enumerate(words):
            if w in own:
                inside[w] += 1
                have += inside[w] <= own[w]
            if i >= size and (gone := words[i - size]) in own:
                have -= inside[gone] <= own[gone]
                inside[gone] -= 1
            if have >= need:
                a = max(0, i - size + 1)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = i + 1
                else:
                    spans.append([a, i + 1])
        return [(a, b) for a, b in spans]

    def _align(self, n: int, name: str, template: list[str], words: list[str], a: int, last: int, b: int) -> Found | None:
        """The best alignment in [a, b) from a, or from any place before `last` that has the template's first word.

        One or two lengths of the text are aligned: one so that a copy that follows is not in the way.
        """
        best = None
        size = len(template)
        for i in [a, *(i for i in range(a + 1, last) if words[i] == template[0])]:
            for end in sorted({min(b, i + size), min(b, i + 2 * size)}):
                pairs = patience(words[i:end], template)
                if pairs and self._holds(n, words[i:end], pairs):
                    found = Found(name, len(pairs) / size, i + pairs[0][0], i + pairs[-1][0] + 1, len(pairs))
                    if best is None or (found.matched, found.start - found.end) > (best.matched, best.start - best.end):
                        best = found
                    if found.matched == size:
                        break
        return best if best and best.coverage >= self.coverage else None


def _scanner(templates: Sequence[Template | tuple[str, str]], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64())]))
        for batch in slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                found.append([{"license": f.name, "coverage": f.coverage, "start": f.start, "end": f.end, "matched": f.matched} for f in scanner.scan(text or "")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "licenses"])

    return run


def scan_licenses(docs: DataFrame, templates: Sequence[Template | tuple[str, str]] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id and licenses, an array of license, coverage, start, end and matched.

    start and end count the text's words (runs of letters and digits, joined by . + or -), lower-cased. A license
    is found where an alignment matches `coverage` of its template's words, among them those that tell it from its siblings
    (version, `lesser`, `sharealike`, the third clause); of finds that overlap the one with the most words stays, so a notice is
    never reported under a sibling's name as well. A notice that is repeated is found each time. Whole texts are read; null and empty texts have no license; repeated rows are alike; other columns
    are not read; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(_scanner(templates, coverage), f"doc_id {kind}, licenses array<struct<license string, coverage double, start long, end long, matched long>>")
