"""License scan: normalised text against license templates by Dice coefficient over word bigrams.

Any run of words can be a license notice, within a line or over many. A run is compared with a template only if their
numbers of bigrams are near enough for the threshold: Dice >= t needs n * t / (2 - t) <= m <= n * (2 - t) / t; a template
whose bigrams a text holds too few of, whatever the run, is not looked for in it. The nearest run starts and ends
with a bigram of the template that stands nowhere else in the run, as without it the run is as near or nearer: other runs are not
looked at, and for each start all ends are measured at once.
"""

from __future__ import annotations

import heapq
import pkgutil
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.session import small_batches, table

# Notices by SPDX identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Whole texts: license_texts/<identifier>.txt.
TEXTS = ("0BSD", "Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "EPL-2.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib")
_GNU = (("GPL-1.0", "GNU General Public License", "1"), ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.0", "GNU Library General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"))
_NAMED = (("0BSD", "BSD Zero Clause"), ("Apache-2.0", "Apache 2.0"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("BSL-1.0", "Boost Software"), ("EPL-2.0", "Eclipse Public"), ("ISC", "ISC"), ("MIT", "MIT"), ("MPL-1.1", "Mozilla Public License 1.1"), ("MPL-2.0", "Mozilla Public License 2.0"), ("Zlib", "zlib"))
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_VERBS = ("Released under", "Licensed under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under", "This software is released under")


def _wordings() -> Iterator[tuple[str, str]]:
    """The usual notices of each license and version, near siblings among them."""
    for name, title, version in _GNU:
        yield name, f"This program is free software; you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
        for verb in _VERBS:
            yield name, f"{verb} the {title}, version {version}."
            yield name, f"{verb} the {title} v{version}."
    for name, title in _NAMED:
        for verb in _VERBS:
            yield name, f"{verb} the {title}" + (" License." if "License" not in title else ".")
    for verb in _VERBS:
        yield "Apache-2.0", f"{verb} the Apache License, Version 2.0."
    for kind, title in _CC:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            scope = {"3.0": " Unported", "4.0": " International"}.get(version, " Generic")
            for verb in _VERBS:
                yield f"CC-{kind}-{version}", f"{verb} CC {kind} {version}."
                yield f"CC-{kind}-{version}", f"{verb} a Creative Commons {title} {version}{scope} License."


TEMPLATES = (*NOTICES, *(x for x in _wordings() if x not in NOTICES), *((name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name in TEXTS))

_WORD = re.compile(r"[a-z0-9]+|[^\x00-\x7f]+")


def normalised(text: str) -> list[str]:
    """Words of text: A-Z lower-cased; punctuation and white space only part words."""
    return _WORD.findall(text.translate(_LOWER))


_LOWER = {c: c + 32 for c in range(65, 91)}


def bigrams(words: list[str]) -> set[tuple[str, ...]]:
    """Pairs of neighbouring words; the word itself where there is one alone."""
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {tuple(words)} - {()}


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class _Text:
    """A text's words, its bigrams by number, and for each place of a bigram the places of the same before and after."""

    def __init__(self, words: list[str]) -> None:
        self.words, self.numbers = words, {}
        n = max(0, len(words) - 1)
        self.code = np.fromiter((self.numbers.setdefault(p, len(self.numbers)) for p in zip(words, words[1:], strict=False)), np.int64, n)
        order = np.argsort(self.code, kind="stable")
        same = np.flatnonzero(np.diff(self.code[order]) == 0)
        self.before, self.after = np.full(n, -1), np.full(n, n)
        self.before[order[same + 1]] = order[same]
        self.after[order[same]] = order[same + 1]


class Matcher:
    """Templates indexed by their bigrams."""

    def __init__(self, templates=TEMPLATES, threshold: float = 0.85) -> None:
        self.threshold = threshold
        self.templates = [(name, bigrams(normalised(text))) for name, text in templates]
        self.templates = [(name, b) for name, b in self.templates if b]
        self.low = [threshold * len(b) / (2 - threshold) - 1e-9 for _, b in self.templates]
        self.high = [(2 - threshold) * len(b) / threshold + 1e-9 for _, b in self.templates]
        self.holders: dict[tuple[str, ...], list[int]] = {}
        for t, (_, b) in enumerate(self.templates):
            for pair in b:
                self.holders.setdefault(pair, []).append(t)
        self.alone = {p[0]: ts for p, ts in self.holders.items() if len(p) == 1}

    def _wanted(self, words: list[str]) -> list[int]:
        """Templates that some run of two words or more can reach: a run shares the least size of one at least with it."""
        shared = [0] * len(self.templates)
        for pair in self.holders.keys() & set(zip(words, words[1:], strict=False)):
            for t in self.holders[pair]:
                shared[t] += 1
        return [t for t, n in enumerate(shared) if n and n >= self.low[t]]

    def _end(self, text: _Text, hit: np.ndarray, t: int, start: int, stop: int) -> tuple[float, int]:
        """(dice, end) of the nearest run of bigrams from start that ends before stop, the shortest of equals."""
        stop, size = min(stop, int(text.after[start])), len(self.templates[t][1])
        best, m, s, a, width = (0.0, -1), 0, 0, start, 2 * size + 16
        while a < stop and m <= self.high[t]:
            b = min(stop, a + width)
            new = text.before[a:b] < start
            shared = new & hit[a:b]
            held, both = m + np.cumsum(new), s + np.cumsum(shared)
            near = np.where(shared & (held <= self.high[t]), 2 * both / (held + size), 0.0)
            j = int(np.argmax(near))
            if near[j] > best[0]:
                best = (float(near[j]), a + j)
            m, s, a, width = int(held[-1]), int(both[-1]), b, 2 * width
        return best

    def runs(self, words: list[str]) -> list[tuple[float, int, int, int]]:
        """(dice, template, first word, last word): the nearest run of all, then in the same way those in what is left before
        and after it. Of equally near ones the larger template, the shorter run, the earlier one, the earlier template."""
        queue: list[tuple] = [(-1.0, -1, 1, i, t, i) for i, w in enumerate(words) if w in self.alone for t in self.alone[w]] if self.alone else []
        hits: dict[int, np.ndarray] = {}
        if wanted := self._wanted(words):
            text = _Text(words)
            member = {t: np.zeros(len(text.numbers), bool) for t in wanted}
            for pair in text.numbers.keys() & self.holders.keys():
                for t in self.holders[pair]:
                    if t in member:
                        member[t][text.numbers[pair]] = True

            def ask(t: int, i: int, stop: int) -> None:
                d, j = self._end(text, hits[t], t, i, stop)
                if d >= self.threshold:
                    heapq.heappush(queue, (-d, -len(self.templates[t][1]), j - i + 2, i, t, j + 1))

            for t in wanted:
                hits[t] = member[t][text.code]
                upto = np.concatenate(([0], np.cumsum(hits[t])))
                starts = np.flatnonzero(hits[t])
                for i in starts[upto[text.after[starts]] - upto[starts] >= self.low[t]].tolist():
                    ask(t, i, len(text.code))
        heapq.heapify(queue)
        taken: list[tuple[int, int]] = []
        found = []
        while queue:
            d, _, length, i, t, last = heapq.heappop(queue)
            at = bisect_right(taken, (i, len(words)))
            if at and taken[at - 1][1] >= i:
                continue
            free = taken[at][0] if at < len(taken) else len(words)
            if last >= free:
                if length > 1 and free - i > 1:
                    ask(t, i, free - 1)
                continue
            insort(taken, (i, last))
            found.append((-d, t, i, last))
        return found

    def best(self, text: str) -> list[tuple[str, float, int, int, int, int]]:
        """(license, dice, first line, last line, first word, last word) of the runs, in order."""
        found = sorted(self.runs(normalised(text)), key=lambda r: r[2])
        if not found:
            return []
        upto = np.cumsum([len(normalised(line)) for line in text.split("\n")])
        line = lambda word: int(np.searchsorted(upto, word, "right"))
        return [(self.templates[t][0], d, line(a), line(b), a, b) for d, t, a, b in found]


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = 0.85) -> DataFrame:
    """One row for each input row: (doc_id, license, dice, n_found, found); license and dice of the nearest match, the first of
    equals; found lists (license, dice, first, last, first_word, last_word) in order, with line and word numbers from 0. Runs don't
    overlap: the nearest is found, then likewise in what is before and after it; of equally near ones the larger
    template's, the shorter, the earlier.

    Null and empty texts, and texts without a match, have a null license and nothing found. Rows are independent:
    repeated rows give repeated rows, no rows give none. Further columns are ignored.
    """
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(templates, threshold))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher.value
        places = ("first", "last", "first_word", "last_word")
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), *((p, pa.int32()) for p in places)]))
        for batch in batches:
            names, scores, found = [], [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                rows = m.best(text) if text else []
                top = max(rows, key=lambda r: r[1], default=(None, None))
                names.append(top[0])
                scores.append(top[1])
                found.append([dict(zip(("license", "dice", *places), r, strict=True)) for r in rows])
            n = pa.array([len(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), n, pa.array(found, kind)], ["doc_id", "license", "dice", "n_found", "found"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"doc_id {id_kind}, license string, dice double, n_found long, found array<struct<license:string,dice:double,first:int,last:int,first_word:int,last_word:int>>"
    )


def op10_license_scan(spark, sf_dir):
    """All documents against the built-in templates."""
    return scan_licenses(table(small_batches(spark), sf_dir, "documents"))
