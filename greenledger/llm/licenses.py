"""Licence notices found by the Dice coefficient over word bigrams.

A text is put in lower case and stripped of everything but letters and digits. Every run of its words is compared with
the templates: twice the shared bigrams (counted as often as they occur in both) over the bigrams of both. So a notice
is found on a line of its own, inside a sentence, or glued to code, and a text may hold several.

Size bounds prune the work without loss. A template of n bigrams can reach the threshold t only in runs of at least
n t / (2 - t) and at most n (2 - t) / t bigrams, and only if the run shares as many as the first bound; so of a text's
bigrams only those of a template are looked at, and a template is done where they never stand that close. Runs start
and end with shared bigrams, as leaving out others only raises the coefficient.

Each shared bigram and its template give the best run that starts there; of runs that overlap the one of largest weight (shared
bigrams times coefficient) stays, so that a whole header beats the short notice inside it.

Defined cases: a null, empty or one-word text has no licence; of runs of equal weight the higher coefficient, the earlier,
the shorter, then the first name in text order wins; repeated rows each get a row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

THRESHOLD = 0.8

# Public licence notices as they are commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "BSD-2-Clause conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution."
    ),
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Proprietary": "All rights reserved.",
}

_WORD = re.compile(r"[^\W_]+")
_SLACK = 1e-9


class Match(NamedTuple):
    """A run of words, the end exclusive, that is a licence notice; lesser ones are better."""

    weight: float  # negative
    dice: float  # negative
    start: int
    end: int
    license: str


class Template:
    """The bigrams of a notice and the sizes of runs that can be it."""

    def __init__(self, name: str, bigrams: Counter, threshold: float) -> None:
        self.name, self.bigrams, self.threshold = name, bigrams, threshold
        self.size = bigrams.total()
        ratio = threshold / (2 - threshold)
        self.least = max(1, math.ceil(self.size * ratio - _SLACK))
        self.most = int(self.size / ratio + _SLACK)

    def matches(self, places: list[int], pairs: list[tuple[str, str]]) -> Iterator[Match]:
        """The best run from each of ``places``, where a text has bigrams (``pairs``) of this template."""
        for i in range(len(places) - self.least + 1):
            start = places[i]
            if places[i + self.least - 1] - start >= self.most:
                continue
            shared, seen, best = 0, Counter(), None
            reach = slice(i, i + self.most)
            for place, pair in zip(places[reach], pairs[reach]):
                size = place - start + 1
                if size > self.most:
                    break
                seen[pair] += 1
                if seen[pair] > self.bigrams[pair]:
                    continue
                shared += 1
                dice = 2 * shared / (size + self.size)
                if dice >= self.threshold:
                    found = Match(-shared * dice, -dice, start, place + 2, self.name)
                    best = found if best is None or found < best else best
            if best:
                yield best


class Matcher:
    """Templates, and which of them hold a bigram."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.templates = []
        self.holders: dict[tuple[str, str], list[int]] = {}
        for name, text in templates.items():
            words = _WORD.findall(text.lower())
            if len(words) > 1:
                bigrams = Counter(zip(words, words[1:]))
                for pair in bigrams:
                    self.holders.setdefault(pair, []).append(len(self.templates))
                self.templates.append(Template(name, bigrams, threshold))

    def scan(self, text: str | None) -> list[Match]:
        """All licences of a whole text, in its order."""
        words = _WORD.findall((text or "").lower())
        places: list[list[int]] = [[] for _ in self.templates]
        pairs: list[list[tuple[str, str]]] = [[] for _ in self.templates]
        holders = self.holders.get
        for at, pair in enumerate(zip(words, words[1:])):
            for n in holders(pair, ()):
                places[n].append(at)
                pairs[n].append(pair)
        found = [m for t, p, b in zip(self.templates, places, pairs) if len(p) >= t.least for m in t.matches(p, b)]
        taken, chosen = set(), []
        for match in sorted(found):
            span = range(match.start, match.end)
            if taken.isdisjoint(span):
                taken.update(span)
                chosen.append(match)
        return sorted(chosen, key=lambda m: m.start)


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, ``license`` and ``dice`` of the weightiest notice of every row (null and 0 if none), and ``matches``: all
    notices in the order of the text, with the numbers of their words from 0, the end exclusive."""
    matcher = Matcher(templates, threshold)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [matcher.scan(t) for t in batch[text]]
            best = [min(f, default=None) for f in found]
            yield batch[list(keep)].assign(
                license=pd.Series([b and b.license for b in best], batch.index, object),
                dice=[-b.dice if b else 0.0 for b in best],
                matches=pd.Series([
                    [{"license": m.license, "dice": -m.dice, "start": m.start, "end": m.end} for m in f] for f in found
                ], batch.index, object),
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    schema += ", license string, dice double, matches array<struct<license:string,dice:double,start:int,end:int>>"
    return docs.select(*dict.fromkeys([*keep, text])).mapInPandas(scan, schema)
