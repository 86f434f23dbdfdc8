"""Licence scan: windows of whole texts against licence templates by the Dice coefficient of word bigrams.

A text is normalised (A-Z in lower case, everything but ASCII letters and digits
a blank) into one sequence of words, over line ends and punctuation, so wrapped
and embedded notices are found.  A window of it has a set of ``a`` bigrams, a
template one of ``b``; with ``s`` shared their coefficient is ``2 s / (a + b)``.
Sizes prune before anything is compared: a threshold ``t`` needs
``s >= b t / (2 - t)`` shared bigrams, and no window of more than
``b (2 - t) / t`` bigrams is looked at, so a template is a candidate only where
that many of its bigrams lie that close together.  Few texts have any candidate;
the windows of those are scored exactly, from every shared bigram on.

Scanning is one narrow stage: a batch of texts becomes one array of word numbers
(words of no template are zero), and candidates come from that array.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import count, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.llm.common import by_slice

# Names by which texts refer to licences, with their SPDX identifiers.
NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache 2.0 License"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("ISC", "ISC License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
)
# How a text points at a licence.
PHRASES = ("under the {}", "under a {}", "under {}", "terms of the {}")
# Identifiers of the SPDX list whose tags are looked for.
TAGS = (
    ("MIT", "MIT"), ("ISC", "ISC"), ("Apache-2.0", "Apache-2.0"),
    ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"),
    ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"),
    ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"),
    ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"),
    ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"),
    ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"),
    ("EPL-2.0", "EPL-2.0"), ("BSL-1.0", "BSL-1.0"), ("CC0-1.0", "CC0-1.0"), ("Unlicense", "Unlicense"),
    ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
)
# The public licences' own headers and conditions, from their published texts.
BODIES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                 "(at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                 "(at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: 1. Redistributions of source code must retain the above "
                     "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
                     "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                     "in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: 1. Redistributions of source code must retain the above "
                     "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
                     "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                     "in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
                     "copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                     "from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
)
TEMPLATES = (*((licence, phrase.format(name)) for licence, name in NAMES for phrase in PHRASES),
             *((licence, f"SPDX-License-Identifier: {tag}") for licence, tag in TAGS), *BODIES)
THRESHOLD = 0.8
#: Templates of fewer bigrams must be met whole: a part of them names no licence.
SHORT = 5
#: Windows scored side by side, and bytes of text cut into words at a time.
STEP, CUT = 1 << 16, 1 << 20
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    return (text or "").encode().translate(KEPT).decode().split()


def template_bigrams(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def sizes(bigrams: int, threshold: float) -> tuple[int, int]:
    """The fewest bigrams that a window shares with a template, and the most that it has."""
    fewest = bigrams if bigrams < SHORT else math.ceil(bigrams * threshold / (2 - threshold) - 1e-9)
    return fewest, math.floor(bigrams * (2 - threshold) / threshold + 1e-9)


class Notice(NamedTuple):
    """Words ``first`` to ``last`` of a text (from 0) that state a licence, and the best coefficient among them."""

    licence: str
    first: int
    last: int
    score: float


class Templates:
    """Templates by numbers: words from 1, bigrams as cells of a table, forms that hold a bigram side by side."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float):
        self.threshold = threshold
        grams = [(licence, template_bigrams(text)) for licence, text in templates]
        grams = [(licence, g) for licence, g in grams if g]
        self.licences = [licence for licence, _ in grams]
        self.total = np.array([len(g) for _, g in grams], np.int64)
        bounds = [sizes(len(g), threshold) for _, g in grams]
        self.fewest, self.longest = (np.array(x, np.int64) for x in (zip(*bounds) if bounds else ([], [])))
        self.words: dict[bytes, int] = {}
        numbers: dict[str, int] = {}
        for _, own in grams:
            for gram in own:
                numbers.setdefault(gram, len(numbers) + 1)
                for word in gram.encode().split():
                    self.words.setdefault(word, len(self.words) + 1)
        self.width = len(self.words) + 1
        self.cells = np.zeros(self.width * self.width, np.int32)
        for gram, number in numbers.items():
            one, two = (self.words[w] for w in gram.encode().split())
            self.cells[one * self.width + two] = number
        holders: list[list[int]] = [[] for _ in range(len(numbers) + 1)]
        for form, (_, own) in enumerate(grams):
            for gram in own:
                holders[numbers[gram]].append(form)
        self.many = np.array([len(h) for h in holders], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.forms = np.array([f for h in holders for f in h], np.int64)

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Form and place of every shared bigram from which enough others of the form are near."""
        cell = self.cells[ids[:-1].astype(np.int64) * self.width + ids[1:]]
        place = np.flatnonzero(cell)
        gram = cell[place]
        n = self.many[gram]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        form = self.forms[np.repeat(self.first[gram], n) + inside]
        place = np.repeat(place, n)
        order = np.lexsort((place, form))
        form, place = form[order], place[order]
        ahead = np.arange(len(form)) + self.fewest[form] - 1
        within = ahead < len(form)
        ahead = np.where(within, ahead, 0)
        near = within & (form[ahead] == form) & (place[ahead] - place < self.longest[form])
        return form[near], place[near]

    def windows(self, form: int, starts: np.ndarray, shared: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """First and last bigram and coefficient of the best window from each start (of equals the shortest) that
        reaches the threshold; ``shared`` says which bigrams are the form's, ``before`` where each was last."""
        total, fewest = int(self.total[form]), int(self.fewest[form])
        a, s = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        best, end = np.zeros(len(starts)), starts.copy()
        for step in range(int(self.longest[form])):
            at = starts + step
            inside = at < len(before)
            at = np.where(inside, at, 0)
            new = inside & (before[at] < starts)
            a += new
            s += new & shared[at]
            score = np.where(s >= fewest, 2.0 * s / np.maximum(a + total, 1), 0.0)
            better = score > best
            best[better], end[better] = score[better], at[better]
        found = best >= self.threshold
        return starts[found], end[found], best[found]

    def notices(self, words: np.ndarray, known: np.ndarray, form: np.ndarray, place: np.ndarray) -> list[Notice]:
        """Notices of one text: all its words by number, those of the templates by theirs, and its candidates."""
        pair = words[:-1].astype(np.int64) << 32 | words[1:]
        order = np.argsort(pair, kind="stable")
        before = np.full(len(pair), -1, np.int64)
        same = pair[order[1:]] == pair[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        cell = self.cells[known[:-1].astype(np.int64) * self.width + known[1:]]
        found = []
        for f in np.unique(form).tolist():
            own = np.zeros(len(self.many), bool)
            own[np.repeat(np.arange(len(self.many)), self.many)[self.forms == f]] = True
            starts = place[form == f]
            for k in range(0, len(starts), STEP):
                low, high, score = self.windows(f, starts[k:k + STEP], own[cell], before)
                found.append((np.full(len(low), f), low, high, score))
        if not found:
            return []
        form, low, high, score = (np.concatenate(x) for x in zip(*found))
        if not len(low):
            return []
        # a window gives way to a better one that it overlaps, or to a longer one as good
        rank = np.unique(np.stack([score, high - low]), axis=1, return_inverse=True)[1].ravel()
        top = np.zeros(len(pair), np.int64)
        widest = int((high - low).max()) + 1
        for step in range(widest):
            at = low + step
            np.maximum.at(top, at[at <= high], rank[at <= high])
        kept = np.ones(len(low), bool)
        for step in range(widest):
            at = np.minimum(low + step, high)
            kept &= top[at] <= rank
        out = []
        for licence in sorted({self.licences[f] for f in np.unique(form[kept]).tolist()}):
            own = kept & np.isin(form, [f for f, name in enumerate(self.licences) if name == licence])
            order = np.argsort(low[own], kind="stable")
            l, h, s = (x[own][order] for x in (low, high, score))
            reach = np.maximum.accumulate(h)
            heads = np.flatnonzero(np.concatenate(([True], l[1:] > reach[:-1])))
            ends = np.maximum.reduceat(h, heads)
            out += [Notice(licence, int(i), int(j) + 1, float(x))
                    for i, j, x in zip(l[heads], ends, np.maximum.reduceat(s, heads))]
        return out

    def scan(self, texts: Sequence[str | None]) -> list[list[Notice]]:
        """The notices of each text."""
        plain = [(text or "").encode().translate(KEPT) for text in texts]
        ids = [_numbered(text, self.words.get, repeat(0)) for text in plain]
        gap = np.zeros(1, np.int32)  # words of two texts make no bigram
        form, place = self.candidates(np.concatenate([x for i in ids for x in (i, gap)] + [gap]))
        edges = np.cumsum([0] + [len(i) + 1 for i in ids])
        which = np.searchsorted(edges, place, "right") - 1
        out: list[list[Notice]] = [[] for _ in texts]
        for k in np.unique(which).tolist():
            mine = which == k
            every = _numbered(plain[k], {}.setdefault, count())
            out[k] = self.notices(every, ids[k], form[mine], place[mine] - edges[k])
        return out


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece of it at a time."""
    start = 0
    while start < len(text):
        end = text.find(b" ", start + CUT)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _numbered(text: bytes, number, others) -> np.ndarray:
    parts = [np.fromiter(map(number, words, others), np.int32, len(words)) for words in _pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


@cache
def _templates(templates: tuple[tuple[str, str], ...], threshold: float) -> Templates:
    return Templates(templates, threshold)


def notices(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, licence, first_word, last_word, score``: the places of a text that state a licence.

    A window that reaches the threshold for a template counts unless a better one,
    or a longer one as good, overlaps it; of two licences that still fit a place
    equally well both count.
    Overlapping windows of one licence are one notice.  Words are numbered from 0
    in the normalised text.  Templates without a bigram are met by nothing.
    """
    fixed = tuple(map(tuple, templates))

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = _templates(fixed, threshold).scan(rows.column(1).to_pylist())
        row = [i for i, own in enumerate(found) for _ in own]
        flat = [n for own in found for n in own]
        columns = list(zip(*flat)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [rows.column(0).take(pa.array(row, pa.int64()))]
            + [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()))],
            ["doc_id", "licence", "first_word", "last_word", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        by_slice(batch), f"doc_id {kind}, licence string, first_word bigint, last_word bigint, score double")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, licence, n_notices, n_words, best``: licences that documents state.

    ``n_notices`` places of ``n_words`` words in all state the licence, the nearest
    with the coefficient ``best``.  Null and empty texts, documents without a
    notice and empty tables give no row; rows of one id, null among them, count as
    one document, repeated rows each time; other columns are left out, whatever
    their names.  Very long texts are scanned whole.
    """
    return notices(docs, templates, threshold).groupBy("doc_id", "licence").agg(
        F.count("*").alias("n_notices"), F.sum(F.col("last_word") - F.col("first_word") + 1).alias("n_words"),
        F.max("score").alias("best"))


def scan_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, from all windows between two shared bigrams."""
    grams = [(name, template_bigrams(text)) for name, text in templates]
    grams = [(name, own) for name, own in grams if own]
    forms = ", ".join(f"({i}, '{name}', {len(own)}, {sizes(len(own), threshold)[0]}, {sizes(len(own), threshold)[1]})"
                      for i, (name, own) in enumerate(grams))
    known = ", ".join(f"({i}, '{gram}')" for i, (_, own) in enumerate(grams) for gram in own)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH forms(form, licence, total, fewest, longest) AS (VALUES {forms}), known(form, gram) AS (VALUES {known}),
    docs AS (SELECT row_number() OVER () AS r, doc_id,
        string_split(trim(regexp_replace(translate(text, '{upper}', '{lower}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
        FROM documents WHERE text IS NOT NULL),
    lists AS (SELECT r, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM docs),
    grams AS MATERIALIZED (SELECT r, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS p FROM lists),
    shared AS (SELECT r, form, p, gram FROM grams JOIN known USING (gram)),
    enough AS (SELECT r, form FROM shared JOIN forms USING (form) GROUP BY r, form, fewest
        HAVING count(DISTINCT gram) >= fewest),
    hits AS MATERIALIZED (SELECT * FROM shared SEMI JOIN enough USING (r, form)),
    pairs AS (SELECT x.r, x.form, x.p AS low, y.p AS high, total, fewest FROM hits x JOIN forms USING (form)
        JOIN hits y ON x.r = y.r AND x.form = y.form AND y.p >= x.p AND y.p < x.p + longest),
    few AS (SELECT r, form, low, high, any_value(total) AS total, count(DISTINCT gram) AS s FROM pairs JOIN hits USING (r, form)
        WHERE p BETWEEN low AND high GROUP BY r, form, low, high HAVING count(DISTINCT gram) >= any_value(fewest)),
    sized AS (SELECT r, form, low, high, 2.0::DOUBLE * any_value(s) / (count(DISTINCT gram) + any_value(total)) AS score
        FROM few JOIN grams USING (r) WHERE p BETWEEN low AND high GROUP BY r, form, low, high),
    best AS MATERIALIZED (SELECT r, licence, low, high, score FROM (SELECT *, row_number() OVER (PARTITION BY r, form, low
        ORDER BY score DESC, high) AS turn FROM sized WHERE score >= {threshold}) JOIN forms USING (form) WHERE turn = 1),
    kept AS (SELECT * FROM best x WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.r = x.r AND y.low <= x.high
        AND y.high >= x.low AND (y.score > x.score OR (y.score = x.score AND y.high - y.low > x.high - x.low)))),
    headed AS (SELECT *, coalesce(max(high) OVER (PARTITION BY r, licence ORDER BY low, high
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < low, true) AS head FROM kept),
    placed AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY r, licence ORDER BY low, high
        ROWS UNBOUNDED PRECEDING) AS place FROM headed),
    found AS (SELECT r, licence, max(high) - min(low) + 2 AS n, max(score) AS score FROM placed GROUP BY r, licence, place)
    SELECT doc_id, licence, count(*) AS n_notices, sum(n)::BIGINT AS n_words, max(score) AS best
    FROM found JOIN docs USING (r) GROUP BY doc_id, licence"""
