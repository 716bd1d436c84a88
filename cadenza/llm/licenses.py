"""License scans: MinHash bands over overlapping windows, then exact containment.

Templates are grouped by their number of five-word shingles m.  For each group a text is covered by
windows of m + m/4 + step shingles, one every ``step`` = max(1, m/2) shingles, so any occurrence of a
template, stretched by a quarter at most, lies whole in some window.  Windows and templates share a
band if one of their ``rows`` MinHashes agree; the number of bands is chosen so that a window that
holds a template to the threshold collides with a chance of at least 1 - ``MISS``.  Each retrieved
(window, template) is then verified: the share of the template's shingles in the window, exactly.
Windows with fewer shingles of the group's templates than the threshold needs cannot pass and are
left out before the bands.

Notices of fewer than five words have no shingle: they stand in a list of their own (``SHORT``) and
are found as one exact run of all their words, with containment 1 and the run's first word.  Their
template numbers follow those of the templates.

Words are runs of letters, digits and bytes beyond ASCII, lower-cased, so comment signs and
punctuation do not matter.  A template of fewer than five words, a short notice of five or more, and
a notice without words are errors.

Scale: a narrow map over the documents in slices; the templates (``MAX_TEMPLATE_WORDS`` words in all
at most) travel with the tasks.  Several windows may hold the same occurrence; a document gets one
row for each template found, with the largest containment and the first such window.

Defined results: null or short texts match nothing; repeated rows are scanned each; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.bpe import slices
from cadenza.llm.common import text_or_empty
from cadenza.llm.near_dup import _odd, mix, word_hashes

SHINGLE = 5
CONTAINMENT = 80        # percent of a template's shingles
MISS = 1e-4
ROWS = 1                # MinHashes a band; a window shares few shingles with short templates
SLICE = 1_000_000
MAX_TEMPLATE_WORDS = 100_000

#: Usual license notices, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
            "and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License. You may obtain a copy of "
                   "the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later "
                "version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met:"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
                  "License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                     "International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
                     "International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons "
                        "Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons "
                        "Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and "
                "related and neighboring rights to this software to the public domain worldwide."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under "
                 "the terms of the GNU Lesser General Public License as published by the Free "
                 "Software Foundation; either version 2.1 of the License, or (at your option) any "
                 "later version."),
    ("AGPL-3.0", "You should have received a copy of the GNU Affero General Public License along "
                 "with this program."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of "
                "the Eclipse Public License 2.0"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors "
                     "may be used to endorse or promote products derived from this software "
                     "without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
            "or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no "
             "event will the authors be held liable for any damages arising from the use of this "
             "software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]

#: Notices of fewer than five words.
SHORT = [
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
]


def word_blanks() -> np.ndarray:
    """Bytes that separate words: ASCII other than letters and digits."""
    table = np.ones(256, bool)
    table[[b for b in range(256) if b >= 0x80 or chr(b).isalnum()]] = False
    return table


def runs(words: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words in order, and each text's number of them."""
    odd = _odd(width, 11)
    n = max(len(words) - width + 1, 0)
    joint = np.zeros(n, np.uint64)
    for k in range(width):
        joint += words[k:k + n] * odd[k]
    size = np.maximum(count - width + 1, 0)
    keep = np.zeros(len(words), bool)
    first = np.cumsum(count) - count
    for f, s in zip(first.tolist(), size.tolist(), strict=True):
        keep[f:f + s] = True
    return mix(joint)[keep[:n]], size


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words in order, and each text's number of them."""
    return runs(*word_hashes(texts, word_blanks()), SHINGLE)


def bands_needed(likeness: float, rows: int, miss: float = MISS) -> int:
    """Bands of ``rows`` with which a pair of that similarity collides with chance 1 - miss."""
    return math.ceil(math.log(miss) / math.log1p(-likeness ** rows))


class Group:
    """Templates of one size: windows, bands and their keys."""

    def __init__(self, m: int, members: list[tuple[int, np.ndarray]], percent: int, rows: int,
                 miss: float):
        self.members = members
        self.step = max(1, m // 2)
        self.width = m + m // 4 + self.step
        self.own = np.unique(np.concatenate([s for _, s in members]))
        # the least that any member needs; ``m`` counts a member's repeated shingles
        self.least = max(1, min(math.ceil(len(s) * percent / 100) for _, s in members))
        held = max(1, math.ceil(m * percent / 100))
        # distinct shingles of a window and the template that hold ``held`` in common
        self.bands = bands_needed(held / (self.width + m - held), rows, miss)
        self.rows = rows
        self.times, self.plus = _odd(self.bands * rows, 12), _odd(self.bands * rows, 13)
        keys = [(self.keys(s, np.array([0]), np.array([len(s)])), t) for t, s in members]
        self.lookup = [{} for _ in range(self.bands)]
        for k, t in keys:
            for j in range(self.bands):
                self.lookup[j].setdefault(int(k[j, 0]), []).append(t)
        self.known = [np.array(sorted(d), np.uint64) for d in self.lookup]

    def keys(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(bands, windows): the bands' keys of the windows."""
        edges = np.empty(2 * len(starts), np.int64)
        edges[0::2], edges[1::2] = starts, ends
        out = np.zeros((self.bands, len(starts)), np.uint64)
        for j in range(self.bands):
            for r in range(j * self.rows, (j + 1) * self.rows):
                values = np.append(flat * self.times[r] + self.plus[r], np.uint64(0))
                least = np.minimum.reduceat(values >> np.uint64(20), edges)[0::2]
                out[j] = mix(out[j] * np.uint64(31) + least)
        return out


def groups_of(templates: list[tuple[str, str]], percent: int, rows: int = ROWS,
              miss: float = MISS) -> list[Group]:
    """Templates by size (powers of two apart)."""
    words = sum(len(text.split()) for _, text in templates)
    if words > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold {words} words, over {MAX_TEMPLATE_WORDS}")
    by: dict[int, list] = {}
    for t, (name, text) in enumerate(templates):
        flat, _ = shingles([text])
        if not len(flat):
            raise ValueError(f"template {t} ({name}) is shorter than {SHINGLE} words")
        by.setdefault(len(flat), []).append((t, np.unique(flat)))
    return [Group(m, members, percent, rows, miss) for m, members in sorted(by.items())]


def short_runs(short: list[tuple[str, str]], first: int) -> dict[int, dict[int, list[int]]]:
    """Short notices by their number of words and hash: their numbers, counted from ``first``."""
    by: dict[int, dict[int, list[int]]] = {}
    for t, (name, text) in enumerate(short, first):
        words, count = word_hashes([text], word_blanks())
        if not 0 < len(words) < SHINGLE:
            raise ValueError(f"short notice {t} ({name}) has {len(words)} words, "
                             f"not 1 to {SHINGLE - 1}")
        run, _ = runs(words, count, len(words))
        by.setdefault(len(words), {}).setdefault(int(run[0]), []).append(t)
    return by


def scan(groups: list[Group], texts: list[str], percent: int,
         short: dict[int, dict[int, list[int]]] | None = None) -> list[tuple[int, int, float, int]]:
    """(text, template, containment, first word) - one for each text and template found."""
    words, count = word_hashes(texts, word_blanks())
    flat, size = runs(words, count, SHINGLE)
    first = np.cumsum(size) - size
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for g in groups:
        # windows start every ``step`` shingles; the last ones of a text are cut at its end
        n = -(-size // g.step)
        text = np.repeat(np.arange(len(texts)), n)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * g.step
        starts = first[text] + place
        ends = np.minimum(starts + g.width, (first + size)[text])
        held = np.concatenate([[0], np.cumsum(_among(flat, g.own))])
        fit = held[ends] - held[starts] >= g.least
        text, place, starts, ends = text[fit], place[fit], starts[fit], ends[fit]
        if not len(starts):
            continue
        found = set()
        # the windows' shingles one after another
        wide = ends - starts
        base = np.cumsum(wide) - wide
        within = np.arange(wide.sum()) + np.repeat(starts - base, wide)
        keys = g.keys(flat[within], base, base + wide)
        for j in range(g.bands):
            at = np.minimum(np.searchsorted(g.known[j], keys[j]), len(g.known[j]) - 1)
            for w in np.flatnonzero(g.known[j][at] == keys[j]).tolist():
                found.update((w, t) for t in g.lookup[j][int(keys[j, w])])
        sets = dict(g.members)
        for w, t in sorted(found):
            held = np.isin(sets[t], flat[starts[w]:ends[w]]).sum()
            if 100 * held >= percent * len(sets[t]):
                share, key = held / len(sets[t]), (int(text[w]), t)
                if key not in best or share > best[key][0]:
                    best[key] = share, int(place[w])
    for width, known in (short or {}).items():
        flat, size = runs(words, count, width)
        first = np.cumsum(size) - size
        at = np.flatnonzero(_among(flat, np.array(sorted(known), np.uint64)))
        for p, d in zip(at.tolist(), (np.searchsorted(first, at, "right") - 1).tolist(),
                        strict=True):
            for t in known[int(flat[p])]:
                best.setdefault((d, t), (1.0, p - int(first[d])))
    return [(d, t, share, at) for (d, t), (share, at) in sorted(best.items())]


def _among(flat: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each hash is one of the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat


def scan_documents(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
                   percent: int = CONTAINMENT, short: list[tuple[str, str]] = ()) -> DataFrame:
    """doc_id, license, template (its place in templates, then short), containment, first_word."""
    names = [name for name, _ in [*templates, *short]]

    def run(batches):
        groups, lines = groups_of(templates, percent), short_runs(short, len(templates))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in slices(batch.column(1), SLICE):
                rows = scan(groups, texts, percent, lines)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[first + r[0]] for r in rows], pa.int64()),
                    "license": pa.array([names[r[1]] for r in rows], pa.string()),
                    "template": pa.array([r[1] for r in rows], pa.int32()),
                    "containment": pa.array([r[2] for r in rows], pa.float64()),
                    "first_word": pa.array([r[3] for r in rows], pa.int64())})

    groups_of(templates, percent)  # refuse bad templates before the job
    short_runs(short, len(templates))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInArrow(run, "doc_id long, license string, template int, containment double, "
                         "first_word long")
