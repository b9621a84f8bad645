"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded; shingles
have five words (a template of fewer words is one shingle of its own length). The
containment of a template of m shingles is the largest share of its shingles that any
2m consecutive shingles of the text hold, so words may be inserted, and it does not
depend on where the license stands. A template belongs to the class c, the power of two
at or above m; each text is covered from its own start by windows of 3c shingles that
start every c, so every such span lies whole in one of them. With at least c / 2
shingles, of which 0.8 occur, its Jaccard similarity to the window is at least
0.4 / 3.1 = 0.129; ``BANDS`` bands of one MinHash row collide with probability
1 - (1 - 0.129) ** 52 > 0.999 there, and equal minima mean an equal shingle, so there are
few false windows. Spans are counted exactly in each colliding window and its
neighbours. Where licenses overlap, those that are contained to a smaller part than
another are left out.

Templates are notices by default; whole license texts come as a table, of at most
``TEMPLATE_BYTES``. They are at hand in every task; texts are scanned where they lie,
whole, without a shuffle. Window minima of all classes come from one pyramid per
MinHash, whose blocks begin at the start of each text.

Defined results: null and empty texts match nothing; a license is named once per
document with its best containment and the words of its first best occurrence; ties
go to the first; rows that repeat are rows of their own; very long texts are scanned
whole; results don't depend on how rows are dealt; an empty table gives an empty
result; an input column ``licenses`` is replaced, names that begin with ``_tessera`` are
reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .textscan import Scanner, chunks, mix64, ngrams

K, BANDS, LEAST = 5, 52, 0.8
#: Bytes of all templates of a table.
TEMPLATE_BYTES = 64 << 20
_MAX = 2**64 - 1
_U = np.uint64

# Public license notices and texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("reserved", "All rights reserved."),
]


class Templates:
    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        scan = Scanner("alnum")
        self.sets: list[np.ndarray] = []
        self.short: dict[int, dict[int, int]] = {}
        by: dict[int, list[int]] = {}
        for t, (_, text) in enumerate(templates):
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            h = scan.scan(data, np.array([0, len(data)])).hash
            if len(h) < K:
                self.sets.append(np.zeros(0, _U))
                if len(h):
                    self.short.setdefault(len(h), {}).setdefault(int(ngrams(h, len(h))[0]), t)
            else:
                s = np.unique(ngrams(h, K))
                self.sets.append(s)
                by.setdefault(1 << (len(s) - 1).bit_length(), []).append(t)
        self.multipliers = mix64(np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
        self.classes = sorted(by)
        self.tables = {}
        for c, ts in by.items():
            for j in range(BANDS):
                low = [(int((self.sets[t] * self.multipliers[j]).min()), t) for t in ts]
                low.sort()
                mark = np.zeros(1 << 16, dtype=bool)
                keys = np.array([x for x, _ in low], dtype=_U)
                mark[(keys >> _U(16)).astype(np.int64) & 0xFFFF] = True
                self.tables[c, j] = (mark, keys, [t for _, t in low])

    def windows(self, g: np.ndarray, n: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(class, text, window, template) of all bands that collide; window w of class c covers shingles w*c to (w+3)*c of its text.

        ``g``: shingles of consecutive texts, ``n``: how many each has.
        """
        found: set[tuple[int, int, int, int]] = set()
        if not len(g):
            return found
        levels = []  # of each halving: where the values go, places, first place of each text
        size = n
        for _ in range(max(self.classes).bit_length()):
            even = size + (size & 1)
            first = np.concatenate([[0], np.cumsum(even)])
            at = np.arange(int(size.sum())) + np.repeat(first[:-1] - (np.cumsum(size) - size), size)
            levels.append((at, int(first[-1]), np.concatenate([[0], np.cumsum(size)])))
            size = even // 2
        for j in range(BANDS):
            level, depth = g * self.multipliers[j], 0
            for c in self.classes:
                while 1 << depth < c:
                    at, places, _ = levels[depth]
                    wide = np.full(places, _U(_MAX)) if places > len(level) else level
                    if places > len(level):
                        wide[at] = level
                    level = np.minimum(wide[::2], wide[1::2])
                    depth += 1
                rows = levels[depth][2]
                low = level.copy()
                low[:-1] = np.minimum(level[:-1], level[1:])
                low[:-2] = np.minimum(low[:-2], level[2:])
                near = rows[1:][np.diff(rows) > 1] - 2
                low[near] = np.minimum(level[near], level[near + 1])
                last = rows[1:][np.diff(rows) > 0] - 1
                low[last] = level[last]
                mark, keys, ts = self.tables[c, j]
                for w in np.flatnonzero(mark[(low >> _U(16)).astype(np.int64) & 0xFFFF]).tolist():
                    i = int(np.searchsorted(keys, low[w]))
                    if i < len(keys) and keys[i] == low[w]:
                        d = int(np.searchsorted(rows, w, side="right")) - 1
                        while i < len(keys) and keys[i] == low[w]:
                            found.add((c, d, w - int(rows[d]), ts[i]))
                            i += 1
        return found

    def matches(self, h: np.ndarray, first: np.ndarray) -> dict[int, dict[str, tuple[float, int, int]]]:
        """For each text with a match: license name to (containment, first word, last word + 1)."""
        out: dict[int, dict[str, tuple[float, int, int]]] = {}

        def add(d, t, share, a, b):
            x = out.setdefault(d, {})
            old = x.get(self.names[t])
            if old is None or (-share, a, b) < (-old[0], old[1], old[2]):
                x[self.names[t]] = (share, a, b)

        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if len(h) >= K and self.classes:
            n = np.maximum(np.diff(first) - K + 1, 0)
            starts = np.concatenate([[0], np.cumsum(n)])
            inside = np.arange(int(starts[-1])) + np.repeat(first[:-1] - starts[:-1], n)
            g = ngrams(h, K)[inside]
            for c, d, t, low, high in _regions(self.windows(g, n)):
                a, b = int(starts[d]) + low * c, min(int(starts[d]) + high * c, int(starts[d + 1]))
                at = np.flatnonzero(np.isin(g[a:b], self.sets[t]))
                share, i, j = _densest(at, g[a + at], len(self.sets[t]))
                if share >= LEAST:
                    add(d, t, share, low * c + i, low * c + j + K)
        for n, table in self.short.items():
            if len(h) < n:
                continue
            s = ngrams(h, n)
            for key, t in table.items():
                for p in np.flatnonzero(s == _U(key)).tolist():
                    if doc[p] == doc[p + n - 1]:
                        d = int(doc[p])
                        add(d, t, 1.0, p - int(first[d]), p - int(first[d]) + n)
        return {d: _best(x) for d, x in out.items()}


def _regions(found: set[tuple[int, int, int, int]]):
    """(class, text, template, first block, last block + 1) of runs of colliding windows, with a block before and after."""
    run = None
    for c, d, t, w in sorted((c, d, t, w) for c, d, w, t in found):
        low, high = max(w - 1, 0), w + 4
        if run and run[:3] == (c, d, t) and low <= run[4]:
            run = (*run[:4], high)
            continue
        if run:
            yield run
        run = (c, d, t, low, high)
    if run:
        yield run


def _densest(at: np.ndarray, shingles: np.ndarray, m: int) -> tuple[float, int, int]:
    """Largest share of m shingles within 2m places, and the first and last place of the first such span; 0 if all of ``at`` hold too few."""
    whole = len(np.unique(shingles))
    if whole < LEAST * m:
        return 0.0, 0, 0
    if at[-1] - at[0] < 2 * m:
        return whole / m, int(at[0]), int(at[-1])
    place, key = at.tolist(), shingles.tolist()
    held: dict[int, int] = {}
    best, end = (0, 0, 0), 0
    for i, p in enumerate(place):
        while end < len(place) and place[end] - p < 2 * m:
            held[key[end]] = held.get(key[end], 0) + 1
            end += 1
        if len(held) > best[0]:
            best = (len(held), p, place[end - 1])
        held[key[i]] -= 1
        if not held[key[i]]:
            del held[key[i]]
    return best[0] / m, best[1], best[2]


def _best(found: dict[str, tuple[float, int, int]]) -> dict[str, tuple[float, int, int]]:
    """Without licenses whose words overlap those of one that is contained to a larger part."""
    return {n: (s, a, b) for n, (s, a, b) in found.items() if not any(t > s and c < b and a < d for t, c, d in found.values())}


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FOUND = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def template_table(table: DataFrame) -> list[tuple[str, str]]:
    """(name, text) of a table with columns license and text, in a fixed order; it must not exceed ``TEMPLATE_BYTES``."""
    rows = table.where("license IS NOT NULL AND text IS NOT NULL").select("license", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"license templates of {size} bytes exceed {TEMPLATE_BYTES}")
    return sorted((r["license"], r["text"]) for r in rows.collect())


def scan_licenses(docs: DataFrame, keep: list[str], text_col: str = "text", templates: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """``keep`` columns and ``licenses``: name, containment and word range of each license found, by name.

    ``templates``: (name, text) pairs, or a table with columns license and text.
    """
    small_batches(docs.sparkSession)
    if isinstance(templates, DataFrame):
        templates = template_table(templates)
    ready = Templates(TEMPLATES if templates is None else templates)
    keep = [c for c in keep if c != "licenses"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("licenses", FOUND)])

    def run(batches):
        scan = Scanner("alnum")
        for b in batches:
            out = []
            for i, j, data, offs in chunks(b.column("_tessera_text")):
                w = scan.scan(data, offs)
                m = ready.matches(w.hash, w.first)
                out += [[{"license": n, "containment": x[0], "start": x[1], "end": x[2]} for n, x in sorted(m.get(d, {}).items())] for d in range(j - i)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, _FOUND)], names=[*keep, "licenses"])

    return docs.select(*keep, F.col(text_col).alias("_tessera_text")).mapInArrow(run, schema)


def op4_licenses(spark, sf_dir):
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    names = F.transform("licenses", lambda x: x["license"])
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", names).alias("licenses"),
        F.round(F.array_max(F.transform("licenses", lambda x: x["containment"])), 6).alias("containment"),
    )
