"""Operator 10: licence scans. Sparse TF-IDF cosine of header lines and whole licence files to
templates, then inheritance from the nearest ancestor directory by path joins.

A text is compared with the templates line by line and in windows of a template's length at each term,
over line breaks too (notices wherever in the text they are), and as a whole (licence files). Terms are words; document frequencies of the templates' terms
are counted over all documents (a table as large as the templates' vocabulary), words that no template
has weigh as if no document had them. Vectors are sparse: only a line's own terms are touched.
Scores of all lines and windows come from running sums; a sum that counts repeated terms apart is
never below the cosine, so only where it is above the best score so far is the cosine computed.
Of templates with equal scores the longest is taken.

A document whose whole text is like a template, or whose name is that of a licence file, gives its
licence to its directory. Other documents without a notice of their own inherit from the nearest
directory above them that has one. Distinct directories are joined, not documents: each
directory's ancestors are looked up once, then documents join their directory.

Edge cases: null or empty texts have no licence of their own but may inherit; null paths have no
directory and inherit nothing; a directory with several licence files takes the best score, ties the
name that sorts first; repeated rows are each reported; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_chunks, table

#: Notices by which public licences are commonly named, several wordings each.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "GNU General Public License, version 2", "GNU General Public License v2.0", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU General Public License, version 3", "GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "MIT": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved",),
}
LICENSE_FILE = re.compile(r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$")

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c in b".-" else 32 for c in range(256))


def terms(data: bytes) -> list[bytes]:
    """Words in lower case with inner dots and hyphens (versions, names)."""
    return [x for w in data.translate(_TABLE).split() if (x := w.strip(b".-"))]


class Templates:
    """Templates as TF-IDF vectors."""

    def __init__(self, templates: dict[str, tuple[str, ...]], df: dict[bytes, int] | None = None, n: int = 0):
        self.names = [k for k, v in templates.items() for _ in v]
        bags = [terms(t.encode()) for v in templates.values() for t in v]
        self.vocab = {w: k for k, w in enumerate(sorted({x for b in bags for x in b}))}
        df = df or {}
        self.rare = np.log((1 + n) / 1) + 1
        self.idf = np.array([np.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in self.vocab])
        self.matrix = np.zeros((len(bags), len(self.vocab)))
        for k, b in enumerate(bags):
            for w in b:
                self.matrix[k, self.vocab[w]] += self.idf[self.vocab[w]]
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)
        self.sizes = [len(b) for b in bags]
        #: per term and template: what the term adds to the product; a last row for other words
        self.gain = np.vstack([(self.matrix * self.idf).T, np.zeros(len(bags))])
        self.square = np.append(self.idf, self.rare) ** 2

    def match(self, words: list[bytes]) -> tuple[float, str | None]:
        """Best cosine and its template."""
        at = [self.vocab[w] for w in words if w in self.vocab]
        if not at:
            return 0.0, None
        other: dict[bytes, int] = {}
        for w in words:
            if w not in self.vocab:
                other[w] = other.get(w, 0) + 1
        place, count = np.unique(at, return_counts=True)
        x = count * self.idf[place]
        size = np.sqrt((x * x).sum() + sum(c * c for c in other.values()) * self.rare**2)
        cos = self.matrix[:, place] @ x / size
        k = int(np.argmax(cos))
        return float(min(1.0, cos[k])), self.names[k]

    def _cosine(self, ids: np.ndarray, k: int) -> float:
        """Cosine of terms (numbers beyond the vocabulary: other words) to template k."""
        term, count = np.unique(ids, return_counts=True)
        term = np.minimum(term, len(self.vocab))
        return float(count @ self.gain[term, k] / np.sqrt((count * count) @ self.square[term]))

    def _best(self, words: list[bytes], ends: list[int]) -> tuple[float, str | None]:
        """Best cosine of lines (that end at ``ends``) and windows, and its template."""
        n, other = len(words), len(self.vocab)
        names: dict[bytes, int] = {}
        ids = np.fromiter((self.vocab[w] if w in self.vocab else other + names.setdefault(w, len(names)) for w in words), np.int64, n)
        known = np.minimum(ids, other)
        if (known == other).all():
            return 0.0, None
        total = np.concatenate([[0.0], np.cumsum(self.square[known])])
        line = np.unique([0, *ends])
        norms = {size: np.sqrt(total[size:] - total[:-size]) for size in set(self.sizes) if size <= n}
        across = np.sqrt(total[line[1:]] - total[line[:-1]])
        best, length, name = 0.0, 0, None
        step = max(1, (1 << 22) // n)
        for first in range(0, len(self.names), step):  # bounded memory for very long texts
            sums = np.zeros((min(step, len(self.names) - first), n + 1))
            np.cumsum(self.gain[known, first : first + step].T, axis=1, out=sums[:, 1:])
            found = []
            for k, row in enumerate(sums, first):
                size = self.sizes[k]
                bound = (row[line[1:]] - row[line[:-1]]) / across
                found.append((float(bound.max()), k, bound, 0))
                if size in norms:
                    bound = (row[size:] - row[:-size]) / norms[size]
                    found.append((float(bound.max()), k, bound, size))
            found.sort(key=lambda x: -x[0])
            for most, k, bound, size in found:
                # equal scores differ in their last digits, and then the longer template is taken
                least = best - 1e-9 if self.sizes[k] > length else best + 1e-9
                if most <= max(least, 1e-9):
                    continue
                seen = set()
                at = np.flatnonzero(bound > max(least, 1e-9))
                for p in at[np.argsort(-bound[at], kind="stable")].tolist():
                    if bound[p] <= least:
                        break
                    part = ids[p : p + size] if size else ids[line[p] : line[p + 1]]
                    if (mark := part.tobytes()) in seen:
                        continue
                    seen.add(mark)
                    cos = self._cosine(part, k)
                    if cos > least:
                        best, length, name = max(cos, best), self.sizes[k], self.names[k]
                        least = best + 1e-9
        return min(1.0, best), name

    def scan(self, data: bytes | None) -> tuple[float, str | None, float, str | None]:
        """Best score of a line or window and its template, the whole text's score and template."""
        words: list[bytes] = []
        ends = []
        for line in data.split(b"\n") if data else ():
            words += terms(line)
            ends.append(len(words))
        return (*self._best(words, ends), *self.match(words)) if words else (0.0, None, 0.0, None)


def frequencies(docs: DataFrame, templates: dict[str, tuple[str, ...]], text: str = "text") -> tuple[dict[bytes, int], int]:
    """Documents that have each of the templates' terms, and the number of documents."""
    vocab = list(Templates(templates).vocab)

    def run(cols):
        n, known = np.zeros(len(vocab) + 1, np.int64), frozenset(vocab)
        at = {w: k for k, w in enumerate(vocab)}
        for t in cols[0]:
            n[-1] += 1
            for w in known.intersection(terms(t or b"")):
                n[at[w]] += 1
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)).astype(np.int32)), pa.array(n)], names=["k", "n"])

    got = {r[0]: r[1] for r in map_chunks(docs.select(F.encode(text, "UTF-8")), run, "k int, n long", size_of=0).groupBy("k").agg(F.sum("n")).collect()}
    return {w: got.get(k, 0) for k, w in enumerate(vocab)}, got.get(len(vocab), 0)


def scan(docs: DataFrame, path: str, templates: dict[str, tuple[str, ...]] | None = None, line_at: float = 0.75, file_at: float = 0.6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: path, license, score, how (``own``, ``inherited`` or null) and where it is from.

    path: column with a slash-separated path; line_at, file_at: least cosine of a line or window and of a file
    (of one that is named as a licence file half as much).
    """
    templates = TEMPLATES if templates is None else templates
    df, n = frequencies(docs, templates, text)
    held = docs.sparkSession.sparkContext.broadcast(Templates(templates, df, n))

    def run(cols):
        found = [held.value.scan(t) for t in cols[1]]
        license, score, gives = [], [], []
        for p, (a, x, b, y) in zip(cols[2], found):
            named = p is not None and LICENSE_FILE.match(p.rpartition("/")[2]) is not None
            file = b >= file_at or (named and max(a, b) >= file_at / 2)
            own = (y, b) if file and b >= a else (x, a) if file or a >= line_at else (None, max(a, b))
            license.append(own[0])
            score.append(own[1])
            gives.append(file and own[0] is not None)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[2], pa.string()), pa.array(license, pa.string()), pa.array(score, pa.float64()), pa.array(gives, pa.bool_())], names=["doc_id", "path", "license", "score", "gives"])

    rows = docs.select(F.col(key).cast("long"), F.encode(text, "UTF-8"), F.col(path).cast("string"))
    found = table(map_chunks(rows, run, "doc_id long, path string, license string, score double, gives boolean"), "licenses").withColumn("dir", F.regexp_replace(F.regexp_replace("path", "^[^/]*$", ""), "/[^/]*$", ""))
    # one licence a directory: the best score, then the first name
    givers = found.where("gives and path is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "path")).alias("best"))
    givers = givers.select(F.col("dir").alias("up"), F.col("best.license").alias("up_license"), F.col("best.path").alias("up_path"))
    # each distinct directory looks its ancestors (itself, its parent, ... the root) up once
    dirs = found.where("path is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("up")))).alias("a")).select("dir", "a.depth", "a.up")
    nearest = ups.join(givers, "up").groupBy("dir").agg(F.max(F.struct("depth", "up_license", "up_path")).alias("near")).select("dir", "near.up_license", "near.up_path")
    # joined by another name of ``dir``: the small side is shuffled anew, so that Spark may split a large directory over tasks
    nearest = nearest.select(F.concat(F.lit("/"), "dir").alias("at"), "up_license", "up_path")
    out = found.withColumn("at", F.concat(F.lit("/"), "dir")).join(nearest, "at", "left")
    own = F.col("license").isNotNull()
    return out.select("doc_id", "path", F.coalesce("license", "up_license").alias("license"), "score", F.when(own, "own").when(F.col("up_license").isNotNull(), "inherited").alias("how"), F.when(own, F.col("path")).otherwise(F.col("up_path")).alias("from_path"))
