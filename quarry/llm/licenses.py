"""License scans: sparse TF-IDF cosine to license templates, then inheritance from the nearest directory above.

Each template is compared with every stretch of the text as long as itself, across line ends, so that a notice is found
wherever it stands and however it is wrapped. Weights are term counts times log((N + 1) / (df + 1)), with df of the
templates' words counted over all files; a word of no template weighs as one that no other file has, so surrounding
prose lowers the cosine. A stretch begins and ends with a word of some template. Running sums give an upper bound of every
stretch's cosine at once; the few whose bound reaches the best so far are computed in full.

A file's own license is its best match of at least ``least``. A file without one takes that of the license file in the
nearest directory at or above its own: files meet directories by joins on their ancestor paths.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, small_batches

#: Notices and the opening words of license texts, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]
LICENSE_FILE = r"(?i)^(un)?licen[cs]e|^copying|^copyright"
LEAST = 0.7
_TERM = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


class LicenseIndex:
    """Templates as sparse unit vectors under given document counts of their words."""

    def __init__(self, df: dict[str, int], n_docs: int, templates=None, least: float = LEAST):
        self.least = least
        self.rare = math.log(n_docs + 1) if n_docs else 1.0
        counts = [Counter(terms(text)) for _, text in templates or TEMPLATES]
        self.names = [name for name, _ in templates or TEMPLATES]
        self.sizes = np.array([sum(c.values()) for c in counts])
        self.code = {w: k for k, w in enumerate(dict.fromkeys(w for c in counts for w in c))}
        self.idf = np.array([max(math.log((n_docs + 1) / (df.get(w, 0) + 1)), 1e-6) for w in self.code])
        self.units = np.zeros((len(counts), len(self.code)))
        for t, c in enumerate(counts):
            for w, n in c.items():
                self.units[t, self.code[w]] = n * self.idf[self.code[w]]
        self.units /= np.maximum(np.linalg.norm(self.units, axis=1, keepdims=True), 1e-12)
        self.squares = self.units**2

    def cosine(self, words: list[str], t: int) -> float:
        """Of a stretch and a template, in full."""
        dot = norm = 0.0
        for w, n in Counter(words).items():
            k = self.code.get(w)
            weight = n * (self.rare if k is None else self.idf[k])
            norm += weight * weight
            dot += 0.0 if k is None else weight * self.units[t, k]
        return dot / math.sqrt(norm) if norm else 0.0

    def bounds(self, codes: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template, start, end, bound) of the stretches whose cosine to one of the templates may reach ``least``: their words count as all different in the
        norm, which is the least it can be."""
        n, starts = len(codes), np.flatnonzero(codes >= 0)
        known = np.maximum(codes, 0)
        own = np.r_[0.0, np.cumsum(np.where(codes >= 0, self.idf[known] ** 2, 0.0))]
        others = np.r_[0, np.cumsum(codes < 0)]
        last = np.maximum.accumulate(np.where(codes >= 0, np.arange(n), -1))
        out = [(np.empty(0, np.int64),) * 3 + (np.empty(0),)]
        for t in within.tolist():
            size = int(self.sizes[t])
            ends = last[np.minimum(starts + size, n) - 1] + 1
            dot = np.r_[0.0, np.cumsum(np.where(codes >= 0, self.units[t, known] * self.idf[known], 0.0))]
            bound = (dot[ends] - dot[starts]) / np.sqrt(own[ends] - own[starts] + (others[ends] - others[starts]) * self.rare**2)
            at = np.flatnonzero(bound >= self.least)
            out.append((np.full(len(at), t), starts[at], ends[at], bound[at]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def match(self, text: str | None) -> tuple[str | None, float, int | None]:
        """(license, similarity, line of its first word) of the best stretch; ties to the first stretch, then template."""
        words = terms(text)
        codes = np.fromiter((self.code.get(w, -1) for w in words), np.int64, len(words))
        present = np.zeros(len(self.code))
        present[codes[codes >= 0]] = 1.0
        # no stretch comes nearer to a template than the length of the template's part that the whole text has words of
        within = np.flatnonzero(self.squares @ present >= self.least**2 - 1e-9)
        if not len(within):
            return None, 0.0, None
        which, starts, ends, bound = self.bounds(codes, within)
        top: tuple[float, int, int] | None = None
        for k in np.argsort(-bound, kind="stable").tolist():
            if top and bound[k] < -top[0] - 1e-9:
                break
            t, s, e = int(which[k]), int(starts[k]), int(ends[k])
            cosine = round(self.cosine(words[s:e], t), 12)
            if cosine >= self.least and (top is None or (-cosine, s, t) < top):
                top = -cosine, s, t
        if top is None:
            return None, 0.0, None
        lower = (text or "").lower()
        place = next(itertools.islice(_TERM.finditer(lower), top[1], None)).start()
        return self.names[top[2]], -top[0], lower.count("\n", 0, place)


def count_frames(vocab):
    """For mapInArrow over (text): in how many texts each word of the templates stands, and the texts ('' counts those)."""
    import pyarrow as pa

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                total.update(vocab.intersection(terms(t.as_py())))
                total[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return run


def match_frames(index):
    """For mapInArrow over (id, path, is_file, text)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            names, sims, lines = zip(*[index.value.match(t.as_py()) for t in b.column(3)], strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(names, pa.string()), pa.array(sims, pa.float64()), pa.array(lines, pa.int64())], ["id", "path", "is_file", "own", "similarity", "line"])

    return run


def scan_licenses(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates=None, least: float = LEAST) -> DataFrame:
    """One row per input row: (id, path, own_license, similarity, line, license, inherited_from).

    license is the file's own, else that of the license file in the nearest directory at or above it (inherited_from); of
    several in one directory the most similar, then the smallest name. Null and empty texts have no license of their own; a null path
    is the root. Rows that repeat an id or a path are files of their own. Word counts cover all rows; what tasks share is the templates.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = F.regexp_replace(F.coalesce(df[path_col].cast("string"), F.lit("")), r"^(\./|/)+|/+$", "")
    rows = df.select(df[id_col].cast("long").alias("id"), path.alias("path"), df[text_col].cast("string").alias("text"))
    rows = rows.select("id", "path", F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE).alias("is_file"), "text")
    vocab = frozenset(w for _, t in templates or TEMPLATES for w in terms(t))
    counted = rows.select("text").mapInArrow(count_frames(vocab), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df_of = {r.word: r.n for r in counted}
    index = spark.sparkContext.broadcast(LicenseIndex(df_of, df_of.get("", 0), templates, least))
    own = materialize(rows.mapInArrow(match_frames(index), "id long, path string, is_file boolean, own string, similarity double, line long"), "licenses")

    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    named = own.where("is_file and own is not null").select(folder.alias("folder"), F.struct((-F.col("similarity")).alias("s"), "path", "own").alias("pick"))
    folders = named.groupBy("folder").agg(F.min("pick").alias("pick")).select("folder", F.col("pick.own").alias("given"), F.col("pick.path").alias("giver"))
    lacking = own.where("own is null").select("id", "path").distinct()
    parts = F.split(folder, "/")
    above = lacking.select("id", "path", F.explode(F.transform(F.sequence(F.lit(0), F.when(folder == "", 0).otherwise(F.size(parts))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("folder")))).alias("a"))
    met = above.select("id", "path", "a.depth", "a.folder").join(folders, "folder")
    nearest = met.groupBy("id", "path").agg(F.max(F.struct("depth", "given", "giver")).alias("best"))
    nearest = nearest.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("best.given").alias("given"), F.col("best.giver").alias("giver"))
    out = own.join(nearest, own["id"].eqNullSafe(nearest["_id"]) & (own["path"] == nearest["_path"]) & own["own"].isNull(), "left")
    return out.select(F.col("id").alias(id_col), "path", F.col("own").alias("own_license"), "similarity", "line", F.coalesce("own", "given").alias("license"), F.col("giver").alias("inherited_from"))
