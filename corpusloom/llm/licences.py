"""Licence scan: sparse TF-IDF cosines to templates, then inheritance from directories.

Templates (``TEMPLATES``) are the standard texts in ``templates/``, whole, and their titles, notices and grants.
Terms are all words.  Document frequencies are counted over all documents;
idf = ln((1 + N) / (1 + df)) + 1.

Four kinds of units of a text are compared with each template: every line; every paragraph
(lines in a row that hold a word); every block (lines in a row that aren't blank, so a comment with
bare comment signs between its paragraphs is one); and, of a licence file (by its name), the
whole text.  Of the units whose best cosine reaches ``THRESHOLD`` the one of most evidence, words times cosine, tells the file's own
licence, so a whole licence goes before a line that quotes another; ties go to the greater cosine, then to the
template first in order of name.

The words of the templates are counted first: with other words at the least
idf, 1, they bound a unit's cosine from above, and only for units that can reach
the threshold are the other words counted and joined.

A file without a licence inherits from the nearest ancestor directory, its own
included, that holds a licence file with a licence.  Distinct directories are
joined with the licensed ones on the paths of their ancestors, so the join has
one row for each directory and level, whatever the files.  Of several licence files in a directory
the one of greatest cosine, then least path, then least licence name counts.

Defined cases: null or empty texts have no own licence but inherit; a null path
neither inherits nor lends; separators '/' at the ends or repeated count once.  Repeated rows
each get a row.  An empty table gives an empty result.  Columns other than the three named aren't read.
"""

from __future__ import annotations

from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as tk
from corpusloom.llm.quality import _LINE
from corpusloom.llm.work import Workspace, small

_GNU = "you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
_PROGRAM = "This program is free software: " + _GNU
_LIBRARY = "This library is free software; " + _GNU
#: Titles, notices and grants, by licence.
NOTICES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "licensed under the GNU Affero General Public License version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        _PROGRAM.format("Affero General Public License", 3),
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "BSD-2-Clause": (
        "released under the BSD 2-Clause Simplified License",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "BSD-3-Clause": (
        "released under the BSD 3-Clause New or Revised License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal"),
    "GPL-2.0": (
        "licensed under the GNU General Public License version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        _PROGRAM.format("General Public License", 2),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _PROGRAM.format("General Public License", 3),
    ),
    "ISC": (
        "released under the ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": (
        "licensed under the GNU Lesser General Public License version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        _LIBRARY.format("Lesser General Public License", "2.1"),
    ),
    "LGPL-3.0": (
        "licensed under the GNU Lesser General Public License version 3",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        _LIBRARY.format("Lesser General Public License", 3),
    ),
    "MIT": (
        "Released under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "MPL-2.0": (
        "subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "free and unencumbered software released into the public domain",
        "SPDX-License-Identifier: Unlicense",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
}


def full_texts() -> dict[str, str]:
    """The standard texts by licence."""
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in resources.files(__package__).joinpath("templates").iterdir() if f.name.endswith(".txt")}


TEXTS = full_texts()
TEMPLATES: dict[str, tuple[str, ...]] = {name: (*notices, *([TEXTS[name]] if name in TEXTS else [])) for name, notices in NOTICES.items()}
THRESHOLD = 0.6
FILE_NAMES = ("license", "licence", "copying", "license.txt", "licence.txt", "license.md", "licence.md", "copying.txt", "notice")


def _terms(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return tk.words(data, np.array([0, len(data)]))[2]


NAMES = [name for name, texts in sorted(TEMPLATES.items()) for _ in texts]
_LISTS = [_terms(t) for _, texts in sorted(TEMPLATES.items()) for t in texts]
TERMS = np.unique(np.concatenate(_LISTS))


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of each term the number of texts that hold it.  Each task sends one row of len(TERMS) counts."""

    def run(batches):
        total, df = 0, np.zeros(len(TERMS), np.int64)
        for b in batches:
            data, off = tk.utf8(b.column(0))
            total += len(b) - b.column(0).null_count
            for i, j in tk.runs(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                s, _, h = tk.words(d, o)
                at = np.minimum(np.searchsorted(TERMS, h), len(TERMS) - 1)
                hit = TERMS[at] == h
                df += tk.counts(np.unique(tk.rows_of(s[hit], o) * len(TERMS) + at[hit]) % len(TERMS), len(TERMS))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(TERMS) + 1, dtype=np.int32)), pa.array(np.append(df, total))], ["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the templates
    df = np.zeros(len(TERMS) + 1, np.int64)
    for r in rows:
        df[r.term] = r.n
    return int(df[-1]), df[:-1]


def weights(n: int, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """idf of the terms, and unit template vectors (terms x templates)."""
    idf = np.log((1 + n) / (1 + df)) + 1
    t = np.zeros((len(TERMS), len(_LISTS)))
    for k, words in enumerate(_LISTS):
        np.add.at(t[:, k], np.searchsorted(TERMS, words), 1)
    t *= idf[:, None]
    return idf, t / np.sqrt((t**2).sum(0))


def _possible(unit: np.ndarray, h: np.ndarray, n: int, idf, templates, threshold: float):
    """(vector, record of UNITS) of each of n vectors that can reach the threshold; unit tells the vector of each word hash."""
    at = np.minimum(np.searchsorted(TERMS, h), len(TERMS) - 1)
    hit = TERMS[at] == h
    key, tf = np.unique(unit[hit] * len(TERMS) + at[hit], return_counts=True)
    u, t = key // len(TERMS), key % len(TERMS)
    w = tf * idf[t]
    inner, outside = np.bincount(u, w * w, n), tk.counts(unit[~hit], n)
    least = np.sqrt(inner + outside)  # no idf is below 1
    # each term at its greatest weight in any template bounds the product
    maybe = np.bincount(u, w * templates.max(1)[t], n) >= np.maximum((threshold - 1e-8) * least, 1e-12)
    if not maybe.any():
        return
    some = maybe[u]
    place = np.cumsum(maybe) - 1
    product = np.zeros((int(maybe.sum()), templates.shape[1]))
    u, t, w = place[u[some]], t[some], w[some]
    for a in range(0, len(u), 1 << 14):
        z = slice(a, a + (1 << 14))
        first = np.flatnonzero(np.concatenate([[True], u[z][1:] != u[z][:-1]]))
        product[u[z][first]] += np.add.reduceat(w[z, None] * templates[t[z]], first)
    inner, least = inner[maybe], least[maybe]
    top = np.argmax(np.round(product / np.maximum(np.sqrt(inner), 1e-12)[:, None], 9), 1)
    best = product[np.arange(len(product)), top]
    can = (best > 0) & (best >= (threshold - 1e-8) * least)
    chosen = np.flatnonzero(maybe)[can]
    total = tk.counts(unit, n)
    keep = ~hit & np.isin(unit, chosen)
    u, w = unit[keep], h[keep]
    order = np.argsort(u, kind="stable")
    u, w = u[order], w[order]
    for k, c in zip(np.flatnonzero(can).tolist(), chosen.tolist(), strict=True):
        a, z = np.searchsorted(u, (c, c + 1))
        words, tf = np.unique(w[a:z], return_counts=True)
        yield c, {"words": int(total[c]), "product": float(best[k]), "inner": float(inner[k]), "top": int(top[k]), "others": [{"word": x, "tf": y} for x, y in zip(words.view(np.int64).tolist(), tf.tolist(), strict=True)]}


def units(d: np.ndarray, o: np.ndarray, s: np.ndarray, whole: np.ndarray):
    """For lines, paragraphs, blocks and whole texts: (words that belong to one, their unit, number of units, row of each unit).

    s: starts of the words; whole: rows that count as a whole too.  A paragraph of one line and a block of one paragraph aren't named again.
    """
    ls, le = tk.spans(_LINE[d], o)
    line, row = np.searchsorted(ls, s, "right") - 1, tk.rows_of(ls, o)
    n = len(ls)
    every = np.arange(len(s))
    yield every, line, n, row
    visible = np.add.reduceat(~tk.SPACE[d], ls, dtype=np.int32) > 0
    worded = tk.counts(line, n) > 0
    breaks = np.maximum(*(np.diff(np.concatenate([[0], np.cumsum(d == c)])[np.stack([le[:-1], ls[1:]])], axis=0)[0] for c in (10, 13)))
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (breaks > 1) | ~visible[1:] | ~visible[:-1]])
    inner = new | np.concatenate([[True], ~worded[1:] | ~worded[:-1]])
    par, block = np.cumsum(inner) - 1, np.cumsum(new) - 1
    for of, parts in ((par, np.arange(n)), (block, par)):
        first = np.flatnonzero(np.diff(of, prepend=-1))
        one = np.unique(parts[worded])  # the parts with a word
        where = of[np.searchsorted(parts, one)]
        keep = tk.counts(where, len(first))[of[line]] > 1
        if keep.any():
            yield every[keep], of[line[keep]], len(first), row[first]
    if whole.any():
        r = tk.rows_of(s, o)
        yield every[whole[r]], r[whole[r]], len(o) - 1, np.arange(len(o) - 1)


UNITS = "array<struct<words:int,product:double,inner:double,top:int,others:array<struct<word:bigint,tf:int>>>>"
_UNITS = pa.list_(pa.struct({"words": pa.int32(), "product": pa.float64(), "inner": pa.float64(), "top": pa.int32(), "others": pa.list_(pa.struct({"word": pa.int64(), "tf": pa.int32()}))}))


def possible_units(docs: DataFrame, n: int, df: np.ndarray, threshold: float) -> DataFrame:
    """row, doc_id, path, is_file, units that can reach the threshold; row numbers the rows of a run of this plan."""
    idf, templates = weights(n, df)

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            data, off = tk.utf8(b.column("text"))
            whole = np.array(b.column("is_file").to_pylist(), bool)
            found = [[] for _ in range(len(b))]
            for i, j in tk.runs(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                s, _, h = tk.words(d, o)
                if not len(s):
                    continue
                for words, unit, count, row in units(d, o, s, whole[i:j]):
                    for c, x in _possible(unit, h[words], count, idf, templates, threshold):
                        found[i + row[c]].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(b))), b.column("doc_id"), b.column("path"), b.column("is_file"), pa.array(found, _UNITS)], ["row", "doc_id", "path", "is_file", "units"])
            number += len(b)

    return docs.mapInArrow(run, f"row long, doc_id long, path string, is_file boolean, units {UNITS}")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: partial counts of the texts that hold a word."""

    def run(batches):
        for b in batches:
            data, off = tk.utf8(b.column(0))
            for i, j in tk.runs(off):
                o = off[i : j + 1] - off[i]
                s, _, h = tk.words(data[off[i] : off[j]], o)
                row, order = tk.rows_of(s, o), np.argsort(h, kind="stable")  # rows stay in order within a word
                h, row = h[order], row[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                words, n = np.unique(h[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long")


def own_licences(docs: DataFrame, n: int, df: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, is_file, licence, cosine (both null below the threshold)."""
    ws = Workspace(docs.sparkSession, "licence-units")
    found = ws.table(possible_units(docs, n, df, threshold), "found")  # it has no texts
    each = found.select("row", F.posexplode("units").alias("unit", "x")).select("row", "unit", "x.words", "x.product", "x.inner", "x.top", "x.others")
    others = each.select("row", "unit", F.inline("others"))
    asked = ws.table(others.select("word").distinct(), "asked")
    counted = word_counts(docs).join(small(asked, 16), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    weight = F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("n"))) + 1)
    outer = others.join(ws.table(counted, "counted"), "word").groupBy("row", "unit").agg(F.sum(weight * weight).alias("outer"))
    cosine = F.round(F.col("product") / F.sqrt(F.col("inner") + F.coalesce("outer", F.lit(0.0))), 9)
    best = each.drop("others").join(outer, ["row", "unit"], "left").select("row", "words", cosine.alias("cosine"), "top").where(F.col("cosine") >= threshold)
    best = best.groupBy("row").agg(F.min(F.struct((-F.round(F.col("words") * F.col("cosine"), 6)).alias("e"), (-F.col("cosine")).alias("c"), "top")).alias("b"))
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("b.top") + 1)
    return found.drop("units").join(best, "row", "left").select("doc_id", "path", "is_file", F.when(F.col("b").isNotNull(), name).alias("licence"), (-F.col("b.c")).alias("cosine"))


def scan(docs: DataFrame, path: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, licence, cosine, source ('own', 'inherited' or null), inherited_from for every row."""
    clean = F.expr(f"regexp_replace(regexp_replace(cast(`{path}` as string), '/+', '/'), '^/|/$', '')")
    name = F.lower(F.regexp_extract(clean, "([^/]*)$", 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean.alias("path"), F.coalesce(name.isin(*FILE_NAMES), F.lit(False)).alias("is_file"), F.col("text").cast("string").alias("text"))
    found = own_licences(rows, *frequencies(docs), threshold).withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))
    found = Workspace(docs.sparkSession, "licences").table(found, "own")  # read three times; it has no texts
    lends = found.where("is_file and licence is not null and path is not null").groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("b"))
    lends = lends.select(F.col("folder").alias("above"), F.col("b.licence").alias("lent"), (-F.col("b.c")).alias("lent_cosine"), F.col("b.path").alias("lender"))
    levels = F.expr("transform(sequence(0, if(folder = '', 0, size(split(folder, '/')))), i -> struct(i as depth, array_join(slice(split(folder, '/'), 1, i), '/') as above))")
    folders = found.where("licence is null and path is not null").select("folder").distinct().select("folder", F.inline(levels))
    nearest = folders.join(lends, "above").groupBy("folder").agg(F.max_by(F.struct("lent", "lent_cosine", "lender"), "depth").alias("n"))
    joined = found.join(nearest, "folder", "left")
    own = F.col("licence").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("licence", "n.lent").alias("licence"),
        F.when(own, F.col("cosine")).otherwise(F.col("n.lent_cosine")).alias("cosine"),
        F.when(own, "own").when(F.col("n").isNotNull(), "inherited").alias("source"),
        F.when(~own, F.col("n.lender")).alias("inherited_from"),
    )


def with_paths(docs: DataFrame) -> DataFrame:
    """doc_id, text and a path of every document, and made-up licence files: the test table has neither.

    Source and language are the directories; every 25th document goes by the name LICENSE without being one.  Each source has a licence
    file with one of the standard texts, three in four of its languages another one (doc_id below 0).
    """
    i, where = F.col("doc_id"), F.concat_ws("/", "source", "lang")
    path = F.when(i % 500 == 0, F.concat_ws("/", "source", F.lit("LICENSE"))).when(i % 25 == 0, F.concat_ws("/", where, F.lit("LICENSE"))).otherwise(F.concat_ws("/", where, F.floor(i / 100).cast("string"), F.concat(i.cast("string"), F.lit(".txt"))))
    names = sorted(TEXTS)
    folders = docs.select(F.explode(F.array(F.struct(F.col("source").alias("folder"), F.lit(0).alias("deep")), F.struct(where.alias("folder"), F.lit(1).alias("deep")))).alias("f")).select("f.*").distinct()
    drawn = F.pmod(F.xxhash64("folder"), F.lit(4 * len(names)))
    full = F.element_at(F.array(*[F.lit(TEXTS[n]) for n in names]), (F.floor(drawn / 4) + 1).cast("int"))
    planted = folders.where((F.col("deep") == 0) | (drawn % 4 > 0)).select((-1 - F.pmod(F.xxhash64("folder"), F.lit(1 << 40))).alias("doc_id"), full.alias("text"), F.concat_ws("/", "folder", F.lit("COPYING")).alias("path"))
    return docs.select(i.cast("long").alias("doc_id"), "text", path.alias("path")).unionByName(planted)
