"""Operator 10 [native]: licence scans by sparse TF-IDF cosine, then nearest-ancestor inheritance.

DataFrame functions only. Templates are NOTICES (what headers say) and the whole texts of licences
(folder license_texts). A header is a line, or a paragraph (lines up to a blank one, comment signs
aside), with a cosine of HEADER or more with a notice. A licence file is one whose whole text has a
cosine of WHOLE or more with a licence's text, hence holds half of its weight at least, or one that
says nothing but a notice (SOLE). A notice counts only where all its MARKS occur: names and versions,
without which cosines of different licences are too close. A file without a header takes its own
licence text's, then that of the nearest directory above it, its own first, that has a licence file.

A word's weight is (1 + ln n) ln(1 + N / df), n its count in the unit, over all N texts; words that
no template has weigh (1 + ln n) ln(1 + N). Two tests save
expanding every text to words and lose nothing. A unit without the rarest mark of any notice has no
notice's marks. And a text that reaches WHOLE holds so many of a licence's heavier words at least,
by Cauchy and Schwarz. Templates are fixed and small, so they are broadcast.

Among several licence files of a directory the one with the largest cosine counts, then the least
path; among templates of equal cosine the least name. Defined cases: a null text has no header, a
null path no directory and inherits nothing; empty texts inherit; very long texts are one file like
any other; repeated rows repeat with equal results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import settle

HEADER, WHOLE, SOLE = 0.6, 0.7, 0.99
GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Licence, what its headers say, and the marks that must be among the words.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache 2"),
    ("Apache-2.0", "Apache License Version 2.0", "apache 2"),
    ("Apache-2.0 OR MIT", "Dual MIT/Apache-2.0", "mit apache 2"),
    ("Apache-2.0 OR MIT", "Dual licensed under the MIT license or the Apache License, Version 2.0", "mit apache 2"),
    ("Apache-2.0 OR MIT", "SPDX-License-Identifier: MIT OR Apache-2.0", "mit apache 2"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License.", "bsd 2"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd 3"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd style governed"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost 1"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution License CC BY 4.0.", "creative commons 4"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal.", "cc0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public 2"),
    ("GPL-2.0", "GNU General Public License, version 2", "gnu general public 2"),
    ("GPL-2.0", "This program " + GNU.format("General Public", 2), "gnu general public 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    ("GPL-3.0", "GNU General Public License, version 3", "gnu general public 3"),
    ("GPL-3.0", "This program " + GNU.format("General Public", 3), "gnu general public 3"),
    ("ISC", "Licensed under the ISC License.", "isc license"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1", "lesser 2 1"),
    ("LGPL-2.1", "This library " + GNU.format("Lesser General Public", 2.1), "lesser 2 1"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "lesser 3"),
    ("LGPL-3.0", "This library " + GNU.format("Lesser General Public", 3), "lesser 3"),
    ("MIT", "Released under the MIT License.", "mit license"),
    ("MIT", "Licensed under the MIT License.", "mit license"),
    ("MIT", "The MIT License (MIT)", "mit license"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "permission granted deal merge sublicense",
    ),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0.", "mozilla 2"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla 2"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    ("Zlib", "Licensed under the zlib License.", "zlib license"),
]
#: The short names that identifiers and plain statements use.
NAMES = "Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense Zlib".split()
for _name in NAMES:
    _marks = " ".join(re.findall("[0-9a-z]+", _name.lower()))
    NOTICES += [(_name, f"SPDX-License-Identifier: {_name}", f"spdx {_marks}"), (_name, f"License: {_name}", f"license {_marks}")]
    if " " in _marks:  # a single word says too little
        NOTICES.append((_name, _name, _marks))
    if "GPL" in _name:
        NOTICES += [(_name, f"SPDX-License-Identifier: {_name}-{more}", f"spdx {_marks}") for more in ("only", "or-later")]
#: What separates words: all but ASCII letters, digits and other letters; and what paragraphs.
BREAK = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
PARAGRAPH = r"\n[ \t\r/*#;%!-]*\n"
LINE = r"\r\n|\r|\n"
SALTS = 16


@functools.cache
def templates() -> list[tuple[str, bool, dict[str, int], frozenset[str]]]:
    """(licence, whether it is a whole text, word -> count, marks)."""
    words = lambda text: re.findall("[0-9a-z]+", text.lower())
    texts = [(p.stem, True, p.read_text(), "") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    out = []
    for name, whole, text, marks in [*((n, False, t, m) for n, t, m in NOTICES), *texts]:
        own = words(text)
        out.append((name, whole, {w: own.count(w) for w in set(own)}, frozenset(marks.split())))
    return out


def _words(text):
    return F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")


def _weights(words: dict[str, int], idf: dict[str, float]) -> dict[str, float]:
    """A template's unit vector, the heaviest words first."""
    raw = {w: (1 + math.log(n)) * idf[w] for w, n in words.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return dict(sorted(((w, x / norm) for w, x in raw.items()), key=lambda x: (-x[1], x[0])))


def rarest_marks(df: dict[str, int]) -> set[str]:
    """The rarest mark of each notice."""
    return {min(marks, key=lambda w: (df.get(w, 0), w)) for _, whole, _, marks in templates() if not whole}


def required(vectors: list[dict[str, float]], cosine: float, share: float = 0.8) -> tuple[set[str], int]:
    """(words, n): whatever reaches the cosine with a vector holds n of the words at least. They
    are the heaviest of each vector, up to a share of its weight."""
    words, least = set(), None
    for vector in vectors:
        heavy, total = [], 0.0
        for word, x in vector.items():
            if total >= share:
                break
            heavy.append(word)
            total += x * x
        words.update(heavy)
        # the words reached must weigh cosine ** 2, of which the others give 1 - total at most
        need, n = (cosine - 1e-6) ** 2 - (1 - total), 0
        for word in heavy:
            if need <= 0:
                break
            need -= vector[word] ** 2
            n += 1
        least = n if least is None else min(least, n)
    return words, least or 0


def _cosines(units: DataFrame, key: list[str], idf: DataFrame, vectors: DataFrame, other: float) -> DataFrame:
    """units: key and words. key, license, whole, score for each template whose marks all occur."""
    counts = units.select(*key, F.explode("words").alias("word")).groupBy(*key, "word").agg(F.count("*").alias("tf"))
    weighed = counts.join(F.broadcast(idf), "word", "left").withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(other)))
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors), "word").groupBy(*key, "template", "license", "whole", "marks").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"), F.sum("mark").alias("marked"))
    return dots.where("marked = marks").join(norms, key).select(*key, "license", "whole", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))


def _best(scores: DataFrame, name: str) -> DataFrame:
    best = scores.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("file", F.col("b.license").alias(f"{name}_license"), (-F.col("b.s")).alias(f"{name}_score"))


def scan(files: DataFrame, key_col="key", path_col="path", text_col="text") -> DataFrame:
    """key, path, header_license, header_score, file_license, inherited_license, inherited_from,
    license (the first of these three that there is)."""
    spark = files.sparkSession
    own = files.select(F.col(key_col).alias("key"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    vocabulary = sorted({w for _, _, words, _ in templates() for w in words})

    # statistics of all texts: at most one row for each word of the templates, and the count of texts
    known = F.broadcast(spark.createDataFrame([(w,) for w in [*vocabulary, ""]], "word string"))
    df = own.where("text IS NOT NULL").select(F.explode(F.array_append(F.array_distinct(_words("text")), F.lit(""))).alias("word")).join(known, "word")
    df = {r.word: r.df for r in df.groupBy("word").agg(F.count("*").alias("df")).collect()}
    total = df.get("", 0)
    other = math.log(1 + max(1, total))
    idf = {w: math.log(1 + total / max(1, df.get(w, 0))) if total else 1.0 for w in vocabulary}
    vectors = [_weights(words, idf) for _, _, words, _ in templates()]
    idf_table = spark.createDataFrame(sorted(idf.items()), "word string, idf double")
    rows = [(i, name, whole, len(marks), w, x, int(w in marks)) for i, ((name, whole, _, marks), vector) in enumerate(zip(templates(), vectors)) for w, x in vector.items()]
    vector_table = spark.createDataFrame(rows, "template int, license string, whole boolean, marks int, word string, unit double, mark int")

    texts = [v for (_, whole, _, _), v in zip(templates(), vectors) if whole]
    leads = F.array(*map(F.lit, sorted(rarest_marks(df))))
    heavy, n = required(texts, WHOLE)
    heavy = F.array(*map(F.lit, sorted(heavy)))
    # one look at the words of a text; equal texts under one key and path are one file
    signs = F.transform(F.array(_words("text")), lambda w: F.struct(F.arrays_overlap(w, leads).alias("lead"), (F.size(F.array_intersect(heavy, w)) >= n).alias("whole")))[0]
    candidates = own.where("text IS NOT NULL").withColumn("sign", signs).where("sign.lead OR sign.whole").distinct()
    candidates = settle(candidates.withColumn("file", F.monotonically_increasing_id()), "candidates")
    lines = candidates.where("sign.lead").select("file", F.posexplode(F.split("text", LINE)).alias("unit", "said"))
    paragraphs = candidates.where("sign.lead").select("file", F.posexplode(F.split("text", PARAGRAPH)).alias("unit", "said")).withColumn("unit", -1 - F.col("unit"))
    units = lines.unionByName(paragraphs).select("file", F.col("unit").alias("no"), _words("said").alias("words")).where(F.arrays_overlap("words", leads))
    headers = _best(_cosines(units, ["file", "no"], idf_table, vector_table.where("NOT whole"), other).where(F.col("score") >= HEADER), "header")
    whole = _cosines(candidates.select("file", _words("text").alias("words")), ["file"], idf_table, vector_table, other)
    whole = _best(whole.where(F.when(F.col("whole"), F.col("score") >= WHOLE).otherwise(F.col("score") >= SOLE)), "file")
    found = candidates.join(headers, "file", "left").join(whole, "file", "left").where("header_license IS NOT NULL OR file_license IS NOT NULL")
    found = settle(found.select("key", "path", F.sha2("text", 256).alias("sha"), "header_license", "header_score", "file_license", "file_score"), "found")

    # directories: each different one once, whatever it holds
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    licensed = found.where("file_license IS NOT NULL AND path IS NOT NULL").select(parent.alias("dir"), "path", "file_license", "file_score")
    licensed = licensed.groupBy("dir").agg(F.min(F.struct((-F.col("file_score")).alias("s"), "path", "file_license")).alias("b")).select(F.col("dir").alias("above"), F.col("b.file_license").alias("inherited_license"), F.col("b.path").alias("inherited_from"))
    steps = F.split("dir", "/")
    dirs = own.where("path IS NOT NULL").select(parent.alias("dir")).distinct()
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, 1, i), "/").alias("above")))).alias("a")).select("dir", "a.depth", "a.above").distinct()
    nearest = above.join(licensed, "above").groupBy("dir").agg(F.max_by(F.struct("inherited_license", "inherited_from"), "depth").alias("n")).select("dir", "n.*")

    # a directory with a licence may hold a third of all files: its one row is repeated for each salt
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = own.select("key", "path", parent.alias("dir"), F.sha2("text", 256).alias("sha"), F.pmod(F.xxhash64("key", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = rows.join(salted, ["dir", "salt"], "left")
    own_found = found.select(F.col("key").alias("fk"), F.col("path").alias("fp"), F.col("sha").alias("fs"), "header_license", "header_score", "file_license")
    rows = rows.join(own_found, F.col("key").eqNullSafe(F.col("fk")) & F.col("path").eqNullSafe(F.col("fp")) & F.col("sha").eqNullSafe(F.col("fs")), "left")
    return rows.select("key", "path", "header_license", "header_score", "file_license", "inherited_license", "inherited_from", F.coalesce("header_license", "file_license", "inherited_license").alias("license"))


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree: source/lang/hundreds/id.txt."""
    none = F.lit("_")
    folder = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat(F.coalesce("source", none), F.lit("/"), F.coalesce("lang", none), F.lit("/"), folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("key"), path.alias("path"), "text")
