import math
import re
from collections import Counter
from pathlib import Path

import pytest

from rollbook.llm import licenses as lc

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall(text.lower())


def brute(files):
    if not files:
        return []
    texts = [t for _, _, t in files if t is not None]
    df = Counter(w for t in texts for w in set(words(t)))
    n = len(texts)
    vocabulary = {w for _, _, own, _ in lc.templates() for w in own}
    idf = lambda w: (math.log(1 + n / max(1, df[w])) if n else 1.0) if w in vocabulary else math.log(1 + max(1, n))

    def vector(counts):
        v = {w: (1 + math.log(c)) * idf(w) for w, c in counts.items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    known = [(name, whole, marks, *vector(own)) for name, whole, own, marks in lc.templates()]

    def best(text, least):
        v, norm = vector(Counter(words(text)))
        found = [(-round(sum(x * u.get(w, 0) for w, x in v.items()) / norm / size, 6), name, whole) for name, whole, marks, u, size in known if norm and marks <= v.keys()]
        return min(((s, name) for s, name, whole in found if -s >= least[whole]), default=None)

    header, whole = {}, {}
    for i, (_, _, t) in enumerate(files):
        if t is not None:
            found = [best(unit, (lc.HEADER, 9)) for unit in [*re.split(lc.LINE, t), *re.split(lc.PARAGRAPH, t)]]
            header[i] = min(filter(None, found), default=None)
            whole[i] = best(t, (lc.SOLE, lc.WHOLE))
    folders = {}
    for i, hit in whole.items():
        if hit and files[i][1] is not None:
            d = files[i][1].rpartition("/")[0]
            folders[d] = min(folders.get(d, (1,)), (hit[0], files[i][1], hit[1]))
    out = []
    for i, (key, path, _) in enumerate(files):
        near = None
        if path is not None:
            steps = path.split("/")[:-1]
            near = next((folders["/".join(steps[:k])] for k in range(len(steps), -1, -1) if "/".join(steps[:k]) in folders), None)
        h, w, inherited = header.get(i), whole.get(i), near and near[2]
        out.append((key, path, h and h[1], h and -h[0], w and w[1], inherited, near and near[1], (h and h[1]) or (w and w[1]) or inherited))
    return out


def check(spark, files):
    got = lc.scan(spark.createDataFrame(files, "key long, path string, text string").selectExpr("*", "'clash' as license", "'clash' as file", "'clash' as word"))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(got.collect()) == order(brute(files))


def test_tree(spark):
    prose = "the first of many words that stand in a text of some length\nand go on\n"
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.txt", prose),
        (3, "a/b/y.txt", prose + "Licensed under the Apache License, Version 2.0.\r\nend"),
        (4, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3.\n\n"),
        (5, "a/b/c/d/z.txt", None),
        (6, "z.txt", ""),
        (7, None, "Licensed under CC BY-NC 4.0."),
        (8, "q/r.txt", "we licensed " + "word " * 20000),
        (9, "a/b/OTHER", "Released under the MIT License."),
        (2, "a/b/c/x.txt", prose),
        (None, "a/n.txt", prose),
    ]
    check(spark, files)
    check(spark, files[5:6])
    check(spark, [])


def text_of(name):
    return (Path(lc.__file__).parent / "license_texts" / f"{name}.txt").read_text()


COMMENTED = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() { return 0; }
"""
#: path, text, header, licence of the file itself, licence
GOLDEN = [
    ("mit/LICENSE", text_of("MIT").replace("<year> <copyright holders>", "2021 A. N. Other"), "MIT", "MIT", "MIT"),
    ("mit/src/deep/a.c", "int main() { return 0; }", None, None, "MIT"),
    ("mit/src/b.py", "# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0", None, "Apache-2.0"),
    ("mit/src/c.c", COMMENTED, "Apache-2.0", None, "Apache-2.0"),
    ("mit/src/d.c", 'Licensed under the Apache License, Version 2.0 (the "License");\nprint(call(one, two, three, four, five, six, seven))', "Apache-2.0", None, "Apache-2.0"),
    ("mit/src/e.c", "void f();", None, None, "MIT"),
    ("notice/notice.txt", text_of("MIT").split("\n\n")[2], "MIT", "MIT", "MIT"),
    ("gpl3/COPYING", text_of("GPL-3.0"), "GPL-3.0", "GPL-3.0", "GPL-3.0"),
    ("gpl3/head.txt", "\n".join(text_of("GPL-3.0").split("\n")[:12]) + "\n\nand the story goes on in quite another way, as stories do", "GPL-3.0", None, "GPL-3.0"),
    ("gpl2/COPYING", text_of("GPL-2.0"), "GPL-2.0", "GPL-2.0", "GPL-2.0"),
    ("apache/LICENSE.txt", text_of("Apache-2.0"), "Apache-2.0", "Apache-2.0", "Apache-2.0"),
    ("bsd2/LICENSE", text_of("BSD-2-Clause"), None, "BSD-2-Clause", "BSD-2-Clause"),
    ("bsd3/LICENSE", text_of("BSD-3-Clause"), None, "BSD-3-Clause", "BSD-3-Clause"),
    ("mpl/LICENSE", text_of("MPL-2.0"), "MPL-2.0", "MPL-2.0", "MPL-2.0"),
    ("cc/a.md", "CC BY-SA 4.0\nsome prose", "CC-BY-SA-4.0", None, "CC-BY-SA-4.0"),
    ("dual/a.rs", "// Dual MIT/Apache-2.0\nfn main() {}", "Apache-2.0 OR MIT", None, "Apache-2.0 OR MIT"),
    ("gnu/a.py", "# SPDX-License-Identifier: GPL-2.0-or-later\nimport os", "GPL-2.0", None, "GPL-2.0"),
    ("gnu/b.py", "This program " + lc.GNU.format("General Public", 3) + "\n\nimport os", "GPL-3.0", None, "GPL-3.0"),
    ("odd/a.py", "SPDX-License-Identifier: Foo-1.0\nimport os", None, None, None),
    ("odd/b.py", "the work of the public is free, and under the terms of general version", None, None, None),
]


def test_licences_told_apart(spark):
    prose = "a story of old men who went to sea in ships and came home late; the sun was low over the general store"
    files = [(i, path, text) for i, (path, text, *_) in enumerate(GOLDEN)] + [(100 + i, f"story/{i}", prose + f" {i}") for i in range(60)]
    got = {r.path: (r.header_license, r.file_license, r.license) for r in lc.scan(spark.createDataFrame(files, "key long, path string, text string")).collect()}
    for path, _, header, own, license in GOLDEN:
        assert got[path][1:] == (own, license), path
        assert header is None or got[path][0] == header, path
    assert all(got[f"story/{i}"] == (None, None, None) for i in range(60))
    check(spark, files)


def test_bounds_lose_nothing():
    """No text without enough heavy words can reach the threshold, no unit without a mark a notice's."""
    idf = {w: 1.0 + len(w) for _, _, own, _ in lc.templates() for w in own}
    rare = lc.rarest_marks({"license": 5, "mit": 9, "2": 100})
    assert all(marks & rare and marks <= own.keys() for _, whole, own, marks in lc.templates() if not whole) and "mit" not in rare
    vectors = [lc._weights(own, idf) for _, whole, own, _ in lc.templates() if whole]
    heavy, n = lc.required(vectors, 0.7)
    for v in vectors:  # the best that n - 1 heavy words and all others can give
        best = sorted((x * x for w, x in v.items() if w in heavy), reverse=True)[: n - 1]
        assert n > 0 and sum(best) + sum(x * x for w, x in v.items() if w not in heavy) < 0.7**2


def test_documents(spark, docs):
    rows = [tuple(r) for r in lc.document_paths(docs.where("length(text) < 5000 or text is null")).collect()]
    check(spark, rows)


def test_plan_has_no_python(spark, docs):
    plan = lc.scan(lc.document_paths(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
