import math
import zlib
from collections import Counter

import numpy as np

from rollbook.llm import language as lg


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 8, 40):
        code = lg.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
        for i in range(n):
            for j in range(i):
                assert (code[i] != code[j]).any()


def test_counts_do_not_depend_on_the_cut(monkeypatch):
    text = ("Der erste Satz, é à la carte. " * 50).encode()
    whole = lg.gram_counts([text])
    monkeypatch.setattr(lg, "CHUNK", 100)
    assert (lg.gram_counts([text]) == whole).all()


def brute_counts(text):
    """Hashed n-grams, one at a time."""
    raw = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in b" " + text.encode() + b" "]
    counts = Counter()
    for order in lg.ORDERS:
        for i in range(len(raw) - order + 1):
            h = 0
            for c in raw[i : i + order]:
                h = (h * 0x9E3779B1 + c) % 2**32
            if order > 1 or raw[i] != 32:
                counts[(((h ^ h >> 15) * 0x85EBCA6B) % 2**32 >> 19) % lg.BUCKETS] += 1
    return counts


def test_against_brute_force(docs):
    """Every text by plain counting, the margin of each bit and the loss of each codeword."""
    book = lg.learn(docs)
    rows = docs.where("length(text) < 3000 or text is null").collect()
    got = {r.doc_id: r for r in lg.identify(docs).collect()}
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        counts = brute_counts(r.text)
        total = sum(counts.values())
        margins = [sum(math.sqrt(n / total) * float(book.weights[b, j]) for b, n in counts.items()) + float(book.bias[j]) for j in range(book.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margins, word)) for word in book.code.tolist()]
        likely = [math.exp(-x) for x in loss]
        assert got[r.doc_id].lang_pred == book.languages[loss.index(min(loss))]
        assert abs(got[r.doc_id].score - max(likely) / sum(likely)) < 1e-4


def test_many_languages(spark, monkeypatch):
    """Hundreds of languages, and a sample that is held in several matrices: the same fit."""
    rng = np.random.default_rng(3)
    words = {f"l{i:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)] for i in range(330)}
    rows = [(n, " ".join(rng.choice(own, 12)), lang) for n, (lang, own) in enumerate((x for x in words.items() for _ in range(4)), 1)]
    got = lg.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {n: lang for n, _, lang in rows}
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.9 * len(got)
    few = [(np.flatnonzero(c), c[np.flatnonzero(c)]) for c in lg.gram_counts([t.encode() for _, t, _ in rows[:60]])]
    own = np.arange(60) // 20
    whole = lg.fit(few, own, ["a", "b", "c"])
    monkeypatch.setattr(lg, "DENSE_ROWS", 7)
    assert np.allclose(lg.fit(few, own, ["a", "b", "c"]).weights, whole.weights, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = lg.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark, docs, empty, clashing):
    rows = lg.identify(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert (r.lang_pred == "und") == (r.doc_id in (9001, 9002, 9006))
    assert lg.identify(empty).collect() == []
    assert {r.lang_pred for r in lg.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert lg.identify(clashing).count() == clashing.count()


def test_one_language(spark):
    docs = spark.createDataFrame([(i, f"ab{i} cd", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in lg.identify(docs).collect()} == {"en"}
