import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rollbook.llm import toxicity as tx


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return own.unionByName(spark.createDataFrame([(None, 1, 1), (9004, 1, None)], own.schema))


@pytest.fixture(scope="module")
def model(docs):
    return tx.language_model(docs)


def test_counts_follow_every_text(spark):
    docs = spark.createDataFrame([("abc",), (None,), ("ABC é",)], "text string")
    counts = {r.trigram: r.n for r in tx.trigram_counts(docs).collect()}
    assert counts[1 * 784 + 2 * 28 + 3] == 2
    assert sum(counts.values()) == (3 + 2) + 2 + (5 + 2)


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("tr@sh", "trash"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("l-o-s-e-r", "loser"), ("trrrrash", "trash"), ("plain", "plain"), ("m0r0n,", "moron")])
def test_restores(model, token, word):
    assert word in tx.readings(token, model)


def test_viterbi_is_the_best_path(model):
    """Against all paths of a small lattice."""
    from itertools import product

    def best(token):
        scored = []
        for path in product(*tx.lattice(token)):
            x = y = 0
            p = 0.0
            for text, cost in path:
                p += cost
                if not text:
                    continue
                z = tx._symbol(text)
                if z == 0 and y == 0:
                    continue
                p += float(model[x, y, z])
                x, y = y, z
            scored.append((p + float(model[x, y, 0]), " ".join("".join(t for t, _ in path).split())))
        return max(scored)[1]

    for token in ("1d10t", "a-b", "t0.o", "3x!", "aaab", "7h1s"):
        assert tx.restore(token, model) == best(token)


def brute_learn(rows, model):
    """rows: (text, toxic). Evidence by plain counting: p of features, the base rate."""
    p, of = {}, lambda w: max((p.get(f, 0) for kind in tx.KINDS for f in tx.features(w, kind)), default=0)
    said = [(tx._family(text), toxic, [w for t in {*text.split(), *tx._SPACED.findall(text)} for w in tx.readings(t, model)]) for text, toxic in rows]
    for kind in tx.KINDS:
        families, holders = {}, {}
        for family, toxic, words in said:
            own = {f for w in words if not of(w) for f in tx.features(w, kind)}
            families.setdefault((family, toxic), set()).update(map(tx.bucket, own))
            for f in own if toxic else ():
                holders[f] = holders.get(f, 0) + 1
        counts = {0: Counter(), 1: Counter()}
        for (_, toxic), own in families.items():
            counts[toxic].update(own)
        low = {}
        for b, t in counts[1].items():
            n = t + counts[0][b]
            x = (t / n + tx.Z2 / (2 * n) - math.sqrt(tx.Z2 * t / n * (1 - t / n) / n + (tx.Z2 / (2 * n)) ** 2)) / (1 + tx.Z2 / n)
            if x >= tx.LEAST:
                low[b] = x
        fills = {}
        for f, n in holders.items():
            if tx.bucket(f) in low:
                fills[tx.bucket(f)] = max(fills.get(tx.bucket(f), (0, "")), (n, f))
        p |= {f: low[b] for b, (_, f) in fills.items()}
    return p, sum(t for _, t in rows) / len(rows)


def test_against_brute_force(spark, docs, labels):
    """Evidence by plain counting, and every token of every text restored for itself."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(docs.where("doc_id > 9000"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").unionByName(labels.where("doc_id > 9000 or doc_id is null"))
    model, toxic = tx.language_model(docs), {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)
    own = docs.collect()
    p, base = brute_learn([(r.text or "", toxic[r.doc_id]) for r in own if r.doc_id in toxic], model)
    learned = tx.learn(docs, labels).p
    assert p and learned.keys() == p.keys()
    assert all(learned[f] == pytest.approx(x) for f, x in p.items())
    got = {}
    for r in tx.scores(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in own:
        best = {}
        for token in {*(r.text or "").split(), *tx._SPACED.findall(r.text or "")}:
            for w in tx.readings(token, model):
                best[w] = max((p.get(f, 0) for kind in tx.KINDS for f in tx.features(w, kind)), default=0)
        want = 1 - (1 - 0.1 * base) * math.prod(1 - x for x in best.values())
        assert all(g.score == pytest.approx(want) and g.predicted == (want >= 0.7) for g in got[r.doc_id])


def test_pieces_do_not_matter(model, monkeypatch):
    evidence = tx.Evidence(model)
    evidence.p = {"=idiot": 0.6, "=trash": 0.5}
    text = "a fine day with tr@sh and more to say " * 20 + "you i d i o t of them " + "in the end " * 50
    whole, family = tx.Scorer(evidence).score(text), tx._family(text)
    for size in (30, 100, 333):
        monkeypatch.setattr(tx, "PIECE", size)
        assert tx.Scorer(evidence).score(text) == whole > 0.75 and tx._family(text) == family
    assert tx.readings("x" * 5000, model) and tx._family("") == tx._family(" ")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    toxic = [r for r in rows if r.toxic == 1]
    wrong = sum(r.predicted for r in rows if r.toxic == 0)
    assert sum(r.predicted for r in toxic) > 0.9 * len(toxic) and wrong <= 0.01 * len(rows)


def test_awkward_rows(docs, labels, empty, clashing):
    rows = tx.scores(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert tx.scores(empty, labels).collect() == []
    none = tx.scores(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    kept = tx.drop_toxic(clashing, labels)
    assert kept.columns == clashing.columns and 0 < kept.count() <= clashing.count()
