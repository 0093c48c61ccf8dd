import functools
import hashlib
import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import decontaminate as dc


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@functools.cache
def known(text, items):
    return brute(text, items)


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, its in items:
        w = words(its)
        windows = {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
        for x in windows:
            for i in range(len(own) - len(x) + 1):
                if tuple(own[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    found.add(item)
    sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(own), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(own)


@pytest.fixture(scope="module")
def bench(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(100, "the of, that"), (101, ""), (102, None), (None, "the of that"), (103, "one TWO"), (100, "de la"), (104, "word")]
    return own.unionByName(spark.createDataFrame(rows, own.schema))


@pytest.mark.parametrize("block_words, piece_words", [(1 << 19, 1 << 16), (900, 1 << 16), (2000, 20)])
def test_against_brute_force(docs, bench, block_words, piece_words, monkeypatch):
    """In one pass, in several, and with items in pieces."""
    monkeypatch.setattr(dc, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(dc, "PIECE_WORDS", piece_words)
    items = [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None and r.text]
    got = {r.doc_id: r for r in dc.contamination(docs, bench).collect()}
    rows = docs.where("length(text) < 6000 or text is null").collect()
    for r in rows:
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == known(r.text, tuple(items))
    assert any(g.contaminated for g in got.values()) and len(got) >= len(rows) - 1


def test_index_finds_every_occurrence():
    rng = random.Random(2)
    symbols = np.array([rng.choice([0, 1, 1, 2, 3]) for _ in range(2000)] + [0])
    index = dc.FMIndex(symbols, 3)
    for size in (1, 2, 5, 9):
        for _ in range(30):
            p = [rng.choice([1, 1, 2, 3]) for _ in range(size)]
            low, high = index.search(np.array([p]), np.array([size]))
            got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert got == [i for i in range(len(symbols) - size + 1) if symbols[i : i + size].tolist() == p]


def test_pieces_of_long_texts(monkeypatch):
    """Documents and items in pieces give what they give whole."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["a", "bb", "c,", "D"]) for _ in range(3000)).encode()
    items = [(i, " ".join(rng.choice(["a", "bb", "c", "d"]) for _ in range(n)).encode()) for i, n in enumerate([3, 5, 13, 14, 40])] + [(9, b" ".join(dc.split_words(text)[100:160]))]

    def scanned():
        batch = pa.RecordBatch.from_pydict({"text": [text.decode()], "n_words": [0], "spans": [[]], "items": [[]]})
        return next(dc._scan(dc.Block(items), 13, False).__wrapped__(iter([batch]))).to_pylist()[0]

    whole = scanned()
    assert whole["n_words"] == 3000 and {0, 9} <= set(whole["items"])
    for size in (64, 500, 2999):
        monkeypatch.setattr(dc, "PIECE_BYTES", size)
        got = scanned()
        assert (got["n_words"], got["spans"], got["items"]) == (whole["n_words"], whole["spans"], whole["items"])


def test_a_block_is_small():
    """What goes to the tasks is of the size of the text."""
    rng = random.Random(4)
    pieces = [(i, " ".join(f"word{rng.randrange(50000)}" for _ in range(300)).encode()) for i in range(1000)]
    assert len(pickle.dumps(dc.Block(pieces))) < 1.2 * sum(len(t) for _, t in pieces)


def test_cut_spans():
    assert dc.cut_spans("One, two three. Four!", [(1, 3)]) == "One, . Four!"


def test_empty_and_clashing(empty, clashing, bench):
    assert dc.contamination(empty, bench).collect() == []
    assert not any(r.contaminated for r in dc.contamination(clashing, bench.limit(0)).collect())
    kept = dc.drop_contaminated(clashing, bench)
    assert kept.columns == clashing.columns and 0 < kept.count() < clashing.count()
