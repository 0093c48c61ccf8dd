"""Operators 1 and 2 against the tokenizers library."""

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rollbook.llm import bpe_codec, token_files, word_encoder
from rollbook.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_token_files(docs, clashing, empty, library, monkeypatch):
    monkeypatch.setattr(token_files, "CONTAINER_DOCUMENTS", 17)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    want, start = [], 0
    for r in rows:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.token_files(clashing, tokenizer_path()).collect())) == want
    assert token_files.token_files(empty, tokenizer_path()).collect() == []


def test_random_access_and_the_dictionary(docs, library):
    containers, dictionary = token_files.write_token_files(docs, tokenizer_path())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    seen = []
    for row in containers.orderBy("part", "seq").collect():
        box = token_files.Container(bytes(row.blob), dictionary)
        for i in (0, len(box) - 1):
            assert box.tokens(i).tolist() == [*library.encode(texts[box.doc_ids[i]], add_special_tokens=False).ids, 1]
        seen += box.doc_ids.tolist()
        with pytest.raises(ValueError):
            token_files.Container(bytes(row.blob), b"another")
    assert dictionary and seen == sorted(r.doc_id for r in docs.collect())


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "c"), (None, None)], "doc_id long, text string")
    got = token_files.token_files(df, tokenizer_path()).collect()
    assert sorted((r.doc_id is not None, r.start) for r in got)[-1] == (True, 4) and len(got) == 3


def test_bpe_codec(docs, clashing, empty, library):
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe_codec.digests(clashing, tokenizer_path()).collect())) == sorted(want)
    assert bpe_codec.digests(empty, tokenizer_path()).collect() == []
    r = bpe_codec.encode_documents(docs.where("doc_id = 9007"), tokenizer_path()).first()
    assert r.decoded == "one</w> two</w>" and len(r.ids) == 8


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_joins_are_repaired(library, bits, monkeypatch):
    monkeypatch.setattr(bpe_codec, "MASK_BITS", bits)
    rng = np.random.default_rng(bits)
    pieces = ["ab", " ", "\n", "é", "İ", "'s", ".", ",", "0", "x" * 30, "<|endoftext|>", "é", " ", "日本", "\t", "H̱", "it's"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 60))) for _ in range(300)]
    own = bpe_codec.BpeCodec(tokenizer_path())
    for text, ids in zip(texts, own.encode([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


ADDED = ["<|endoftext|>", "<|startoftext|>"]
SPELLED = [f(t) for t in ADDED for f in (str, str.upper, str.title, lambda t: t.replace("end", "End"), lambda t: t[:7] + " " + t[7:], lambda t: t[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*SPELLED, " ", "\n", ".", ",", "a", "Ab.", "<|", "|>", "é", "İ", "0", "'s", "\u0301", "\u00a0"]), max_size=12).map("".join))
def test_added_tokens_in_any_case(text):
    library, words, own = _coders()
    want = library.encode(text, add_special_tokens=False).ids
    assert words.encode(pa.array([text]))[0].tolist() == want
    ids = own.encode([text.encode()])[0]
    assert ids.tolist() == want
    assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


@functools.cache
def _coders():
    return Tokenizer.from_file(tokenizer_path()), word_encoder.WordEncoder(tokenizer_path()), bpe_codec.BpeCodec(tokenizer_path())


@pytest.mark.parametrize("token", SPELLED)
def test_added_tokens_alone_and_glued(token):
    library, words, own = _coders()
    for text in (token, f"x {token} y", f"A.{token}b", f"{token}{token.upper()}", f"ab{token}, {token}."):
        want = library.encode(text, add_special_tokens=False).ids
        assert words.encode(pa.array([text]))[0].tolist() == want and own.encode([text.encode()])[0].tolist() == want


def test_joins_are_checked(library, monkeypatch):
    """A chunk whose ids were wrong beside a join does not go through."""
    monkeypatch.setattr(bpe_codec, "MASK_BITS", 4)
    own = bpe_codec.BpeCodec(tokenizer_path())
    text = b"the quick brown fox jumps over the lazy dog and runs away from it all " * 3
    own.encode([text])
    own.memo = {c: (h, i if i is None else i + 1, t, x) for c, (h, i, t, x) in own.memo.items()}
    with pytest.raises(ValueError):
        own.encode([text])


def test_shared_passages_are_shared_chunks():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 122, 40_000).astype(np.uint8)
    a, b = (np.concatenate((rng.integers(97, 122, n).astype(np.uint8), shared)) for n in (500, 777))
    chunks = [set(x[i:j].tobytes() for i, j in zip(bpe_codec.cuts(x)[:-1], bpe_codec.cuts(x)[1:])) for x in (a, b)]
    assert len(chunks[0] & chunks[1]) >= 0.9 * min(map(len, chunks))
