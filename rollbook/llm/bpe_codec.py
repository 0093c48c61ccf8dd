"""Operator 2: BPE encoding by content-defined chunks, and decoding.

A rolling hash over a window of bytes cuts texts into chunks wherever its low bits are zero, so
passages that documents share give the same chunks; a chunk is encoded once and its ids reused
(within a Python worker, up to MEMO_BYTES of chunks; then the memory starts anew). A cut may fall
inside a word. Each join is repaired by re-encoding the span from the last white space of the left
chunk to the first of the right one, extended over further chunks while one holds no white space.
With it a word of either chunk is encoded again; a join stands if the library gives these words the
ids that their chunks have. While it does not, the span grows to twice as many words, at last to
all of both chunks (if they disagree even then, the tokenizer is refused). Chunks are not shared between workers: their texts and ids would
have to be shuffled.

Defined cases: a null text counts as empty (no ids, empty decoding); repeated rows repeat; other
columns are left out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollbook.llm.common import byte_slices, mapped, remembered, texts_of
from rollbook.llm.word_encoder import CODER_BYTES, encoder

#: Chunks have 2 ** MASK_BITS bytes on average; the rolling window has WINDOW.
MASK_BITS, WINDOW = 10, 16
MEMO_BYTES = 16 << 20
_SPACE = re.compile(rb"[\t\n\v\f\r ]")
#: A fixed pseudo-random word for each byte value.
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions before which a chunk ends, never inside a UTF-8 sequence."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    width = 1
    while width < WINDOW:  # h covers `width` bytes: doubled by adding itself shifted
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    at = np.flatnonzero((h >> np.uint32(WINDOW)) & np.uint32((1 << MASK_BITS) - 1) == 0) + 1
    at = at[(at >= WINDOW) & (at < len(data))]
    return at[(data[at] & 0xC0) != 0x80]


def _last_words(text: bytes, k: int) -> bytes:
    """The last k words; all of the text if it has no more."""
    words = text.rsplit(None, k)
    return b" ".join(words[-k:]) if len(words) > k else text


def _first_words(text: bytes, k: int) -> bytes:
    words = text.split(None, k)
    return b" ".join(words[:k]) if len(words) > k else text


class BpeCodec:
    def __init__(self, path: str):
        self.words = encoder(path)
        vocab = self.words.library.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = token.encode()
        if self.words.library.decoder is not None:
            raise ValueError("decoding is for tokenizers without a decoder of their own: tokens joined by spaces")
        self.memo: dict[bytes, tuple] = {}
        self.memo_bytes = 0

    def _learn(self, chunks: list[bytes]):
        """Encode new chunks: text before the first white space, ids and text between, text after
        the last."""
        if self.memo_bytes > MEMO_BYTES:
            self.memo, self.memo_bytes = {}, 0
        chunks = [c for c in dict.fromkeys(chunks) if c not in self.memo]
        inner, ends = [], []
        for c in chunks:
            first = _SPACE.search(c)
            if first is None:
                self.memo[c] = (c, None, b"", b"")
                continue
            last = max(c.rfind(s) for s in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            inner.append(c[first.start() : last])
            ends.append((c, c[: first.start()], c[last + 1 :]))
        for (c, head, tail), ids in zip(ends, self.words.encode(pa.array(inner, pa.large_binary()).cast(pa.large_string()))):
            self.memo[c] = (head, ids.copy(), tail, c[len(head) : len(c) - len(tail)])
        self.memo_bytes += sum(map(len, chunks)) * 4

    def _own(self, spans: list[bytes]) -> list[np.ndarray]:
        """The library's ids of spans, without memory."""
        return [np.array(x, np.uint32) for x in self.words._library([s.decode() for s in spans])]

    def _joined(self, left: list, word: list[bytes], right: list) -> list[np.ndarray]:
        """left and right: (ids, text) of the chunks beside each join (empty at an end of the text);
        word: what stands between. The ids of the joins, in agreement with those of the chunks."""
        out: list = [None] * len(word)
        open_, k = list(range(len(word))), 1
        while open_:
            before = [_last_words(left[i][1], k) for i in open_]
            after = [_first_words(right[i][1], k) for i in open_]
            sizes = [len(x) for x in self.words.encode(pa.array([*before, *after], pa.large_binary()).cast(pa.large_string()))]
            again = []
            for at, (i, ids) in enumerate(zip(open_, self._own([b"%b %b %b" % x for x in zip(before, (word[j] for j in open_), after)]))):
                a, b = sizes[at], sizes[len(open_) + at]
                same = np.array_equal(ids[:a], left[i][0][len(left[i][0]) - a :]) and np.array_equal(ids[len(ids) - b :], right[i][0][:b])
                if same and a + b <= len(ids):
                    out[i] = ids[a : len(ids) - b]
                elif before[at] != left[i][1] or after[at] != right[i][1]:
                    again.append(i)
                else:
                    raise ValueError("this tokenizer's ids depend on more than the chunks beside a join")
            open_, k = again, 2 * k
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([0, *map(len, texts)])
        inside = cuts(data)
        whole, plans, new = data.tobytes(), [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = inside[np.searchsorted(inside, a, "right") : np.searchsorted(inside, b, "left")].tolist()
            plan = [whole[x:y] for x, y in zip([a, *own], [*own, b])]
            plans.append(plan)
            new += plan
        self._learn(new)
        # the joins: word fragments that end one chunk and begin the next, between what is encoded
        nothing = (np.zeros(0, np.uint32), b"")
        joints, left, right, runs = [], [], [], []
        for plan in plans:
            run, open_word, last = [], b"", nothing
            for chunk in plan:
                head, ids, tail, inner = self.memo[chunk]
                open_word += head
                if ids is None:
                    continue
                if open_word:
                    run.append(len(joints))
                    joints.append(open_word)
                    left.append(last)
                    right.append((ids, inner))
                run.append(ids)
                open_word, last = tail, (ids, inner)
            if open_word:
                run.append(len(joints))
                joints.append(open_word)
                left.append(last)
                right.append(nothing)
            runs.append(run)
        mended = self._joined(left, joints, right)
        return [np.concatenate([nothing[0], *(mended[x] if isinstance(x, int) else x for x in run)]) for run in runs]

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.pieces.__getitem__, ids.tolist()))


def codec(path: str) -> BpeCodec:
    return remembered("words", ("codec", path), lambda: BpeCodec(path))


def _coded(path: str, batch, text_col: str):
    """(ids, decoded UTF-8) of each text of a batch."""
    texts, own = texts_of(batch, text_col), codec(path)
    for a, b in byte_slices(texts, CODER_BYTES):
        for ids in own.encode(texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()):
            yield ids, own.decode(ids)


def encode_documents(docs: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and the decoded text."""

    def run(batches):
        for batch in batches:
            got = list(_coded(path, batch, text_col))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), pa.array([x.astype("<u4").tobytes() for x, _ in got], pa.binary()), pa.array([d for _, d in got], pa.binary()).cast(pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return mapped(docs.select(id_col, text_col), run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str, id_col="doc_id", text_col="text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for."""

    def run(batches):
        for batch in batches:
            n, ids_hex, text_hex, all_ids = [], [], [], []
            for ids, decoded in _coded(path, batch, text_col):
                raw = ids.astype("<u4").tobytes()
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(raw).hexdigest())
                text_hex.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(raw)
            columns = [batch.column(id_col).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return mapped(docs.select(id_col, text_col), run, schema)
