"""Operator 8: language identification by error-correcting output codes.

Each language gets a codeword; each bit is a binary classifier over hashed byte n-grams (1 to 4
bytes of letters, folded to lower case, words padded by a space). A text's bit margins are decoded
by loss: the language whose codeword has the least logistic loss wins, and a text whose best two
losses are close is flagged ambiguous.

Counts of n-grams are taken over the whole text. The classifiers are fitted to a bounded sample:
SAMPLE documents in all, as many of each language but LEAST at least, by the smallest hash of their
ids. The fit holds DENSE_ROWS of them at a time as a matrix.

Defined cases: `und` with score 0 for null texts and texts without a letter; very long texts are
counted whole, CHUNK bytes at a time; rows without a
language teach nothing; if no language can be learned all is `und`; one language learned is
predicted for every text with a letter; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import byte_slices, dropped, held_out, mapped, settle, texts_of

SAMPLE, LEAST, DENSE_ROWS = 3200, 8, 8192
BUCKETS = 1 << 13
ORDERS = (1, 2, 3, 4)
STEPS, RATE, DECAY = 300, 0.5, 1e-4
#: Bits for each language beyond the exhaustive code of few languages.
DENSE = 10
AMBIGUOUS = 0.1
UNKNOWN = "und"
#: Letters of ASCII to lower case, bytes of other letters as they are, all else to a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = re.compile(r"[^\W\d_]")
#: Texts go through numpy by so many bytes at a time.
CHUNK = 2 << 20


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Up to 7 languages all different splits; beyond, random dense rows
    (fixed seed) of which the best of several draws by least distance is taken."""
    if n <= 7:
        bits = max(1, 2 ** (n - 1) - 1)
        splits = np.arange(1, bits + 1)
        return np.where((splits[None] >> np.arange(n)[:, None]) & 1, 1, -1) if n > 1 else np.ones((1, 1), int)
    rng, best, most = np.random.default_rng(11), None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (n, int(DENSE * np.ceil(np.log2(n)))))
        apart = (code[:, None, :] != code[None]).sum(2) + np.eye(n, dtype=int) * code.shape[1]
        if apart.min() > most:
            best, most = code, apart.min()
    return best


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """A row of hashed n-gram counts for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), CHUNK):  # n-grams that cross a cut belong to its left side
            raw = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)[at : at + CHUNK + 2 + max(ORDERS) - 1]].astype(np.uint32)
            own = min(CHUNK, len(text) + 2 - at) if at + CHUNK < len(text) else len(raw)
            h = np.zeros(len(raw), np.uint32)
            for order in ORDERS:
                n = len(raw) - order + 1
                if n <= 0:
                    break
                h = h[:n] * np.uint32(0x9E3779B1) + raw[order - 1 :]
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                n = min(n, own)
                word = raw[:n] != 32 if order == 1 else np.ones(n, bool)
                out[i] += np.bincount((mixed[:n][word] >> np.uint32(19)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def normal(counts: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies: rows of length one."""
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


class Codebook:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias
        self.code = codewords(len(languages))

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and ambiguity of each row."""
        margin = normal(counts) @ self.weights + self.bias
        step = max(1, (1 << 22) // self.code.size)
        loss = np.concatenate([np.logaddexp(0, -margin[a : a + step, None, :] * self.code[None]).sum(2) for a in range(0, max(1, len(margin)), step)])
        order = np.argsort(loss, axis=1, kind="stable")
        likely = np.exp(-(loss - loss.min(1, keepdims=True)))
        likely /= likely.sum(1, keepdims=True)
        rows = np.arange(len(loss))
        best = likely[rows, order[:, 0]]
        second = likely[rows, order[:, 1]] if loss.shape[1] > 1 else np.zeros(len(loss))
        return order[:, 0], best, best - second < AMBIGUOUS


def fit(rows: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray, languages: list[str]) -> Codebook:
    """Logistic regression of all bits at once, by gradient descent. rows: the buckets and counts
    of each document; own: its language."""
    code = codewords(len(languages))
    y = code[own].astype(np.float32)
    weight = 1.0 / np.bincount(own, minlength=len(languages))[own]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    scale = np.float32(RATE * 100)

    def block(a: int) -> np.ndarray:
        counts = np.zeros((min(DENSE_ROWS, len(rows) - a), BUCKETS), np.float32)
        for i, (at, n) in enumerate(rows[a : a + DENSE_ROWS]):
            counts[i, at] = n
        return normal(counts)

    whole = block(0) if len(rows) <= DENSE_ROWS else None
    for _ in range(STEPS):
        toward, shift = np.zeros_like(w), np.zeros_like(b)
        for a in range(0, len(rows), DENSE_ROWS):
            x, part = block(a) if whole is None else whole, slice(a, a + DENSE_ROWS)
            pull = y[part] / (1 + np.exp(np.clip(y[part] * (x @ w + b), -30, 30))) * weight[part]
            toward += x.T @ pull
            shift += pull.sum(0)
        w += scale * toward - DECAY * w
        b += RATE * shift
    return Codebook(languages, w, b)


def learn(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> Codebook | None:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out())
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    each = max(LEAST, SAMPLE // len(languages))
    ids = None
    for lang in languages if len(languages) <= 8 else ():
        part = rows.where(F.col("lang") == lang).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        ids = part if ids is None else ids.unionByName(part)
    if ids is None:  # many languages: one pass, with the rank within a language
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
        ids = rows.select("doc_id", "lang").withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_rank")
    ids = settle(ids.distinct(), "taught")  # at most SAMPLE rows, or LEAST of each language

    def sparse(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            at, n = [], []
            for t in texts:
                row = gram_counts([t.as_py().encode()])[0]
                hit = np.flatnonzero(row)
                at.append(hit.astype("<u2").tobytes())
                n.append(row[hit].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["doc_id", "lang", "at", "n"])

    own = rows.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    own = mapped(own, sparse, "doc_id long, lang string, at binary, n binary").orderBy("doc_id", "lang")
    known = {x: i for i, x in enumerate(languages)}
    found = own.collect()  # bounded by the sample: at most 6 * BUCKETS bytes each
    dropped(ids)
    counts = [(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<f4")) for r in found]
    return fit(counts, np.array([known[r.lang] for r in found], np.int64), languages)


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    book = learn(docs, id_col, text_col, lang_col)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, text_col)
            names, scores, doubts = [], [], []
            for a, b in byte_slices(texts):
                for c in range(a, b, 256):
                    part = texts.slice(c, min(256, b - c)).to_pylist()
                    lettered = [bool(_LETTER.search(t)) for t in part]
                    if book is None:
                        best, score, doubt = np.zeros(len(part), int), np.zeros(len(part)), np.zeros(len(part), bool)
                    else:
                        best, score, doubt = book.predict(gram_counts([t.encode() for t in part]))
                    for ok, i, s, d in zip(lettered, best.tolist(), score.tolist(), doubt.tolist()):
                        ok = ok and book is not None
                        names.append(book.languages[i] if ok else UNKNOWN)
                        scores.append(float(s) if ok else 0.0)
                        doubts.append(bool(d) if ok else True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"]
            )

    out = mapped(docs.select(id_col, text_col), run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
