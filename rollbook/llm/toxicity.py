"""Operator 3: toxicity of restored text.

Writers hide words by look-alike symbols (1d10t), spacing (i d i o t) and repetition (idiooot).
Each such token is a lattice: every position offers the letters it may stand for, a word break, or
nothing. The Viterbi path under a character trigram model and a small channel model is the restored
text; a token with one path is its own restoration. The score is that of the restored words.

The character model counts all documents. Evidence is learned from a bounded sample of labelled
documents (SAMPLE_TOXIC + SAMPLE_CLEAN by the smallest hash of their ids): hashed features of the
restored words, counted once for a family of near copies (a shared least hash of word triples).
A word counts with its strongest feature's lower confidence bound (Wilson's) of the share of toxic
documents, and a document's words combine as independent causes; bounds below LEAST are left out.

Texts are read in pieces of PIECE characters, cut at white space; a token beyond LONG characters is
decoded in parts of so many.

Defined cases: null and empty texts get the score of a document without evidence; very long ones
are scored whole; labels that are
null are left out, of contradicting labels the toxic one counts; without labels of both kinds
nothing is evidence; repeated rows repeat; other columns are ignored by `scores` and kept by
`drop_toxic`.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import SLICE_BYTES, byte_slices, claim, dropped, held_out, mapped, settle, texts_of, trimmed

THRESHOLD = 0.7
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_TASKS = 8000, 16000, 16
BUCKETS = 1 << 21
#: Squared normal quantile of the lower bound of a feature's share of toxic documents, and the
#: least bound that is evidence.
Z2, LEAST = 6.0, 0.4
GRAM = 5
#: Of features, the most specific first.
KINDS = ("word", "beginning", "inside")
MEMO_TOKENS = 600_000
PIECE, LONG = 1 << 20, 1000
#: Symbols of the character model: 0 none (a word's edge), 1 to 26 letters, 27 other letters.
ALPHABET = 28
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[0xC0:] = 27
#: What a symbol may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "2": "z", "6": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Log probabilities of the channel.
STAND_IN, DROPPED, REPEATED, BROKEN = -0.7, -0.7, -0.5, -8.0
_EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’*_-–—/\\"
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_TRIPLE = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t.\-_*]){3,}\S(?!\S)")
#: Where a text may be cut: not among single characters, if there is another place near.
_CUT, _SPACE = re.compile(r"(?<=\S\S)\s"), re.compile(r"\s")


def trigram_counts(docs: DataFrame, text_col="text") -> DataFrame:
    """trigram (its index) and n, over all texts; at most ALPHABET ** 3 rows."""

    @trimmed
    def run(batches):
        claim("toxicity")
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            texts = texts_of(batch, text_col)
            for a, b in byte_slices(texts, SLICE_BYTES // 4):
                part = texts.slice(a, b - a)
                raw = np.frombuffer(b"\n\n".join([b"", *(x.as_py() for x in part.cast(pa.large_binary())), b""]), np.uint8)
                symbols = _CLASS[raw[(raw & 0xC0) != 0x80]]
                for at in range(0, max(1, len(symbols) - 2), SLICE_BYTES // 4):
                    c = symbols[at : at + SLICE_BYTES // 4 + 2].astype(np.int32)
                    if len(c) > 2:
                        total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["trigram", "n"])

    return mapped(docs.select(text_col), run, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text_col="text") -> np.ndarray:
    """Log probabilities [first, second, third] of the third symbol, smoothed by shorter contexts."""
    counts = np.zeros(ALPHABET**3)
    for r in trigram_counts(docs, text_col).collect():
        counts[r.trigram] = r.n
    counts = counts.reshape((ALPHABET,) * 3)
    uni = (counts.sum((0, 1)) + 1) / (counts.sum() + ALPHABET)
    two = counts.sum(0)
    two = (two + ALPHABET * uni) / (two.sum(1, keepdims=True) + ALPHABET)
    three = (counts + ALPHABET * two[None]) / (counts.sum(2, keepdims=True) + ALPHABET)
    return np.log(three).astype(np.float32)


def _symbol(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27 if char.isalpha() else 0


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """(restored text, log probability) choices of each position of a lower-case token."""
    out = []
    for i, c in enumerate(token):
        if c.isalpha():
            choices = [(c, 0.0)]
            if i > 1 and token[i - 2] == c == token[i - 1] or i > 0 and i + 1 < len(token) and token[i - 1] == c == token[i + 1]:
                choices.append(("", REPEATED))
        else:
            choices = [(x, STAND_IN) for x in LEET.get(c, "")] + [(" ", BROKEN)]
            if c not in LEET or c in "!|+(":
                choices.append(("", DROPPED))
        out.append(choices)
    return out


def restore(token: str, model: np.ndarray) -> str:
    """The most probable words behind a lower-case token, separated by spaces."""
    states = {(0, 0): (0.0, None)}  # the last two symbols: log probability, (previous, text)
    for choices in lattice(token):
        new: dict = {}
        for (x, y), (p, back) in states.items():
            row = model[x, y]
            for text, cost in choices:
                if text:
                    z = _symbol(text)
                    if z == 0 and y == 0:  # a break at a break says nothing new
                        key, q = (x, y), p + cost
                    else:
                        key, q = (y, z), p + cost + float(row[z])
                else:
                    key, q = (x, y), p + cost
                if key not in new or q > new[key][0]:
                    new[key] = (q, (back, text))
        states = new
    _, back = max(((p + float(model[x, y, 0]), back) for (x, y), (p, back) in states.items()), key=lambda s: s[0])
    parts = []
    while back:
        back, text = back
        parts.append(text)
    return " ".join("".join(reversed(parts)).split())


def readings(token: str, model: np.ndarray) -> list[str]:
    """The restored words of a token."""
    if len(token) > LONG:
        return [w for a in range(0, len(token), LONG) for w in readings(token[a : a + LONG], model)]
    low = token.lower().strip(_EDGE)
    if not low:
        return []
    if _PLAIN.match(low) and not _TRIPLE.search(low):
        return [low]
    if not any(c.isalpha() for c in low):
        return []
    # symbols at the edge may stand for letters too: only what never does is stripped
    return restore(token.lower().strip(_EDGE.translate(str.maketrans("", "", "!("))).rstrip("!"), model).split()


def features(word: str, kind: str) -> list[str]:
    """Of a word: itself, its beginnings, or its grams and end."""
    if len(word) < 3:
        return []
    if kind == "word":
        return ["=" + word]
    if kind == "beginning":
        return ["^" + word[:n] for n in range(3, min(len(word), 6) + 1)]
    return [word[i : i + GRAM] for i in range(1, len(word) - GRAM + 1)] + [word[-4:] + "$"]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def _pieces(text: str):
    at = 0
    while at + PIECE < len(text):
        cut = _CUT.search(text, at + PIECE, at + PIECE + 4 * LONG) or _SPACE.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _tokens(text: str) -> set[str]:
    """The tokens of a piece."""
    found = set(text.split())
    found.update(_SPACED.findall(text))
    return found


def _family(text: str) -> int:
    """Near copies mostly share the two least hashes of their word triples."""
    least, before = [], []
    for piece in _pieces(text):
        words = before + piece.split()
        if len(words) > 2 or not least:
            hashes = {zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))}
            least = sorted(hashes.union(least))[:2]
        before = words[-2:]
    return least[0] << 31 ^ least[-1]


def lower_bounds(toxic: np.ndarray, clean: np.ndarray) -> dict[int, float]:
    """Buckets with enough evidence: Wilson's lower bound of the toxic share."""
    n = np.maximum(toxic + clean, 1e-9)
    share = toxic / n
    low = (share + Z2 / (2 * n) - np.sqrt(Z2 * share * (1 - share) / n + (Z2 / (2 * n)) ** 2)) / (1 + Z2 / n)
    return {int(i): float(low[i]) for i in np.flatnonzero((toxic > 0) & (low >= LEAST))}


class Evidence:
    """What was learned: lower bounds by feature, the base rate, the character model."""

    def __init__(self, model: np.ndarray):
        self.model, self.p, self.base = model, {}, 0.05

    @property
    def nothing(self) -> float:
        return 0.1 * self.base

    def of(self, word: str) -> float:
        return max((self.p.get(i, 0.0) for kind in KINDS for i in features(word, kind)), default=0.0)


class Scorer:
    """Scores texts; remembers what tokens say."""

    def __init__(self, evidence: Evidence):
        self.e, self.known, self.says = evidence, set(), {}

    def score(self, text: str) -> float:
        best: dict[str, float] = {}
        for piece in _pieces(text):
            found = _tokens(piece)
            if len(self.known) > MEMO_TOKENS:
                self.known, self.says = set(), {}
            for token in found - self.known:
                words = readings(token, self.e.model)
                told = [(w, p) for w in words if (p := self.e.of(w))]
                if told:
                    self.says[token] = told
            self.known |= found
            for token in found & self.says.keys():
                best.update(self.says[token])
        clean = 1 - self.e.nothing
        for word in sorted(best):
            clean *= 1 - best[word]
        return 1 - clean


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """Bounded: text and toxic of the labelled documents to learn from, and what a clean one weighs."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = known.select(F.col("doc_id").alias("_id"), "_toxic")
    counts = {r._toxic: r.n for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    ids = []
    for toxic, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        ids.append(known.where(F.col("_toxic") == toxic).orderBy(F.xxhash64("_id"), "_id").limit(most))
    taken = [min(counts.get(1, 0), SAMPLE_TOXIC), min(counts.get(0, 0), SAMPLE_CLEAN)]
    rate = [t / max(1, counts.get(k, 0)) for t, k in zip(taken, (1, 0))]
    ids = settle(ids[0].unionByName(ids[1]), "labelled")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id").select("text", F.col("_toxic").alias("toxic"))
    return own, (rate[0] / rate[1]) if rate[1] and rate[0] else 1.0


def learn(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> Evidence:
    model = language_model(docs, text_col)
    evidence = Evidence(model)
    sample, weight = _sample(docs, labels, id_col, text_col)

    def families(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array([_family(t.as_py()) for t in texts], pa.int64())], ["text", "toxic", "family"])

    def counter(kind):
        @trimmed
        def count(batches):
            claim("toxicity")
            sums, n, memo = {0: np.zeros(BUCKETS, np.uint16), 1: np.zeros(BUCKETS, np.uint16)}, {0: 0, 1: 0}, {}
            now, seen = None, {}
            for batch in batches:
                for text, toxic, family in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "family"))):
                    n[toxic] += 1
                    if family != now:  # rows are in order of the family
                        now, seen = family, {0: set(), 1: set()}
                    found: set[int] = set()
                    for token in (t for piece in _pieces(text or "") for t in _tokens(piece)):
                        if token not in memo:
                            if len(memo) > MEMO_TOKENS // 6:
                                memo.clear()
                            memo[token] = [i for w in readings(token, model) if not evidence.p or not evidence.of(w) for i in map(bucket, features(w, kind))]
                        found.update(memo[token])
                    found -= seen[toxic]
                    seen[toxic] |= found
                    sums[toxic][np.fromiter(found, np.int64, len(found))] += 1
            rows = []
            for toxic, x in sums.items():
                at = np.flatnonzero(x)
                rows.append((toxic, n[toxic], zlib.compress(at.astype("<u4").tobytes(), 1), zlib.compress(x[at].astype("<u2").tobytes(), 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["toxic", "n", "at", "counts"])

        return count

    def spell(kind, buckets):
        """The features of toxic documents in the given buckets, with the documents that hold them."""

        def run(batches):
            n: dict[str, int] = {}
            for batch in batches:
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                    words = {w for piece in _pieces(text or "") for token in _tokens(piece) for w in readings(token, model)} if toxic else ()
                    for f in {f for w in words if not evidence.of(w) for f in features(w, kind) if bucket(f) in buckets}:
                        n[f] = n.get(f, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])

        return run

    sample = settle(mapped(sample, families, "text string, toxic int, family long").where("toxic IN (0, 1)"), "sample")
    for kind in KINDS:  # a word that is evidence already doesn't count for what is less specific
        sums, n = {0: np.zeros(BUCKETS), 1: np.zeros(BUCKETS)}, {0: 0, 1: 0}
        tasks = mapped(sample.repartition(SAMPLE_TASKS, "family").sortWithinPartitions("family", "toxic"), counter(kind), "toxic int, n long, at binary, counts binary")
        for r in tasks.collect():  # two sparse arrays of a task
            at = np.frombuffer(zlib.decompress(r["at"]), "<u4")
            sums[r.toxic][at] += np.frombuffer(zlib.decompress(r["counts"]), "<u2")
            n[r.toxic] += r.n
        if not n[0] or not n[1]:
            break
        evidence.base = n[1] / (n[1] + n[0] * weight)
        found = lower_bounds(sums[1], sums[0] * weight)  # the sample holds relatively more toxic documents
        if found:
            # buckets are shared: the feature that fills one is its evidence, what falls in beside it isn't
            fills: dict[int, tuple] = {}
            for r in mapped(sample, spell(kind, frozenset(found)), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
                fills[bucket(r.feature)] = max(fills.get(bucket(r.feature), (0, "")), (r.n, r.feature))
            evidence.p = evidence.p | {f: found[i] for i, (_, f) in fills.items()}
    dropped(sample)
    return evidence


def scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    evidence = learn(docs, labels, id_col, text_col)

    @trimmed
    def run(batches):
        claim("toxicity")
        own = Scorer(evidence)
        for batch in batches:
            score = [own.score(t.as_py()) for t in texts_of(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = mapped(docs.select(id_col, text_col), run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Pipeline stage: documents predicted toxic go; the others stay as they were, in one pass."""
    evidence = learn(docs, labels, id_col, text_col)

    @trimmed
    def run(batches):
        claim("toxicity")
        own = Scorer(evidence)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) < THRESHOLD for t in texts_of(batch, text_col)], pa.bool_()))

    return mapped(docs, run, docs.schema)
