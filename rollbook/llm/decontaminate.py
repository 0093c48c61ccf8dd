"""Operator 5: benchmark decontamination by FM-indexes over training shards.

A shard is a slice of documents held by a task. Its words become symbols (a word that no benchmark
item has is a break; so is a run of known words that is shorter than every window, since none can
occur in it), the symbol runs are suffix-sorted into a Burrows-Wheeler transform kept as a wavelet
matrix, and all windows are searched backwards at once by its ranks. Occurrences are located by
walking to sampled suffix positions and merged into removal spans.

The benchmark is a stated test set. About BLOCK_WORDS of its words go out with the tasks in one
pass, as one flat array of symbols and their vocabulary; of a larger one (or of longer items: they
are dealt out in overlapping pieces of PIECE_WORDS) each pass takes as much, and writes what it
finds before the next one begins. A document beyond PIECE_BYTES is indexed in overlapping pieces.

Defined cases: a null or empty text has no words and is clean; very long texts are taken whole, a
piece at a time; benchmark rows with a null id or text, or without words, have no window; items of
one id are one item; an empty benchmark leaves everything clean; repeated documents keep their
rows; other columns are ignored by `contamination` and kept by `drop_contaminated`.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import byte_slices, claim, dropped, mapped, ragged, remembered, settle, texts_of, trimmed

WINDOW = 13
BLOCK_WORDS, PIECE_WORDS = 1 << 19, 1 << 16
PIECE_BYTES = 4 << 20
SAMPLE_RATE = 8
#: Upper case to lower case; the bytes that words cannot hold to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WaveletMatrix:
    """rank and access over a symbol sequence, a bit plane at a time, for arrays of queries."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros, self.plane = [], [], []
        for b in reversed(range(self.bits)):
            bit = (symbols >> b) & 1
            self.plane.append(bit.astype(bool))
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int64))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] occurs before position at[i]."""
        low = np.zeros_like(at)
        for level, b in enumerate(reversed(range(self.bits))):
            ones, bit = self.ones[level], ((symbol >> b) & 1).astype(bool)
            low, at = (np.where(bit, self.zeros[level] + ones[x], x - ones[x]) for x in (low, at))
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit, ones = self.plane[level][at], self.ones[level]
            out = out * 2 + bit
            at = np.where(bit, self.zeros[level] + ones[at], at - ones[at])
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling. Each break (symbol 0) is its own symbol, smaller than all others and
    the smaller the earlier, so that order is settled within a run."""
    n = len(symbols)
    breaks = symbols == 0
    rank = np.where(breaks, np.cumsum(breaks), symbols.astype(np.int64) + int(breaks.sum()))
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:]
        key = rank * (int(rank.max()) + 1) + np.where(breaks, 0, ahead) if step < n else rank
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n or step >= n:
            return order
        step *= 2


class FMIndex:
    """Over symbols that end with a break."""

    def __init__(self, symbols: np.ndarray, top: int, rate: int = SAMPLE_RATE):
        order = suffix_array(symbols)
        before = symbols[order - 1]  # the symbol before position 0 is the last one, a break
        self.n = len(symbols)
        self.wavelet = WaveletMatrix(before.astype(np.int64), top)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        sampled = (order % rate == 0) | (before == 0)  # a walk never crosses a break
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (right-aligned in a matrix, all symbols known)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1]):
            live = np.flatnonzero((lens > j) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, patterns.shape[1] - 1 - j]
            low[live] = self.less[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, which = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(rows):
            done = self.sampled[rows]
            out[which[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            rows, which = rows[~done], which[~done]
            symbol = self.wavelet.access(rows)
            rows = self.less[symbol] + self.wavelet.rank(symbol, rows)
            steps += 1
        return out


class Block:
    """Some pieces of benchmark items on their way to the tasks: their words as symbols, one piece
    after the other, the item of each piece, and the vocabulary."""

    def __init__(self, pieces: list[tuple[int, bytes]]):
        symbol: dict[bytes, int] = {}
        own = [[symbol.setdefault(w, len(symbol) + 1) for w in text.split()] for _, text in pieces]
        self.ends = np.cumsum([len(x) for x in own]).astype(np.int64)
        self.symbols = np.fromiter((i for x in own for i in x), np.int32, int(self.ends[-1]) if own else 0)
        self.items = np.array([i for i, _ in pieces], np.int64)
        self.words = b" ".join(symbol)
        self.name = uuid.uuid4().hex


class Phrases:
    """The different windows of a block, each with the items that hold it."""

    def __init__(self, block: Block, window: int = WINDOW):
        self.symbol = {w: i for i, w in enumerate(block.words.split(), 1)}
        starts = np.concatenate((np.zeros(1, np.int64), block.ends[:-1])) if len(block.ends) else block.ends
        sizes = block.ends - starts
        n = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        first, lens = ragged(starts, n), np.repeat(np.minimum(sizes, window), n)
        rows = np.zeros((len(first), window), np.int32)  # right-aligned
        for j in range(window):
            own = lens > j
            rows[own, window - 1 - j] = block.symbols[(first + lens - 1 - j)[own]]
        _, at, which = np.unique(rows.view([("", np.int32)] * window).ravel(), return_index=True, return_inverse=True)
        self.patterns, self.lens = rows[at], lens[at]
        pairs = np.unique(np.stack((which.ravel(), np.repeat(block.items, n)), 1), axis=0)
        self.owner_ends, self.owner_items = np.searchsorted(pairs[:, 0], np.arange(len(at)), "right"), pairs[:, 1]

    def owners(self, windows: np.ndarray) -> list[int]:
        """The items of some different windows."""
        begin = np.where(windows > 0, self.owner_ends[windows - 1], 0)
        return self.owner_items[ragged(begin, self.owner_ends[windows] - begin)].tolist()

    def occurrences(self, texts: list[bytes]):
        """Words of each text, and the (text, first word, window) of each occurrence."""
        get, ids, n_words = self.symbol.get, [], []
        for text in texts:
            words = split_words(text)
            n_words.append(len(words))
            ids.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        n_words = np.array(n_words, np.int64)
        none = np.zeros(0, np.int64)
        if not len(self.lens) or not n_words.sum():
            return n_words, none, none, none
        ends = np.cumsum(n_words)
        flat = np.concatenate(ids)
        text_of = np.repeat(np.arange(len(texts)), n_words)
        known = flat > 0
        begins = known & ~np.concatenate(([False], known[:-1] & (text_of[1:] == text_of[:-1])))
        first = np.flatnonzero(begins)
        run = np.cumsum(begins) - 1
        size = np.bincount(run[known], minlength=len(first))
        long = size >= self.lens.min()
        first, size = first[long], size[long]
        if not len(first):
            return n_words, none, none, none
        # each run, then a break
        at = ragged(first, size + 1)
        brk = np.cumsum(size + 1) - 1
        symbols = flat[np.minimum(at, len(flat) - 1)]
        symbols[brk] = 0
        index = FMIndex(symbols, len(self.symbol))
        low, high = index.search(self.patterns, self.lens)
        found = np.repeat(np.arange(len(low)), high - low)
        place = at[index.locate(ragged(low, high - low))]
        text = text_of[place]
        return n_words, text, place - (ends - n_words)[text], found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<first:long,after:long>>"


def _pieces(text: bytes, carry: int):
    """(words before the piece, words of it that the one before had, piece) of a long text."""
    at, before, held = 0, 0, []
    while at < len(text):
        cut = _BREAK.search(text, at + PIECE_BYTES)
        stop = cut.start() if cut else len(text)
        own = split_words(text[at:stop])
        yield before - len(held), len(held), b" ".join([*held, *own])
        before += len(own)
        held, at = (held + own)[len(held) + len(own) - carry :] if carry < len(held) + len(own) else held + own, stop


def _scan(block: Block, window: int, sparse: bool):
    """Over batches with a column `text`: n_words, spans and items are filled in; sparse: only rows
    with an occurrence, as key, spans and items."""

    @trimmed
    def run(batches):
        claim("decontaminate")
        phrases = remembered("decontaminate", block.name, lambda: Phrases(block, window))
        for batch in batches:
            texts = texts_of(batch, "text")
            spans, items, n_words = [[] for _ in range(len(texts))], [set() for _ in range(len(texts))], np.zeros(len(texts), np.int64)

            def found(of: np.ndarray, text, word, which):
                order = np.argsort(text, kind="stable")
                text, word, which = text[order], word[order], which[order]
                begins = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else []
                for x, y in zip(begins, [*begins[1:], len(text)]):
                    t, w, p = int(of[text[x]]), word[x:y], which[x:y]
                    spans[t] = _merged(spans[t] + list(zip(w.tolist(), (w + phrases.lens[p]).tolist())))
                    items[t].update(phrases.owners(np.unique(p)))

            for a, b in byte_slices(texts):
                own = texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()
                if len(own) == 1 and len(own[0]) > PIECE_BYTES:
                    for before, again, piece in _pieces(own[0], window - 1):
                        n, text, word, which = phrases.occurrences([piece])
                        n_words[a] += int(n[0]) - again
                        found(np.array([a]), text, word + before, which)
                else:
                    n, text, word, which = phrases.occurrences(own)
                    n_words[a:b] = n
                    found(np.arange(a, b), text, word, which)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
            out = {
                "n_words": pa.array(n_words),
                "spans": pa.array([[{"first": x, "after": y} for x, y in s] for s in spans], kind),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
            }
            if sparse:
                keep = pa.array([bool(s) for s in spans])
                yield pa.RecordBatch.from_arrays([batch.column("key"), out["spans"], out["items"]], ["key", "spans", "items"]).filter(keep)
            else:
                yield pa.RecordBatch.from_arrays([out.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return run


def _item_pieces(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """i, no, words (joined by spaces), n: overlapping pieces of the items that have words."""

    def deal(batches):
        for batch in batches:
            for item, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
                words = split_words(text)
                starts = range(0, max(1, len(words) - window + 1), PIECE_WORDS) if words else ()
                rows = [words[a : a + PIECE_WORDS + window - 1] for a in starts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array([b" ".join(r) for r in rows], pa.binary()), pa.array([len(r) for r in rows], pa.int64())], ["i", "no", "words", "n"])

    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.encode(text_col, "utf-8").alias("t"))
    return settle(mapped(rows, deal, "i long, no int, words binary, n long"), "pieces")


def _blocks(benchmark: DataFrame, window: int, id_col="item_id", text_col="text"):
    """The number of blocks, and one after the other, each made when it is asked for."""
    pieces = _item_pieces(benchmark, window, id_col, text_col)
    parts = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))

    def made():
        for p in range(parts):
            own = pieces.where(F.pmod(F.xxhash64("i", "no"), F.lit(parts)) == p).select("i", "words")
            yield Block([(r.i, bytes(r.words)) for r in own.collect()])
        dropped(pieces)

    return parts, made()


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col="text") -> DataFrame:
    """row (all columns of docs), text, n_words, spans (of word positions, merged, `after` not
    included), items, and the verdict on them."""
    parts, blocks = _blocks(benchmark, window)
    out = docs.select(
        F.struct("*").alias("row"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<long>").alias("items")
    )
    first = next(blocks)
    if parts == 1:
        out = mapped(out, _scan(first, window, False), out.schema)
    else:
        # what a pass finds depends on the text alone
        key, hits, block = F.sha2(F.coalesce("text", F.lit("")), 256), None, first
        while block is not None:
            found = mapped(out.select(key.alias("key"), "text").distinct(), _scan(block, window, True), f"key string, spans {SPANS}, items array<long>")
            found = settle(found, "hits")
            hits, block = found if hits is None else hits.unionByName(found), next(blocks, None)
        merged = hits.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
        nothing = Block([])
        counted = mapped(out, _scan(nothing, window, False), out.schema)
        joined = F.aggregate(
            "s",
            F.array().cast(SPANS),
            lambda done, x: F.when((F.size(done) > 0) & (x.first <= F.get(done, F.size(done) - 1).after), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1).first.alias("first"), F.greatest(F.get(done, F.size(done) - 1).after, x.after).alias("after"))))).otherwise(F.concat(done, F.array(x))),
        )
        merged = merged.select("key", joined.alias("s"), "i")
        out = counted.join(merged, key == F.col("key"), "left").select("row", "text", "n_words", F.coalesce("s", "spans").alias("spans"), F.coalesce("i", "items").alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s.after - s.first)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("*", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256")).withColumn(
        "contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = matches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def _word_offsets(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its removal spans, which run from a first word to the end of a last."""
    at = _word_offsets(text)
    for first, after in sorted(spans, reverse=True):
        text = text[: at[first][0]] + text[at[after - 1][1] :]
    return text


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col="text") -> DataFrame:
    """Pipeline stage: documents that the contamination rule names go; all others stay as they
    were, with all their columns, in one pass."""
    return matches(docs, benchmark, text_col=text_col).where("NOT contaminated").select("row.*")
