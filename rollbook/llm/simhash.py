"""Operator 4: SimHash near-duplicates by BK-trees.

Fingerprints are made equal-size rows first (one row for each different fingerprint). Two
fingerprints within RADIUS bits agree on one of RADIUS + 1 blocks of their bits, so every
(block, value) is a shard of its own; a shard's BK-tree has its members as nodes and the integer
Hamming distance to the parent as the edge, and a member's search follows only the edges within the
radius of its distance to a node. Trees are built where their shard's queries already are, instead
of being broadcast: all trees together grow with the corpus, and no bound on them could be proven.

A shard of more than SHARD members is dealt out again by the bits it leaves free, up to LEVELS
times, which is exact for the same reason and bounds a shard by 2 ** 19 members. A shard yields one
link for each member at most (to its class within the shard), never all pairs.

Defined cases: a null or empty text has fingerprint zero and links like any other; repeated ids
keep their rows; rows with a null id get a fingerprint, and the component of the non-null ids that
share or neighbour it (null if there are none); other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm import lines
from rollbook.llm.common import claim, dropped, mapped, ragged, settle, texts_of, trimmed
from rollbook.llm.components import connected_components, union

SEED, BITS, RADIUS = 42, 64, 2
SHARD, LEVELS = 4096, 3
#: Rows that a task gathers before it builds their trees; visited (query, node) pairs at a time.
ROWS, VISITS = 1 << 17, 1 << 21
#: Shingles whose MinHash is taken at a time; bytes of a text that are taken at a time.
CELLS, PIECE = 1 << 12, 1 << 20
#: Characters of documents that one task compares with each other.
CHARS = 16 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_FACTORS = np.random.default_rng(17).integers(0, 1 << 64, lines.ROWS * lines.BANDS, dtype=np.uint64) | np.uint64(1)
_KEYS = [f"k{i}" for i in range(lines.BANDS)]


def _words(text: bytes):
    """Lists of the words of a text in lower case, a piece of it at a time."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        stop = cut.start() if cut else len(text)
        yield text[at:stop].lower().split()  # both ASCII only on bytes
        at = stop


def shingle_blocks(text: bytes, words: int = 3):
    """Arrays of the hashes of the word shingles, in order; a shorter text is one shingle."""
    digest, held, some = xxhash.xxh64_intdigest, [], False
    for own in _words(text):
        held += own
        if len(held) >= words:
            joined = b" ".join(held)
            ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
            starts = [0, *(ends[:-words] + 1).tolist()]
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)
            held, some = held[len(held) - words + 1 :], True
    if held and not some:
        yield np.array([digest(b" ".join(held), SEED)], np.uint64)


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *shingle_blocks(text, words)])


def majority(blocks) -> int:
    """Unsigned; a bit is 1 if set in over half of all hashes of the blocks."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned; a bit is 1 if set in over half of the hashes of the word shingles."""
    return majority(shingle_blocks(text, words))


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash: the least of the hashes by each factor."""
    out = np.full(len(_FACTORS), -1, np.int64).view(np.uint64)
    for at in range(0, len(hashes), CELLS):
        np.minimum(out, (hashes[at : at + CELLS, None] * _FACTORS).min(0), out=out)
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    @trimmed
    def run(batches):
        claim("simhash")
        for batch in batches:
            texts = texts_of(batch, text_col).cast(pa.large_binary())
            out = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return mapped(docs.select(id_col, text_col), run, "doc_id long, fp long")


def bk_forest(fp: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BK-trees of several shards at once, level by level; root[i] is the first member of i's
    shard. Returns the edges, sorted by parent * (BITS + 1) + distance, and the child of each.

    A node's child at a distance is the first member, in order, with that distance to it, as it is
    when members are inserted one by one."""
    left = np.flatnonzero(root != np.arange(len(root)))
    at = root[left]
    keys, children = [], []
    while len(left):
        key = at * (BITS + 1) + np.bitwise_count(fp[left] ^ fp[at]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        keys.append(key[first])
        children.append(left[first])
        at = left[first][np.cumsum(first) - 1][~first]
        left = left[~first]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return key[order], child[order]


def bk_links(fp: np.ndarray, root: np.ndarray, radius: int = RADIUS):
    """Yields (query, node) arrays of the members of one shard within `radius` of each other."""
    keys, children = bk_forest(fp, root)
    sizes = np.bincount(root, minlength=len(root))[root]
    queries = np.flatnonzero(sizes > 1)
    visits = np.cumsum(sizes[queries])
    begin = 0
    while begin < len(queries):
        stop = max(begin + 1, int(np.searchsorted(visits, (visits[begin - 1] if begin else 0) + VISITS, "right")))
        q = queries[begin:stop]
        node = root[q]
        begin = stop
        while len(q):
            d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            near = (d <= radius) & (node < q)
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(keys, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(keys, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            n = high - low
            q, node = np.repeat(q, n), children[ragged(low, n)]


def _shard_links(batches):
    """Rows sorted by shard: a link from each member to its class within the shard."""

    def links(shard, fp, node):
        new = np.concatenate(([True], shard[1:] != shard[:-1]))
        root = np.flatnonzero(new)[np.cumsum(new) - 1]
        parent = np.arange(len(fp))
        for a, b in bk_links(fp.view(np.uint64), root):
            parent = union(parent, a, b)
        moved = np.flatnonzero(parent != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[parent[moved]])], ["a", "b"])

    held, rows = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        rows += len(batch)
        if rows >= ROWS:
            shard, fp, node = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(shard, shard[-1], "left"))  # sorted; the last shard may go on
            if cut:
                yield links(shard[:cut], fp[:cut], node[:cut])
            held, rows = [[shard[cut:], fp[cut:], node[cut:]]], 0
    if held:
        shard, fp, node = (np.concatenate(x) for x in zip(*held))
        if len(shard):
            yield links(shard, fp, node)


def _split(free: int) -> list[int]:
    """The free bits in RADIUS + 1 blocks of about the same size."""
    bits = [i for i in range(BITS) if free >> i & 1]
    cuts = [len(bits) * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def hamming_links(fps: DataFrame) -> DataFrame:
    """fps: different fp (long) with their node (long). Links a, b between nodes whose closure
    connects all nodes with fingerprints within RADIUS bits."""
    rows = fps.select(F.lit(0).cast("long").alias("shard"), F.lit(0).alias("path"), "fp", "node")
    free, out = [(1 << BITS) - 1], None
    for level in range(LEVELS):
        masks = [_split(f) for f in free]
        free = [f & ~m for f, own in zip(free, masks) for m in own]
        table = F.array(*(F.array(*(F.struct(F.lit(len(own) * p + i).alias("path"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(own))) for p, own in enumerate(masks)))
        rows = rows.select("shard", "fp", "node", F.explode(F.element_at(table, F.col("path") + 1)).alias("m")).select(
            F.xxhash64("shard", "m.path", F.col("fp").bitwiseAND(F.col("m.mask"))).alias("shard"), F.col("m.path").alias("path"), "fp", "node"
        )
        large = None
        if level < LEVELS - 1:
            counts = settle(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("shard"), "shards")
            large = None if counts.isEmpty() else counts
        here = rows if large is None else rows.join(large, "shard", "left_anti")
        found = mapped(here.select("shard", "fp", "node").repartition("shard").sortWithinPartitions("shard", "node"), _shard_links, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if large is None:
            break
        rows = settle(rows.join(large, "shard", "left_semi"), "large")
    return out


def near_duplicates(docs: DataFrame, words: int = 3, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least id reachable)."""
    own = settle(fingerprints(docs, words, id_col, text_col), "fingerprints")
    fps = settle(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "fps")
    classes = connected_components(hamming_links(fps.where("node IS NOT NULL")))
    by_fp = fps.join(classes, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _content(text: bytes) -> int:
    """Signed; equal for texts of the same words."""
    h = xxhash.xxh3_64(seed=SEED)
    for words in _words(text):
        if words:
            h.update(b" ".join(words) + b" ")
    return _signed(h.intdigest())


def _signed_texts(docs: DataFrame, words: int) -> DataFrame:
    """docs: doc_id, t, text -> doc_id, t, fp, h (of its words) and the band keys of its MinHash
    (null without words)."""

    @trimmed
    def run(batches):
        claim("simhash")
        for batch in batches:
            fps, contents, sigs = [], [], []
            for text in texts_of(batch, "text").cast(pa.large_binary()):
                text = text.as_py()
                hashes = shingle_hashes(text, words)
                fps.append(_signed(majority(hashes[a : a + PIECE] for a in range(0, len(hashes), PIECE))))
                contents.append(_content(text))
                sigs.append(signature(hashes))
            keys = lines.band_keys(np.array(sigs, np.uint64).reshape(-1, len(_FACTORS)))
            blank = np.array([(s == np.uint64((1 << 64) - 1)).all() for s in sigs], bool)
            columns = [batch.column("doc_id"), batch.column("t"), pa.array(fps, pa.int64()), pa.array(contents, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(keys[:, i], mask=blank) for i in range(lines.BANDS))], ["doc_id", "t", "fp", "h", *_KEYS])

    return mapped(docs, run, "doc_id long, t long, fp long, h long, " + ", ".join(f"{k} long" for k in _KEYS))


def _near_copies(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (a hash of the text) and component_id of rows with an id."""
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    own = settle(_signed_texts(docs, words), "signatures")
    classes = own.groupBy("fp", "h").agg(F.min("doc_id").alias("doc_id"), F.min_by("t", "doc_id").alias("t"), *(F.min(k).alias(k) for k in _KEYS))
    # written once, so that the ids stay
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def texts_of_nodes(nodes):
        found = docs.join(classes.join(nodes, "node", "left_semi").select("doc_id", "t", "node"), ["doc_id", "t"])
        return settle(found.select("node", "text", F.length("text").alias("size")).dropDuplicates(["node"]), "texts")

    def shingled(texts):
        return [np.unique(shingle_hashes(t.encode(), words)) for t in texts]

    buckets = classes.where("k0 IS NOT NULL").select("node", F.explode(F.array(*_KEYS)).alias("bucket")).select("bucket", "node")
    alike = lines.similar_components(lines.stars_of(buckets), texts_of_nodes, shingled, CHARS)
    fps = settle(classes.groupBy("fp").agg(F.min("node").alias("node")), "fps")
    same = classes.select("fp", F.col("node").alias("a")).join(fps.select("fp", F.col("node").alias("b")), "fp").where("a != b").select("a", "b")
    components = connected_components(hamming_links(fps).unionByName(alike.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(same))
    labels = settle(classes.join(components, "node", "left").select("fp", "h", "doc_id", F.coalesce("component", "node").alias("label")), "labels")
    dropped(classes, alike, fps, components)
    least = labels.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return own.select("doc_id", "t", "fp", "h").join(labels.join(least, "label").select("fp", "h", "component_id"), ["fp", "h"]).select("doc_id", "t", "component_id")


def near_copies(docs: DataFrame, words: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and component_id (the least id reachable) of rows with an id. Links are fingerprints
    within RADIUS bits, and word shingles with a Jaccard similarity of lines.SIMILAR or more:
    candidates of these come from MinHash bands as in lines, and every one is verified on the texts."""
    return _near_copies(docs, words, id_col, text_col).drop("t")


def keep_one(docs: DataFrame, words: int = 3, id_col="doc_id", text_col="text") -> DataFrame:
    """Of each component the document with the least id stays (rows with a null id stay), all
    columns as they were."""
    gone = near_duplicates(docs, words, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")


def keep_one_copy(docs: DataFrame, words: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """Pipeline stage: `keep_one` by the components of `near_copies`; texts that share an id are
    documents of their own."""
    gone = _near_copies(docs, words, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias("_gone"), F.col("t").alias("_t"))
    return docs.join(gone, (docs[id_col].cast("long") == F.col("_gone")) & (F.xxhash64(docs[text_col]) == F.col("_t")), "left_anti")
