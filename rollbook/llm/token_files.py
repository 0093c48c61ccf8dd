"""Operator 1: token-id files with a shared zstandard dictionary.

Documents are encoded, each document's ids are compressed as a zstandard frame of its own under
one dictionary trained on serialized id arrays, and the frames are packed in ascending id order
into containers. A container is one binary value:

    magic "RBTOK1" | width u8 | documents u32 | sha256 of the dictionary (32 bytes)
    ids i64[n] | id present u8[n] | token counts u32[n] | frame offsets u64[n + 1] | frames

so a single document is read by its index entry alone. Containers are rows of a Parquet table
(column `blob`), written by Spark's own commit protocol wherever the shared folder lives;
`Container(blob, dictionary)` reads a container that was copied out to a file just as well.

Defined cases: a null text counts as empty and yields the end id only; an empty table yields no
container; repeated or null ids keep their rows, nulls first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.common import bounded_sample, byte_slices, dropped, mapped, settle, texts_of
from rollbook.llm.word_encoder import CODER_BYTES, encoder

MAGIC = b"RBTOK1"
HEAD = struct.Struct("<6sBI32s")
#: The dictionary is trained on so many documents at most, and so many bytes of each.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8192, 65536
#: A container is closed beyond either.
CONTAINER_DOCUMENTS, CONTAINER_BYTES = 8192, 4 << 20
LEVEL = 3


def train_dictionary(samples: list[bytes]) -> bytes:
    """Empty if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dict_data(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class Container:
    """Random access to the documents of one container."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, width, n, digest = HEAD.unpack_from(blob)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a container of this dictionary")
        at = HEAD.size
        self.doc_ids = np.frombuffer(blob, "<i8", n, at)
        self.present = np.frombuffer(blob, "u1", n, at + 8 * n)
        self.n_tokens = np.frombuffer(blob, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(blob, "<u8", n + 1, at + 13 * n)
        self.frames = memoryview(blob)[at + 13 * n + 8 * (n + 1) :]
        self.kind = f"<u{width}"
        self.inflate = zstandard.ZstdDecompressor(dict_data=_dict_data(dictionary))

    def __len__(self):
        return len(self.doc_ids)

    def tokens(self, i: int) -> np.ndarray:
        frame = self.frames[int(self.offsets[i]) : int(self.offsets[i + 1])]
        return np.frombuffer(self.inflate.decompress(frame), self.kind)


def pack(width: int, dictionary: bytes, doc_ids: list, n_tokens: list[int], frames: list[bytes]) -> bytes:
    n = len(doc_ids)
    return b"".join(
        (
            HEAD.pack(MAGIC, width, n, hashlib.sha256(dictionary).digest()),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], "u1").tobytes(),
            np.array(n_tokens, "<u4").tobytes(),
            np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes(),
            *frames,
        )
    )


def _serialized(path: str, end_id: int, batch, text_col: str):
    """The id arrays of a batch, each with the end id."""
    coder = encoder(path)
    kind = "<u2" if max(coder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    texts, end = texts_of(batch, text_col), np.array([end_id], kind)
    for a, b in byte_slices(texts, CODER_BYTES):
        for ids in coder.encode(texts.slice(a, b - a)):
            yield np.concatenate((ids.astype(kind), end))


def shared_dictionary(docs: DataFrame, path: str, end_id: int, id_col="doc_id", text_col="text") -> bytes:
    """Trained on a bounded sample of documents; it affects sizes, never contents."""
    ids = [r[0] for r in bounded_sample(docs.select(id_col).where(F.col(id_col).isNotNull()), id_col, SAMPLE_DOCUMENTS).collect()]

    def samples(batches):
        for batch in batches:
            out = [x[: SAMPLE_BYTES // 2].tobytes() for x in _serialized(path, end_id, batch, text_col)]
            yield pa.RecordBatch.from_pydict({"s": pa.array(out, pa.binary())})

    rows = mapped(docs.where(F.col(id_col).isin(ids)).select(text_col), samples, "s binary").limit(SAMPLE_DOCUMENTS).collect()
    return train_dictionary([bytes(r.s) for r in rows])


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, id_col="doc_id", text_col="text") -> tuple[DataFrame, bytes]:
    """Containers in ascending order of the id, and their dictionary.

    Columns: part, seq (order of the containers), part_start (tokens of the part before it),
    n_docs, n_tokens, blob.
    """
    dictionary = shared_dictionary(docs, path, end_id, id_col, text_col)

    def encode(batches):
        deflate = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict_data(dictionary))
        for batch in batches:
            sizes, frames = [], []
            for ids in _serialized(path, end_id, batch, text_col):
                sizes.append(len(ids))
                frames.append(deflate.compress(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], ["id", "n", "frame"])

    def container(batches):
        coder = encoder(path)
        width = 2 if max(coder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, seq, start, held = TaskContext.get().partitionId(), 0, 0, ([], [], [])

        def close():
            row = {"part": [part], "seq": [seq], "part_start": [start], "n_docs": [len(held[0])], "n_tokens": [sum(held[1])], "blob": [pack(width, dictionary, *held)]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())]))

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "frame"))):
                for at, x in zip(held, row):
                    at.append(x)
                size += len(row[2])
                if size >= CONTAINER_BYTES or len(held[0]) >= CONTAINER_DOCUMENTS:
                    yield close()
                    seq, start, size, held = seq + 1, start + sum(held[1]), 0, ([], [], [])
        if held[0]:
            yield close()

    frames = settle(mapped(docs.select(id_col, text_col), encode, "id long, n long, frame binary"), "frames")
    ordered = frames.repartitionByRange("id").sortWithinPartitions("id")
    packed = mapped(ordered, container, "part int, seq int, part_start long, n_docs long, n_tokens long, blob binary")
    containers = settle(packed, "containers")
    dropped(frames)
    return containers, dictionary


def read_token_files(containers: DataFrame, dictionary: bytes) -> DataFrame:
    """Per document, read from the containers: doc_id, start, n_tokens, ids_crc32."""
    parts = containers.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    # one row for each task that wrote: bounded by the number of partitions, not by documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("part").alias("base_part"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    placed = containers.join(F.broadcast(bases), F.col("part") == F.col("base_part")).select((F.col("base") + F.col("part_start")).alias("start"), "blob")

    def read(batches):
        for batch in batches:
            for start, blob in zip(batch.column("start").to_pylist(), batch.column("blob")):
                box = Container(blob.as_py(), dictionary)
                crc = [zlib.crc32(box.tokens(i).astype("<u4").tobytes()) for i in range(len(box))]
                n = box.n_tokens.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(box.doc_ids, pa.int64(), mask=box.present == 0), pa.array(start + np.cumsum(n) - n, pa.int64()), pa.array(n), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return mapped(placed, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write, then read back."""
    return read_token_files(*write_token_files(docs, path, end_id))
