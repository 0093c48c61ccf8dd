"""Operator 6: chat formatting by columnar byte assembly.

A turn is `<|role|>`, a line break, its text, `</s>` and a line break. Inside roles and texts a
backslash is written before every backslash and after the first character of each control string,
which one rule undoes: a backslash stands for the character behind it.

A batch of rows becomes one buffer: the lengths of all pieces give their offsets by a cumulative
sum, and headers and contents are scattered into one preallocated Arrow buffer that the output's
strings point into. Rows are streamed in order of conversation and turn, so memory is bounded by
SEGMENT_BYTES; a longer conversation gives several segments, which in order are its text.

Defined cases: a null text or role counts as empty; turns with equal numbers are ordered by role,
then text; a null conv_id is a conversation of its own; repeated rows are turns of their own; other
columns are ignored; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import mapped, ragged, settle

#: Control strings of this and other templates.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, AFTER_ROLE, CLOSE = b"<|", b"|>\n", b"</s>\n"
TRAINED = "assistant"
SEGMENT_BYTES = 16 << 20
_TURN = re.compile(r"<\|((?:[^\\|]|\\.|\|(?!>))*)\|>\n((?:[^\\<]|\\.|<(?!/s>))*)</s>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
SEGMENTS = "conv_id long, segment long, n_turns long, text string, loss array<struct<start:long,length:long>>"


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for control in CONTROLS:
        texts = pc.replace_substring(texts, control, control[0] + "\\" + control[1:])
    return texts


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and its offsets from zero."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, their n + 1 offsets, and the offsets of their texts."""
    n = len(roles)
    role, role_at = _bytes(escape(roles))
    text, text_at = _bytes(escape(texts))
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = len(OPEN), len(AFTER_ROLE), len(CLOSE)
    sizes[:, 1], sizes[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(sizes.ravel())
    begins = (ends - sizes.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for piece, fixed in ((0, OPEN), (2, AFTER_ROLE), (4, CLOSE)):
        out[begins[:, piece, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    out[ragged(begins[:, 1], sizes[:, 1])] = role
    out[ragged(begins[:, 3], sizes[:, 3])] = text
    return out, np.append(begins[:, 0], len(out)), np.stack((begins[:, 3], begins[:, 4]), 1)


def _segments(run: np.ndarray, roles: pa.Array, texts: pa.Array):
    """First rows, sizes, texts and loss spans of the runs of equal numbers."""
    out, at, span = assemble(roles, texts)
    begins = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    ends = np.append(begins[1:], len(run))
    offsets = at[np.append(begins, len(run))]
    strings = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    # spans in code points from the segment's start
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    trained = pc.equal(roles, TRAINED).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(begins)), ends - begins)
    start = points[span[:, 0]] - points[offsets[own]]
    length = points[span[:, 1]] - points[span[:, 0]]
    n_spans = np.bincount(own[trained], minlength=len(begins))
    loss = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(n_spans))), pa.int32()), pa.StructArray.from_arrays([pa.array(start[trained]), pa.array(length[trained])], ["start", "length"])
    )
    return begins, ends - begins, strings.cast(pa.string()), loss


def _assembly(batches):
    """Rows in order of conversation and turn, to segments. The last conversation of a batch waits
    for the rest of it, up to SEGMENT_BYTES; what comes after those is its next segment."""
    waiting, done, segment = None, (), 0

    def emit(rows):
        nonlocal done, segment
        conv = rows.column("conv_id").combine_chunks()
        known = pc.is_valid(conv).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(conv, 0).to_numpy()
        run = np.cumsum(np.concatenate(([True], (ids[1:] != ids[:-1]) | (known[1:] != known[:-1]))))
        begins, n, text, loss = _segments(run, *(pc.fill_null(rows.column(c).combine_chunks(), "") for c in ("role", "text")))
        number = np.zeros(len(begins), np.int64)
        if done == (conv[0].as_py(),):
            number[0] = segment + 1
        done, segment = (conv[len(conv) - 1].as_py(),), int(number[-1])
        return pa.RecordBatch.from_arrays([conv.take(pa.array(begins)), pa.array(number), pa.array(n), text, loss], ["conv_id", "segment", "n_turns", "text", "loss"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if waiting is not None:
            rows = pa.concat_tables([waiting, rows])
        if not len(rows):
            continue
        conv = rows.column("conv_id").combine_chunks()
        last = conv[len(conv) - 1]
        same = pc.fill_null(pc.equal(conv, last), False) if last.is_valid else pc.is_null(conv)
        cut = len(rows) - pc.sum(same).as_py()
        if cut:
            yield emit(rows.slice(0, cut))
        waiting = rows.slice(cut)
        if (pc.sum(pc.binary_length(waiting.column("text"))).as_py() or 0) > SEGMENT_BYTES:
            yield emit(waiting)
            waiting = None
    if waiting is not None and len(waiting):
        yield emit(waiting)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, n_turns, text, loss (spans of code points)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(ordered.select("conv_id", "role", "text"), _assembly, SEGMENTS)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"no turn at {at}")
    return turns


def _digests(batches):
    """Segments in order, to a row for each conversation. Only running digests are held."""
    now, state = None, None

    def row():
        n, turns, chars, loss, size = state
        return [now[0], n, turns.hexdigest(), chars, loss.hexdigest(), size]

    for batch in batches:
        out = []
        for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
            if now != (conv,):
                if now is not None:
                    out.append(row())
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in spans:
                said = unescape(text[span["start"] : span["start"] + span["length"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if out:
            yield _rows(out)
    if now is not None:
        yield _rows([row()])


def _rows(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ordered = formatted.select("conv_id", "segment", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return mapped(ordered, _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(conversations: DataFrame) -> DataFrame:
    """Format, write, and read back."""
    return read_back(settle(format_conversations(conversations), "formatted"))
