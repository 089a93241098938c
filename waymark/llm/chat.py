"""Chat formatting by columnar byte assembly.

A turn is ``<s>[INST] role [/INST]text</s>``. Inside roles and texts every control string gets one more
backslash behind its first bracket, so that it isn't a control string any more, and one less on the way
back: this is reversible for every text. A batch is assembled column by column: Arrow escapes
the contents, numpy turns segment lengths into offsets and scatter indices, and all headers, contents
and ends are copied into one preallocated buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import list_array, ranges, tidy
from waymark.session import ship_package

#: The template's control strings.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
_ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\])"
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(MIDDLE) + r"(.*?)" + re.escape(CLOSE), re.DOTALL)

SEGMENT = "conv_id bigint, slice int, chunk int, turns int, formatted string, loss array<struct<start:int,stop:int>>"
#: Bytes of formatted text after which a conversation continues in a new chunk, always between two turns.
CHUNK_BYTES = 1 << 20


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _bytes_and_lengths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary column, one after another, and the length of each value."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)), np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: its bytes, each turn's end in bytes, and where its text starts and stops in it.

    Null roles and texts count as empty.
    """
    escaped = [pc.replace_substring_regex(pc.fill_null(c.cast(pa.large_string()), ""), _ESCAPE, r"\1\\\2\3") for c in (roles, texts)]
    (role_bytes, role_len), (text_bytes, text_len) = (_bytes_and_lengths(c) for c in escaped)
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (OPEN, MIDDLE, CLOSE)]
    n = len(role_len)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2], lengths[:, 3], lengths[:, 4] = len(fixed[0]), role_len, len(fixed[1]), text_len, len(fixed[2])
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, part in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[(starts[:, k][:, None] + np.arange(len(part))).ravel()] = np.tile(part, n)
    out[ranges(starts[:, 1], role_len)] = role_bytes
    out[ranges(starts[:, 3], text_len)] = text_bytes
    return out, ends[:, 4], starts[:, 3], ends[:, 3]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formats sorted turns; a row for each run of one conversation's turns in a batch, cut at CHUNK_BYTES."""
    from pyspark import TaskContext

    part, chunk = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        out, ends, text_from, text_to = assemble(batch.column("role"), batch.column("text"))
        ids = batch.column("conv_id")
        keys = np.asarray(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))
        nulls = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
        loss = np.asarray(pc.fill_null(pc.equal(batch.column("role"), "assistant"), False).to_numpy(zero_copy_only=False))
        begins = np.concatenate([[0], ends[:-1]])
        border = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])]))
        first = []
        for a, b in zip(border, [*border[1:], n], strict=True):
            while a < b:
                first.append(a)
                a = max(a + 1, int(np.searchsorted(ends, begins[a] + CHUNK_BYTES, "right"))) if ends[b - 1] - begins[a] > CHUNK_BYTES else b
        # positions in code points: bytes that continue a character don't count
        points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
        first = np.asarray(first)
        marked = np.flatnonzero(loss)
        row = np.searchsorted(first, marked, "right") - 1
        origin = points[begins[first]][row]
        spans = pa.StructArray.from_arrays([pa.array((points[at[marked]] - origin).astype(np.int32)) for at in (text_from, text_to)], ["start", "stop"])
        # the buffer itself becomes the column: only its offsets are new
        offsets = np.concatenate([begins[first], ends[-1:]]).astype(np.int32)
        columns = {
            "conv_id": ids.take(pa.array(first)),
            "slice": pa.array(np.full(len(first), part, np.int32)),
            "chunk": pa.array(np.arange(chunk, chunk + len(first), dtype=np.int32)),
            "turns": pa.array(np.diff(np.append(first, n)).astype(np.int32)),
            "formatted": pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out)),
            "loss": list_array(spans, np.bincount(row, minlength=len(first))),
        }
        chunk += len(first)
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def format_turns(df: DataFrame) -> DataFrame:
    """Formats conversations (conv_id, turn, role, text), a row for each turn, into ``SEGMENT`` rows.

    Turns are ordered by turn, then role and text where turns tie (nulls first); repeated rows are turns
    of their own, null texts and roles are empty, and rows with a null conv_id form one conversation.
    An empty table gives no rows; other columns are ignored. A conversation is the concatenation of its
    rows by (slice, chunk), and ``loss`` marks the code points of assistants' texts in each row.
    Turns are dealt out by ranges of (conv_id, turn), so that a conversation that holds a third of all
    turns is formatted by many tasks, each batch by batch.
    """
    df = tidy(df, ["conv_id", "turn", "role", "text"]).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    ship_package(df.sparkSession)
    return df.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_slices, SEGMENT)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted text: role, text, and where the escaped text starts and stops."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
    if at != len(formatted):
        raise ValueError("text behind the last turn")
    return out


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted SEGMENT rows back; the state is the current conversation's counts and running hashes."""
    names = [p.split()[0] for p in DIGESTS.split(", ")]
    current: list | None = None
    done: list[list] = []

    def flush() -> pa.RecordBatch:
        rows = [[c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5]] for c in done]
        done.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names)

    for batch in batches:
        for conv, text, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            if current is None or current[0] != conv:
                if current is not None:
                    done.append(current)
                current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said, _, _ in parse(text):
                current[1] += 1
                current[2].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["stop"]])
                current[3] += len(said)
                current[4].update(said.encode())
            current[5] += len(text)
        if done:
            yield flush()
    if current is not None:
        done.append(current)
    if done:
        yield flush()


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation of ``format_turns``, read back from the formatted text and its loss mask.

    A hash over a conversation needs its text in order, so one task streams each conversation; it keeps
    counts and running hashes only, whatever the length.
    """
    ship_package(formatted.sparkSession)
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "chunk").mapInArrow(_digests, DIGESTS)
