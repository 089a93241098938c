"""Packing of tokenised documents into sequences by minimum bin slack.

Texts are tokenised once; only (length, count) pairs, at most ``capacity`` of them, reach the driver.
There, bin by bin, a bitset subset-sum over the lengths that are left finds the fullest feasible
combination with the longest piece; as many bins as the counts allow take that combination at once. The
plan then meets the pieces again by length and rank, without any sort of all pieces.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import map_batches, texts_of, tidy, with_fields
from waymark.session import checkpointed


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level tokenizer file, whose ids follow the order of its merges.

    The file writes each byte as a printable character: bytes that are printable as themselves, the
    others, in order, from U+0100 on.
    """
    vocabulary, added = _read(path)["model"]["vocab"], added_tokens(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token) and token not in added}


def added_tokens(path: str) -> dict[str, int]:
    """Strings and ids of the file's added tokens, each of which is one id wherever it stands in a text.

    Tokens that the file wants matched in another way than by their very characters are refused.
    """
    added = _read(path)["added_tokens"]
    if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens that aren't matched literally: {odd}")
    return {t["content"]: t["id"] for t in added}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer file's encoding, once for each worker process.

    It gives the ids that the tokenizers library gives with its default settings, added tokens included, which the
    tests compare, at a quarter of the CPU time.
    """
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens=added_tokens(path))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all have ``capacity`` but the first, which may be shorter."""
    pieces = -(-n // capacity)
    first = n - (pieces - 1) * capacity
    return [(0, first)] + [(first + k * capacity, capacity) for k in range(pieces - 1)]


def pieces(df: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: str = "ids_crc32") -> DataFrame:
    """The pieces of every document: ``id_col``, piece, start, length, ``keep``, part, rank.

    ``keep`` is ``ids`` (array<int>) or ``ids_crc32`` (of the little-endian unsigned 32-bit ids). ``part``
    and ``rank`` number the pieces of one length within a task.
    """
    if keep not in ("ids", "ids_crc32"):
        raise ValueError("keep: ids or ids_crc32")
    df = tidy(df, [id_col, text_col]).select(F.col(id_col), F.col(text_col).alias("text"))
    kind = "array<int>" if keep == "ids" else "bigint"
    schema = with_fields(df.select(id_col), f"piece int, start bigint, length bigint, {keep} {kind}, part int, rank bigint")
    end = np.asarray([end_id], "<u4").tobytes()

    def make():
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own, seen = encoding(tokenizer_path, pattern), {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, piece, start, length, kept, rank = [], [], [], [], [], []
            texts = texts_of(batch.column("text"))
            for at, text in enumerate(texts):
                whole = memoryview(own.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes() + end)
                for k, (a, n) in enumerate(cut(len(whole) // 4, capacity)):
                    ids = whole[4 * a : 4 * (a + n)]
                    rows.append(at)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    kept.append(zlib.crc32(ids) if keep == "ids_crc32" else np.frombuffer(ids, "<i4"))
                    rank.append(seen.get(n, 0))
                    seen[n] = rank[-1] + 1
            columns = [batch.column(id_col).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(kept, pa.list_(pa.int32()) if keep == "ids" else pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", keep, "part", "rank"])

        return step

    return map_batches(df, make, schema)


def fullest(left: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The combination of the lengths in ``left`` (with their counts) that fills ``room`` best.

    Bit t of the set is on if a sum of t can be made. Longer lengths come first, and the search ends as
    soon as a length completes a full bin, so full bins prefer few long pieces.
    """
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in order:
        if length > room:
            continue
        steps.append((length, reach))
        for _ in range(min(left[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            reach = more
        if reach >> room & 1:
            break
    total, combo = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        k = 0
        while not before >> (total - k * length) & 1:
            k += 1
        if k:
            combo[length] = k
            total -= k * length
    return combo


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Minimum bin slack over a histogram of lengths: rows (length, first rank, per bin, first bin, offset), and the bins.

    The ranks of a length from one row's first rank to the next row's go to bins one after another,
    ``per bin`` to each, at ``offset`` and behind it.
    """
    left = {n: c for n, c in counts.items() if c}
    if left and not (min(left) > 0 and max(left) <= capacity):
        raise ValueError("a length is outside 1..capacity")
    order, used, rows, bins = sorted(left, reverse=True), dict.fromkeys(left, 0), [], 0
    while order:
        longest = order[0]
        left[longest] -= 1
        combo = fullest(left, order, capacity - longest) if capacity > longest else {}
        left[longest] += 1
        combo[longest] = combo.get(longest, 0) + 1
        times = min(left[n] // k for n, k in combo.items())
        at = 0
        for n in sorted(combo, reverse=True):
            rows.append((n, used[n], combo[n], bins, at))
            at += n * combo[n]
            used[n] += times * combo[n]
            left[n] -= times * combo[n]
        bins += times
        order = [n for n in order if left[n]]
    return rows, bins


def pack_documents(df: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: str = "ids_crc32") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: ``id_col``, piece, start (the document's ids before it), length, ``keep``,
    sequence_id, offset (gapless from 0 in each sequence). A document is its ids and then ``end_id``; only
    longer ones are cut. Null and empty texts are ``end_id`` alone; repeated rows and null ids are packed
    as documents of their own; an empty table gives no rows; other columns are ignored. The pieces'
    lengths, without ids, are checkpointed once; what the driver sees is bounded by ``capacity``.
    """
    spark = df.sparkSession
    found = checkpointed(pieces(df, tokenizer_path, pattern, capacity, end_id, id_col, text_col, keep))
    by_part = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    steps_of: dict[int, list] = {}
    for length, *step in rows:
        steps_of.setdefault(length, []).append(step)
    # at most ``capacity`` lengths, each with the few combinations it takes part in
    shared = spark.sparkContext.broadcast({n: np.asarray(v, np.int64) for n, v in steps_of.items()})
    before = by_part.select(F.col("length").alias("_length"), F.col("part").alias("_part"), (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("_before"))
    ranked = found.join(before, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part"))).withColumn("rank", F.col("rank") + F.col("_before")).drop("_length", "_part", "_before", "part")
    schema = with_fields(ranked.drop("rank"), "sequence_id bigint, offset bigint")

    def make():
        steps = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                steps_n = steps[int(n)]
                row = steps_n[np.searchsorted(steps_n[:, 0], ranks[at], "right") - 1]
                within = ranks[at] - row[:, 0]
                sequence[at] = row[:, 2] + within // row[:, 1]
                offset[at] = row[:, 3] + within % row[:, 1] * n
            return pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names if c != "rank"] + [pa.array(sequence), pa.array(offset)], [c for c in batch.schema.names if c != "rank"] + ["sequence_id", "offset"])

        return step

    return map_batches(ranked, make, schema)
