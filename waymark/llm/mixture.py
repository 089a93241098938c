"""Packing of documents into windows whose tokens come from the sources in given proportions.

Every source is a queue of the ids of its documents, and in every round of a deficit round-robin each queue
is credited its share of a window. It gives out ids as far as its credit goes, and what is left of the credit, its
deficit, is carried on. A queue that is always filled has had ``floor(t * share)`` ids given out after round t, so the round of
an id follows from its place in the queue alone: rounds are made by all tasks at once, and deficits carry across windows and
tasks by the places. A share below ``least`` ids waits until its deficit reaches ``least``, so that windows aren't made of crumbs.

Rounds follow each other, by source inside a round, and are cut into windows of exactly ``capacity`` ids; what is left at the
end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import map_batches, ranges, texts_of, tidy, with_fields
from waymark.llm.packing import encoding
from waymark.session import checkpointed, ship_package, written

#: Rounds that one group of the last shuffle holds: some 131,000 ids at 2048 to a window.
BLOCK_ROUNDS = 64
#: Blocks between two sums that the driver sees: one row for half a billion ids.
SUPER_BLOCKS = 4096
#: Rows of per-task sums that go to every executor; more are joined by a shuffle.
BROADCAST_SUMS = 500_000


def queued(df: DataFrame, tokenizer_path: str, pattern: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The documents' ids as a table: ``id_col``, source, part, before (ids of its source before it in its part), tokens, ids.

    ``ids`` are little-endian, of 16 bits where the vocabulary allows, else of 32. Parts are tasks; the table fixes them.
    """
    df = tidy(df, [id_col, text_col, source_col]).select(F.col(id_col), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    kind = id_width(tokenizer_path, pattern, end_id)

    def make():
        from pyspark import TaskContext

        part, seen, own = TaskContext.get().partitionId(), {}, encoding(tokenizer_path, pattern)
        end = np.asarray([end_id], kind).tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            before, ids, tokens = [], [], []
            for text, source in zip(texts_of(batch.column("text")), batch.column("source").to_pylist(), strict=True):
                coded = own.encode_to_numpy(text, allowed_special="all")
                before.append(seen.get(source, 0))
                tokens.append(len(coded) + 1)
                ids.append(coded.astype(kind).tobytes() + end)
                seen[source] = before[-1] + tokens[-1]
            return pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("source"), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())], [id_col, "source", "part", "before", "tokens", "ids"])

        return step

    return written(map_batches(df, make, with_fields(df.select(id_col, "source"), "part int, before bigint, tokens bigint, ids binary")), "queues")


def id_width(tokenizer_path: str, pattern: str, end_id: int) -> str:
    return "<u2" if max(end_id, encoding(tokenizer_path, pattern).max_token_value) < 65536 else "<u4"


def cuts(at: np.ndarray, n: np.ndarray, total: np.ndarray, pace: np.ndarray, phase: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where rounds cut documents at ``at`` .. ``at + n`` of their queues of ``total`` ids: (document, from, to, round) of every slice.

    ``pace`` is the credit of a round. From ``least`` on, round t ends at floor(t * pace); below, ids leave in slices that end at
    multiples of ``least``, as soon as ``phase``, the credit at the start, and the rounds' credits cover them.
    """
    fine = pace >= least
    low = np.where(fine, np.floor(at / pace) - 1, at // least).astype(np.int64)
    high = np.where(fine, np.ceil((at + n) / pace) + 1, (at + n) // least + 1).astype(np.int64)
    k = ranges(low, high - low + 1)
    row = np.repeat(np.arange(len(at)), high - low + 1)
    place = np.where(fine[row], np.floor(k * pace[row]).astype(np.int64), k * least)
    inside = (place > at[row]) & (place < (at + n)[row])
    row, start = np.concatenate([np.arange(len(at)), row[inside]]), np.concatenate([at, place[inside]])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    stop = np.empty_like(start)
    stop[:-1] = start[1:]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    stop[last] = (at + n)[row[last]]
    credit, own = pace[row], fine[row]
    covered = np.where(own, stop, np.minimum(-(-stop // least) * least, total[row]) - phase[row])
    turn = np.maximum(1, np.ceil(covered / credit)).astype(np.int64)
    # the first round that ends at ``stop`` or behind it, whatever the division rounded to
    turn -= own & (turn > 1) & (np.floor((turn - 1) * credit) >= stop)
    turn += own & (np.floor(turn * credit) < stop)
    return row, start, stop, turn


def phase_of(source: str | None, tokens: int, least: int) -> float:
    """Credit that a queue starts with: a fixed part of what its first slice needs, so that small queues don't all come up at once."""
    return 0.0 if source is None else zlib.crc32(source.encode()) / 2**32 * min(least, tokens)


def _slices(queues: DataFrame, id_col: str, least: int, kind: str | None) -> DataFrame:
    """Slices of all queues with round and block; with their ids if ``kind`` gives the ids' type."""
    bytes_of = np.dtype(kind).itemsize if kind else 0
    fields = "at bigint, start bigint, length bigint, round bigint, block bigint" + (", ids binary" if kind else "")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, n = (batch.column(c).to_numpy() for c in ("at", "tokens"))
            total = batch.column("total").to_numpy()
            phase = np.asarray([phase_of(s, t, least) for s, t in zip(batch.column("source").to_pylist(), total.tolist(), strict=True)], np.float64)
            row, start, stop, turn = cuts(at, n, total, batch.column("pace").to_numpy(), phase, least)
            index, within = pa.array(row), start - at[row]
            columns = [batch.column(c).take(index) for c in (id_col, "source", "tokens")] + [pa.array(x) for x in (start, within, stop - start, turn, (turn - 1) // BLOCK_ROUNDS)]
            if kind:
                whole = [memoryview(x.as_buffer()) for x in batch.column("ids")]
                columns.append(pa.array([bytes(whole[r][bytes_of * a : bytes_of * b]) for r, a, b in zip(row.tolist(), within.tolist(), (stop - at[row]).tolist(), strict=True)], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, [id_col, "source", "tokens", "at", "start", "length", "round", "block"] + ["ids"] * bool(kind))

        return step

    wanted = queues.select(id_col, "source", "tokens", "at", "pace", "total", *(["ids"] if kind else []))
    return map_batches(wanted, make, with_fields(queues.select(id_col, "source", "tokens"), fields))


def ends_of(total: int, capacity: int) -> np.ndarray:
    """Where the sequences behind the last full one end: at powers of two."""
    end, rest = total // capacity * capacity, total % capacity
    return np.asarray([end := end + (1 << b) for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)


def _windows(id_col: str, capacity: int, total: int, kind: str):
    """The co-group function of a block's slices and the number of ids before the block: pieces with their places."""
    tail = ends_of(total, capacity)
    full = total // capacity

    def run(slices: pa.Table, bases: pa.Table) -> pa.Table:
        order = pc.sort_indices(slices, [("round", "ascending"), ("source", "ascending"), ("at", "ascending")])
        t = slices.take(order).combine_chunks()
        length, start = t.column("length").to_numpy(), t.column("start").to_numpy()
        stop = np.cumsum(length) + (bases.column("base")[0].as_py() if len(length) else 0)
        begin = stop - length
        whole = np.arange(begin[0] // capacity + 1, min(full, stop[-1] // capacity) + 1) * capacity if len(length) else np.zeros(0, np.int64)
        ends = np.concatenate([whole, tail])
        inner = ends[(ends > begin[0]) & (ends < stop[-1])] if len(length) else ends[:0]
        inner = np.setdiff1d(inner, begin)
        place = np.sort(np.concatenate([begin, inner]))
        row = np.searchsorted(begin, place, "right") - 1
        size = np.minimum(np.append(place[1:], stop[-1:]), stop[row]) - place
        skip = place - begin[row]
        in_tail = np.searchsorted(tail, place, "right")
        sequence = np.where(place < full * capacity, place // capacity, full + in_tail)
        opened = np.where(place < full * capacity, place // capacity * capacity, np.concatenate([[full * capacity], tail])[in_tail])
        ids = [np.frombuffer(x.as_buffer(), kind).astype("<u4") for chunk in t.column("ids").chunks for x in chunk]
        crc = [zlib.crc32(ids[r][a : a + n].tobytes()) for r, a, n in zip(row.tolist(), skip.tolist(), size.tolist(), strict=True)]
        index = pa.array(row)
        return pa.table([t.column(id_col).take(index), pa.array(start[row] + skip), pa.array(size), pa.array(crc, pa.int64()), t.column("tokens").take(index), pa.array(sequence), pa.array(place - opened), t.column("source").take(index), t.column("round").take(index)], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "round"])

    return run


def pack_mixture(df: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 1, targets: Mapping[str, float] | None = None, least: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Packs all documents into windows of ``capacity`` ids that hold the sources in target proportions.

    Returns a row per piece: ``id_col``, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id,
    offset (gapless from 0 in each sequence), source, round. A document is its ids and then ``end_id``, cut wherever a round or window
    ends. ``targets`` gives sources a positive weight; others, and all where it is None, have the weight of their tokens' share.
    A queue that is used up leaves its share to the others. All sequences are full but for the last ones, whose lengths are powers of two.

    Up to any window, a source whose queue isn't used up is ahead of or behind its share by at most a round's credit, ``least`` ids and
    what the other queues' roundings leave. Rows without a source are a queue of their own, the last one of a round. Null and empty texts are
    ``end_id`` alone; repeated rows and null ids are documents of their own; an empty table gives no rows; other columns are
    ignored. Texts are tokenised once, into a table. A queue's order follows the tasks that read it and changes
    nothing but which document lies where.
    """
    if targets and min(targets.values()) <= 0:
        raise ValueError("targets must be positive")
    spark = df.sparkSession
    ship_package(spark)
    kind = id_width(tokenizer_path, pattern, end_id)
    queue = queued(df, tokenizer_path, pattern, end_id, id_col, text_col, source_col)
    sums = queue.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    own = Window.partitionBy("source")
    sums = sums.select(F.col("source").alias("_source"), F.col("part").alias("_part"), (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(own).alias("total"))
    sums = checkpointed(sums)
    total = int(sums.where("base = 0").agg(F.sum("total")).first()[0] or 0)
    if not total:
        return spark.createDataFrame([], with_fields(queue.select(id_col), "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string, round bigint"))
    share = F.col("total") / F.lit(float(total))
    if targets:
        weights = spark.createDataFrame([(str(k), float(v)) for k, v in targets.items()], "_target string, weight double")
        sums = checkpointed(sums.join(weights, F.col("_source") == F.col("_target"), "left").withColumn("weight", F.coalesce("weight", share)))
        whole = float(sums.where("base = 0").agg(F.sum("weight")).first()[0])
    else:
        sums, whole = sums.withColumn("weight", share), 1.0
    sums = sums.withColumn("pace", F.least(F.lit(float(capacity)), F.lit(float(capacity)) * F.col("weight") / F.lit(whole)))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_SUMS else sums
    placed = queue.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))).withColumn("at", F.col("base") + F.col("before"))
    block = checkpointed(_slices(placed, id_col, least, None).groupBy("block").agg(F.sum("length").alias("n")))
    above = F.floor(F.col("block") / SUPER_BLOCKS)
    ahead, rows = 0, []
    for r in block.groupBy(above.alias("super")).agg(F.sum("n").alias("n")).orderBy("super").collect():
        rows.append((int(r["super"]), ahead))
        ahead += int(r["n"])
    starts = spark.createDataFrame(rows, "super bigint, ahead bigint")
    within = F.sum("n").over(Window.partitionBy("super").orderBy("block")) - F.col("n")
    bases = block.withColumn("super", above).withColumn("within", within).join(starts, "super").select("block", (F.col("ahead") + F.col("within")).alias("base"))
    schema = with_fields(queue.select(id_col), "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string, round bigint")
    slices = _slices(placed, id_col, least, kind)
    return slices.groupBy("block").cogroup(bases.groupBy("block")).applyInArrow(_windows(id_col, capacity, total, kind), schema)
