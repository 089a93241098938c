"""What the operators of this subpackage share: input hygiene, Arrow batches, columnar byte moves, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.session import checkpointed, ship_package

#: Rows of a batch that a function works on at once, which bounds what a worker holds beside the batch.
CHUNK_ROWS, CHUNK_BYTES = 1024, 64 << 20
#: Edges that one task turns into stars at a time: some ten MB.
TASK_EDGES = 250_000
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tidy(df: DataFrame, needed: Iterable[str], reserved: Iterable[str] = ()) -> DataFrame:
    """``df`` with unambiguous columns: the first of equally named ones stays, and none is named like a result.

    Names compare without case. ``needed`` columns always stay (the first of each name); other columns
    named like one in ``reserved`` are dropped, since the operator's result takes that name.
    """
    keep_always, taken = {n.lower() for n in needed}, {n.lower() for n in reserved}
    present = {c.lower() for c in df.columns}
    if lacking := [n for n in needed if n.lower() not in present]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    seen: set[str] = set()
    names, stay = [], []
    for i, c in enumerate(df.columns):
        low = c.lower()
        if low in seen or (low in taken and low not in keep_always):
            names.append(f"__dropped_{i}")
            continue
        seen.add(low)
        names.append(c)
        stay.append(c)
    return df.toDF(*names).select(*[F.col(f"`{c}`") for c in stay])


def unused_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores behind it until no column of ``df`` is so named."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_fields(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` and more fields, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Rows (from, to) to work on at once: ``CHUNK_ROWS`` or as many as have ``CHUNK_BYTES`` of text, one at least."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    behind = np.cumsum(size)
    low = 0
    while low < batch.num_rows:
        limit = behind[low] - size[low] + CHUNK_BYTES
        high = max(low + 1, min(low + CHUNK_ROWS, int(np.searchsorted(behind, limit, "right"))))
        yield low, high
        low = high


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with a batch function that each task makes once; it sees the rows of ``chunks`` at a time."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for low, high in chunks(batch):
                yield step(batch.slice(low, high - low))
        del step
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Gives freed memory of an idle worker back, since workers stay for later tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null ones as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


class Forest:
    """Union-find over 0..n-1 with path halving; the smaller root wins."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0..n-1 the smallest one that it reaches by links (a, b)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: each node but the smallest of its component there, with that one."""
    found = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if found:
        a, b = (np.concatenate(side) for side in zip(*found, strict=True))
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        low = least_reachable(len(names), place[: len(a)], place[len(a) :])
        node = np.flatnonzero(low != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[node]), pa.array(names[low[node]])], ["a", "b"])
    release_memory()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, component), component the smallest node.

    Edges are dealt to tasks, ``TASK_EDGES`` to each, and every task turns its own into stars. What several tasks leave goes
    through alternating large and small stars (Kiveris et al. 2014): each round hooks neighbours to the smallest
    node seen. All state is an edge table, kept in reliable checkpoints; minima are pre-aggregated before
    each shuffle and hub nodes meet their one minimum in a join that AQE can split, so no task gathers the
    neighbours of a node. Self-links and nulls are ignored; isolated nodes don't occur in the result.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpointed(e)
    tasks = max(1, -(-e.count() // TASK_EDGES))
    ship_package(e.sparkSession)
    e = checkpointed(e.repartition(tasks).mapInArrow(_stars, "a bigint, b bigint"))
    signature = None
    for _ in range(max_rounds if tasks > 1 else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low2, large.a == low2.k).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(small.unionByName(low2.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == signature:
            break
        signature = now
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    member = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    root = e.select(F.col("b").alias("node")).distinct().join(member, "node", "left_anti").select("node", F.col("node").alias("component"))
    return member.unionByName(root)
