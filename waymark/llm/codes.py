"""Compression of vectors to short codes by product quantisation in whole numbers.

Vectors become blocks of int64 columns, a row of the block table for some thousand vectors. A round of Lloyd's
algorithm is one ``treeAggregate`` over the blocks: distances to all entries of a part's codebook accumulate dimension by
dimension, ``np.add.at`` adds a block to tensors of sums and counts, and these merge through the tree. What
reaches the driver is the tensors: parts x entries x width numbers, however many vectors there are. All is whole
numbers, so neither the order of rows nor that of merges changes the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import list_array, map_batches, tidy
from waymark.session import checkpointed, ship_package

#: Vectors whose distances to all entries are held at a time.
TILE = 512
#: Labels whose sums go to every executor; more are joined by a shuffle.
BROADCAST_LABELS = 100_000


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` (entries, width) for each column of ``part`` (width, n), ties to the lower one, and the squared distance."""
    n = part.shape[1]
    code, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    total, diff = np.empty((TILE, len(book)), np.int64), np.empty((TILE, len(book)), np.int64)
    for a in range(0, n, TILE):
        m = min(TILE, n - a)
        t, d = total[:m], diff[:m]
        t[:] = 0
        for dim in range(len(part)):
            np.subtract(part[dim, a : a + m, None], book[None, :, dim], out=d)
            np.multiply(d, d, out=d)
            t += d
        code[a : a + m] = t.argmin(1)
        far[a : a + m] = t[np.arange(m), code[a : a + m]]
    return code, far


def whole_numbers(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of the rows of a list column, each filled up with zeros to ``width``; columns of the result are vectors.

    Numbers beyond what leaves room for a squared distance in 64 bits are held at that bound (2**27 at 64 dimensions).
    """
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bound = float(int((2.0**61 / max(1, width)) ** 0.5))
    x = np.clip(np.floor(flat * scale), -bound, bound).astype(np.int64).reshape(len(column), -1)
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, width - x.shape[1]))).T)


def _first_entries(rows: DataFrame, entries: int, scale: int, parts: int, width: int) -> np.ndarray:
    """The codebooks (parts, entries, width / parts) at the start: the rows with the smallest ids, as many as there are entries."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    cells = whole_numbers(first.column("vector").combine_chunks(), scale, width)
    return cells.T.reshape(-1, parts, width // parts).transpose(1, 0, 2).copy()


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of its parts, unused ones as they were."""
    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast(books)
    shape = books.shape

    def add(total, row):
        sums, counts = total
        cells = np.frombuffer(row[1], np.int64).reshape(-1, row[0])
        for j, book in enumerate(shared.value):
            part = cells[j * shape[2] : (j + 1) * shape[2]]
            code, _ = nearest(part, book)
            np.add.at(sums[j], code, part.T)
            np.add.at(counts[j], code, 1)
        return sums, counts

    def merge(one, other):
        return one[0] + other[0], one[1] + other[1]

    nothing = (np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64))
    sums, counts = blocks.select("n", "cells").rdd.map(tuple).treeAggregate(nothing, add, merge, depth=3)
    shared.unpersist()
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def _coded(blocks: DataFrame, books: np.ndarray, id_type: str, label_type: str) -> DataFrame:
    """Rows (id, label, code, error): every vector assigned once more."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = shared.value.shape[2]
        for batch in batches:
            ids, labels = batch.column("ids"), batch.column("labels")
            for k, n in enumerate(batch.column("n").to_pylist()):
                cells = np.frombuffer(batch.column("cells")[k].as_buffer(), np.int64).reshape(-1, n)
                code, error = np.zeros((n, len(shared.value)), np.uint8), np.zeros(n, np.int64)
                for j, book in enumerate(shared.value):
                    code[:, j], far = nearest(cells[j * width : (j + 1) * width], book)
                    error += far
                yield pa.RecordBatch.from_arrays([ids[k].values, labels[k].values, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id {id_type}, label {label_type}, code string, error bigint")


def compress(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Vectors as codes of one byte for each part.

    Returns a row per kept vector: ``id_col``, code (two hex digits for each part), error bigint (squared distance of
    the vector's whole numbers to its entries), label_error bigint (errors summed over equal labels, nulls together; held
    at the largest bigint), codebooks_sha256 (of all entries' components, in decimal, comma-joined). Vectors that are
    null or hold null or non-finite components are dropped; zero vectors are kept. Each dimension that occurs has
    codebooks of its own; a dimension that ``parts`` doesn't divide is filled up with zeros, and an empty vector is
    nothing but zeros. Rows that share an id are coded each; of equal ids the smaller vector is the earlier entry, and rows
    without an id come last. Fewer vectors than ``entries`` make as many entries. An empty table gives no rows; other
    columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256")
    spark = df.sparkSession
    ship_package(spark)
    rows = tidy(df, [id_col, vector_col, label_col]).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    good = rows.where("coalesce(forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)")
    kinds = dict(rows.dtypes)
    found = None
    for (size,) in sorted(tuple(r) for r in good.select(F.size("vector")).distinct().collect()):
        width = max(1, -(-size // parts)) * parts
        part = good.where(F.size("vector") == size)
        books = _first_entries(part, entries, scale, parts, width)

        def make(width=width):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                n = batch.num_rows
                one = np.asarray([n], np.int64) if n else np.zeros(0, np.int64)
                cells = [whole_numbers(batch.column("vector"), scale, width).tobytes()] if n else []
                return pa.RecordBatch.from_arrays([pa.array(one), pa.array(cells, pa.binary()), list_array(batch.column("id"), one), list_array(batch.column("label"), one)], ["n", "cells", "ids", "labels"])

            return step

        blocks = checkpointed(map_batches(part, make, f"n bigint, cells binary, ids array<{kinds['id']}>, labels array<{kinds['label']}>"))
        for _ in range(rounds):
            books = _round(blocks, books)
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        own = _coded(blocks, books, kinds["id"], kinds["label"]).withColumn("codebooks_sha256", F.lit(digest))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return rows.limit(0).select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    found = checkpointed(found)
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = checkpointed(found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(28,0)")).alias("total")).select(F.col("label").alias("_label"), F.least("total", most).cast("bigint").alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return found.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
