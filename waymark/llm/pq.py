"""Embedding near-duplicates by product quantisation.

Unit vectors are assigned to coarse inverted lists; each residual is stored as one code per subspace.
A query visits the lists nearest to it, reads asymmetric distances to their codes from lookup tables and
drops a candidate only if its distance minus the candidate's own quantisation error exceeds the radius,
which the triangle inequality makes safe. What is left is ranked again by the exact cosine in double precision.

A task that compares a list's members with its visitors gives out how many links each of them has there, and a spanning
forest of these links: never more rows than it has read, however dense a group of vectors is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import components, least_reachable, list_array, map_batches, tidy
from waymark.session import checkpointed, ship_package

#: The index is fitted on at most so many distinct vectors, and so many bytes of them; all are indexed.
TRAIN_ROWS, TRAIN_BYTES = 32_768, 64 << 20
#: Vectors for each list, lists that a query visits, subspaces, and codes for each subspace.
LIST_ROWS, PROBES, SUBSPACES, CODES = 256, 16, 16, 256
#: Members and queries that one task compares at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Index:
    lists: np.ndarray  # (n, d) coarse centroids
    codebook: np.ndarray  # (subspaces, codes, d / subspaces)

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.codebook.shape[0] * self.codebook.shape[2] - x.shape[1])))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row, nearest first."""
        far = (self.lists**2).sum(1)[None] - 2 * x @ self.lists.T
        n = min(n, len(self.lists))
        some = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals to list ``at``, and how far each reconstruction is off."""
        residual = self.pad(x - self.lists[at])
        m, _, w = self.codebook.shape
        code, off = np.empty((len(x), m), np.uint8), np.zeros(len(x))
        for j in range(m):
            part = residual[:, j * w : (j + 1) * w]
            book = self.codebook[j]
            far = (book**2).sum(1)[None] - 2 * part @ book.T
            code[:, j] = far.argmin(1)
            off += ((part - book[code[:, j]]) ** 2).sum(1)
        return code, np.sqrt(off)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; empty cells restart at random rows."""
    k = min(k, len(x))
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([((centre**2).sum(1)[None] - 2 * x[a : a + 8192] @ centre.T).argmin(1) for a in range(0, len(x), 8192)])
        count = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(count[filled])[:-1]]), axis=0)
        centre[filled] = sums / count[filled, None]
        if len(empty := np.flatnonzero(count == 0)):
            centre[empty] = x[rng.choice(len(x), len(empty))]
    return centre


def fit(sample: np.ndarray, rows: int) -> Index:
    """Fits lists and codebooks on a sample of unit vectors out of ``rows``."""
    rng = np.random.default_rng(7)
    sample = np.ascontiguousarray(sample, np.float32)
    lists = kmeans(sample, int(np.clip(rows // LIST_ROWS, 8, 4096)), 8, rng)
    own = np.concatenate([((lists**2).sum(1)[None] - 2 * sample[a : a + 8192] @ lists.T).argmin(1) for a in range(0, len(sample), 8192)])
    some = rng.choice(len(sample), min(len(sample), 8192), replace=False)
    residual = sample[some] - lists[own[some]]
    width = -(-sample.shape[1] // SUBSPACES)
    residual = np.pad(residual, ((0, 0), (0, width * SUBSPACES - residual.shape[1])))
    books = np.zeros((SUBSPACES, CODES, width), np.float32)
    for j in range(SUBSPACES):
        book = kmeans(residual[:, j * width : (j + 1) * width], CODES, 6, rng)
        books[j, : len(book)] = book
        books[j, len(book) :] = book[0]
    return Index(lists, books)


def unit(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(flat.reshape(len(column), -1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors. Each is divided by its largest component first, so no square overflows or vanishes."""
    if not x.size:
        return x
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable(col: str):
    """Whether a vector has a direction: not null or empty, no null or non-finite component, not all zero."""
    return F.expr(f"coalesce(size(`{col}`) > 0 and forall(`{col}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(`{col}`, x -> x <> 0), false)")


def _join(index: Index, least: float):
    """The co-group function of one block of a list's members and one block of queries that visit it.

    A pair meets in the list of either one if the other visits it. It counts for both where the member's own visit to the
    query's list can't find it, and otherwise for the query here and for the member there.
    """
    radius = np.sqrt(max(0.0, 2 - 2 * least))

    def run(key: tuple, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(queries):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        x = unit_rows(np.stack(members["vector"].to_numpy()).astype(np.float64))
        q = unit_rows(np.stack(queries["wanted"].to_numpy()).astype(np.float64))
        code = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(x), -1)
        bound = (radius + members["off"].to_numpy() + 1e-5) ** 2
        ids, asks = members["id"].to_numpy(), queries["ask"].to_numpy()
        copies, ask_copies = members["n"].to_numpy(), queries["ask_n"].to_numpy()
        visits, home = np.stack(members["probes"].to_numpy()), queries["ask_home"].to_numpy()
        names, place = np.unique(np.concatenate([ids, asks]), return_inverse=True)
        at_member, at_query = place[: len(ids)], place[len(ids) :]
        links, low = np.zeros(len(names), np.int64), np.arange(len(names))
        residual = index.pad((q - index.lists[key[0]]).astype(np.float32))
        m, _, w = index.codebook.shape
        for start in range(0, len(q), 256):
            part = residual[start : start + 256]
            far = np.zeros((len(part), len(x)), np.float32)
            for j in range(m):
                sub = part[:, j * w : (j + 1) * w]
                book = index.codebook[j]
                table = (sub**2).sum(1)[:, None] - 2 * sub @ book.T + (book**2).sum(1)[None]
                far += np.take(table, code[:, j], axis=1)
            rows, cols = np.nonzero(far <= bound[None])
            edges = []
            for k in range(0, len(rows), 1 << 16):
                r, c = rows[k : k + (1 << 16)] + start, cols[k : k + (1 << 16)]
                near = ((q[r] * x[c]).sum(1) >= least) & (asks[r] != ids[c])
                r, c = r[near], c[near]
                np.add.at(links, at_query[r], copies[c])
                lone = ~(visits[c] == home[r][:, None]).any(axis=1)
                np.add.at(links, at_member[c[lone]], ask_copies[r[lone]])
                edges.append((at_query[r], at_member[c]))
            if edges:
                known = np.flatnonzero(low != np.arange(len(low)))
                low = least_reachable(len(names), np.concatenate([known, *(e[0] for e in edges)]), np.concatenate([low[known], *(e[1] for e in edges)]))
        joined, linked = np.flatnonzero(low != np.arange(len(low))), np.flatnonzero(links)
        return pd.DataFrame({"a": np.concatenate([names[joined], names[linked]]), "b": np.concatenate([names[low[joined]], names[linked]]), "links": np.concatenate([np.zeros(len(joined), np.int64), links[linked]])})

    return run


def similar(vectors: DataFrame, least: float) -> DataFrame:
    """How distinct vectors (id bigint, vector array, n bigint) with a cosine of at least ``least`` hang together.

    Rows (a, b, links): edges of spanning forests, a > b and links 0; and, with a = b, links of a vector to others, each
    counted ``n`` times, to be added up. All vectors must be usable and of one dimension. A list and its queries are
    compared in blocks of bounded size, so that a list that holds a third of all vectors is the work of many tasks.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.count()
    if not rows:
        return spark.createDataFrame([], "a bigint, b bigint, links bigint")
    width = len(vectors.select("vector").first()[0])
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(min(TRAIN_ROWS, max(1024, TRAIN_BYTES // (8 * width)))).select("vector").toArrow()
    index = fit(unit(sample.column("vector").combine_chunks()), rows)
    shared = spark.sparkContext.broadcast(index)

    def make():
        own = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = unit(batch.column("vector"))
            near = own.nearest(x.astype(np.float32), PROBES)
            code, off = own.encode(x.astype(np.float32), near[:, 0])
            probes = list_array(pa.array(near.ravel().astype(np.int32)), np.full(len(x), near.shape[1]))
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), batch.column("n"), probes, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(off)], ["id", "vector", "n", "probes", "code", "off"])

        return step

    kind = dict(vectors.dtypes)["vector"]
    coded = checkpointed(map_batches(vectors.select("id", "vector", "n"), make, f"id bigint, vector {kind}, n bigint, probes array<int>, code binary, off double"))
    # how many members and visits each list has: as many counts as lists, at most 4096
    count = coded.select(F.explode(F.transform("probes", lambda p, i: F.struct(p.alias("list"), (i == 0).cast("int").alias("own")))).alias("p")).groupBy("p.list").agg(F.sum("p.own").alias("members"), F.count("*").alias("visits"))
    split = spark.createDataFrame([(int(r["list"]), max(1, -(-int(r["members"]) // BLOCK)), max(1, -(-int(r["visits"]) // BLOCK))) for r in count.collect()], "list int, member_blocks int, query_blocks int")
    spread = F.broadcast(split)
    home = F.col("probes")[0]
    members = coded.withColumn("list", home).join(spread, "list").select("list", F.pmod(F.xxhash64("id"), "member_blocks").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), "id", "vector", "n", "probes", "code", "off")
    asked = coded.select(F.col("id").alias("ask"), F.col("vector").alias("wanted"), F.col("n").alias("ask_n"), home.alias("ask_home"), F.explode("probes").alias("list")).join(spread, "list")
    queries = asked.select(F.col("list").alias("q_list"), F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("q_mb"), F.pmod(F.xxhash64(F.col("ask") + 1), "query_blocks").cast("int").alias("q_qb"), "ask", "wanted", "ask_n", "ask_home")
    find = _join(index, least)
    return members.groupBy("list", "mb", "qb").cogroup(queries.groupBy("q_list", "q_mb", "q_qb")).applyInPandas(find, "a bigint, b bigint, links bigint")


def near_duplicates(df: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links and components of vectors by cosine.

    Returns a row per vector: ``id_col``, n_links bigint (other vectors with a cosine of at least ``least``,
    found through the index), component_id (smallest id reachable by links, itself included), kept (whether
    it is that one). Equal vectors are one class, compared once and linked with each other; a row that occurs
    twice counts as two vectors. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and vectors of different dimensions not with each other; each dimension has an index of its own.
    Rows with a null id take part in counts only. Other columns are ignored; an empty table gives no rows.
    """
    rows = tidy(df, [id_col, vector_col]).select(F.col(id_col).cast("bigint").alias(id_col), F.col(vector_col).alias("vector"))
    good = rows.where(usable("vector"))
    classes = checkpointed(good.groupBy("vector").agg(F.min(id_col).alias("id"), F.count("*").alias("n")).where("id is not null"))
    distinct = classes.select("id", "vector", "n")
    # as many passes as there are dimensions, one as a rule
    widths = [int(r["w"]) for r in distinct.groupBy(F.size("vector").alias("w")).count().orderBy("w").collect()]
    found = None
    for width in widths:
        part = checkpointed(similar(distinct.where(F.size("vector") == width), least))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "a bigint, b bigint, links bigint")
    degree = found.where("a = b").groupBy("a").agg(F.sum("links").alias("others"))
    found = components(found.where("a <> b").select("a", "b"))
    named = (
        classes.join(degree, classes["id"] == degree["a"], "left")
        .join(found, classes["id"] == found["node"], "left")
        .select(F.col("vector").alias("_vector"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked = rows.join(named, rows["vector"] == named["_vector"], "left")
    component = F.coalesce("component_id", id_col)
    return linked.select(id_col, F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(id_col), F.lit(False)).alias("kept"))
