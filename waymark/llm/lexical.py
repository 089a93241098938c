"""Ranked lexical search: the documents that share weighty terms with an item.

Postings (document, term, how often) are a table, sorted by term bucket within every shard of documents, so a search
reads the buckets of its terms and skips the rest by their column statistics. Item terms are joined with postings by bucket and term;
each match has a whole-number score, and scores are added up per item and document. All postings of a document lie in one
task by then, so the sums, by far the largest table of a search, need no shuffle, and only the best of each task go on.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import list_array, map_batches, tidy
from waymark.session import checkpointed, ship_package, written

#: Term buckets of the postings.
BUCKETS = 256
#: Item terms that go to every executor, in rows and bytes; more are joined by a shuffle.
BROADCAST_TERMS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Sums of items and documents that one task makes.
TASK_SUMS = 1_000_000
#: Bytes as terms see them: letters and digits of ASCII in lower case, all bytes beyond ASCII, and spaces for the rest.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order, with repeats: runs of ASCII letters and digits, in lower case, and of any characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item, bucket, term): the terms of every item, once each, whatever rows they come from."""
    rows = tidy(items, [item_col, text_col]).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            flat = pa.array([t.decode() for f in found for t in f], pa.string())
            return pa.RecordBatch.from_arrays([batch.column("item"), list_array(flat, np.asarray([len(f) for f in found], np.int64))], ["item", "terms"])

        return step

    kind = dict(rows.dtypes)["item"]
    return map_batches(rows, make, f"item {kind}, terms array<string>").select("item", F.explode("terms").alias("term")).distinct().select("item", bucket("term").alias("bucket"), "term")


def postings(docs: DataFrame, wanted: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of postings: row (a number for the document), doc, n (its terms), bucket, term, tf.

    Every document that has terms also has one row without a term or bucket, with tf 0. ``wanted`` keeps only these terms. Every row of ``docs``
    is a document of its own. The table is sorted by bucket and term in each file.
    """
    rows = tidy(docs, [id_col, text_col]).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def make():
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        asked = shared.value if shared is not None else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            at, n, term, tf, name = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = terms_of(text)
                if not found:
                    continue
                count = Counter(found)
                held = list(count) if asked is None else list(asked & count.keys() if len(asked) < len(count) else count.keys() & asked)
                at += [k] * (len(held) + 1)
                n += [len(found)] * (len(held) + 1)
                name += [number] * (len(held) + 1)
                term += [None, *(t.decode() for t in held)]
                tf += [0, *(count[t] for t in held)]
                number += 1
            columns = [pa.array(name, pa.int64()), batch.column("doc").take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(term, pa.string()), pa.array(tf, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["row", "doc", "n", "term", "tf"])

        return step

    kind = dict(rows.dtypes)["doc"]
    listed = map_batches(rows, make, f"row bigint, doc {kind}, n bigint, term string, tf bigint")
    return written(listed.withColumn("bucket", F.when(F.col("term").isNotNull(), bucket("term"))).sortWithinPartitions("bucket", "term"), "postings")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` documents of highest score for each item: ``item_col``, rank int (from 1), ``id_col``, score bigint.

    A term's weight falls with the documents that hold it, a match's score rises with the term's repeats and falls with the
    document's length; all is whole numbers but the logarithm. Only scores above 0 count, and equal ones go by ascending id, rows without
    an id last. Rows of ``items`` that share an id are one item, those without an id too; items without terms, or with none that a
    document holds, give no rows. Every row of ``docs`` is a document; repeated ones have ranks of their own. Null and empty texts have
    no terms and don't count as documents. An empty table on either side gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    asked = checkpointed(item_terms(items, item_col, item_text_col))
    size = asked.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes"), F.count_distinct("item").alias("items")).first()
    small = size["rows"] <= BROADCAST_TERMS and size["bytes"] <= BROADCAST_BYTES
    wanted = frozenset(r["term"].encode() for r in asked.select("term").distinct().toLocalIterator()) if small else None
    held = postings(docs, wanted, id_col, text_col)
    whole = held.where("term is null").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()
    n_docs, n_terms = int(whole["docs"]), int(whole["terms"])
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    holders = held.where("term is not null").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weighed = checkpointed(asked.join(holders, ["bucket", "term"]).select("item", "bucket", "term", weight.alias("weight")).where("weight > 0"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs * int(size["items"]) // TASK_SUMS + 1)
    length = F.expr(f"50 + (50 * n * {n_docs}L) div {n_terms}L")
    by_doc = held.where("term is not null").select("row", "doc", length.alias("m"), "bucket", "term", "tf").repartition(shards, "row")
    matches = by_doc.join(F.broadcast(weighed) if small else weighed, ["bucket", "term"])
    scored = matches.groupBy("row", "doc", "item").agg(F.sum(F.expr("weight * ((1000000000L * tf) div (1000 * tf + 20 * m))")).alias("score")).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")
