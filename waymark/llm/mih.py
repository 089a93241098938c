"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, and every segment value is a bucket. A query looks at buckets whose value is
within radius 0, then 1, and so on, of its own segment. With m segments all searched to radius r, every code
within m * (r + 1) - 1 bits has been met, so a query is done once its kth verified distance is no larger
(Norouzi, Punjani and Fleet, 2014).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import tidy
from waymark.session import checkpointed

SEGMENT_BITS = 16


def sign_code(col: str):
    """The sign bits of a vector as an array of 64-bit words: bit i of a word is 1 where component i is above 0.

    Null for vectors that are null or empty or hold null or NaN components.
    """
    bits = f"transform(`{col}`, x -> if(x > 0, 1L, 0L))"
    words = f"transform(sequence(0, cast((size(`{col}`) - 1) div 64 as int)), w -> aggregate(slice({bits}, w * 64 + 1, 64), struct(0L as word, 0 as at), (s, b) -> struct(s.word | shiftleft(b, s.at) as word, s.at + 1 as at), s -> s.word))"
    return F.expr(f"case when `{col}` is not null and size(`{col}`) > 0 and forall(`{col}`, x -> x is not null and not isnan(x)) then {words} end")


def _distance(a: str, b: str):
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, d) -> s + d)")


def _segments(code: str):
    """Array of struct(segment, value) of a code."""
    per = 64 // SEGMENT_BITS
    return F.expr(f"transform(sequence(0, size({code}) * {per} - 1), i -> struct(i as segment, cast(shiftrightunsigned({code}[cast(i div {per} as int)], cast(i % {per} as int) * {SEGMENT_BITS}) & {(1 << SEGMENT_BITS) - 1} as int) as value))")


def _masks(radius: int) -> list[int]:
    return [sum(1 << b for b in some) for some in combinations(range(SEGMENT_BITS), radius)]


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """The ``k`` nearest rows of ``df`` for every row of ``queries`` by Hamming distance, exactly.

    Both have an id and a code, an array<bigint> of one length. Returns query_id, neighbor_id, distance int and rank
    int from 1, by distance and then id; a query's own id is not its neighbour. Fewer rows than ``k`` give
    fewer neighbours. Rows without an id or code take part in nothing; of repeated ids the code that sorts first counts.
    Equal codes are searched once: of each, only the ``k`` + 1 smallest ids can matter, and they are picked before
    the shuffle. Other columns are ignored.
    """
    spark = df.sparkSession

    def clean(t: DataFrame) -> DataFrame:
        t = tidy(t, [id_col, code_col]).select(F.col(id_col).cast("bigint").alias("id"), F.col(code_col).alias("code"))
        return t.where("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code"))

    rows = clean(df)
    usual = rows.groupBy(F.size("code").alias("words")).agg(F.count("*").alias("n")).where("words > 0").orderBy(F.desc("n"), "words").first()
    if usual is None:
        return spark.createDataFrame([], "query_id bigint, neighbor_id bigint, distance int, rank int")
    fits = F.size("code") == usual["words"]
    by_code = Window.partitionBy("code").orderBy("id")
    members = checkpointed(rows.where(fits).withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= k + 1).select("id", "code", "place"))
    # a code is known by its smallest id
    codes = checkpointed(members.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("code_id")))
    buckets = checkpointed(codes.select("code_id", "code", "n", F.explode(_segments("code")).alias("s")).select("code_id", "code", "n", "s.segment", "s.value"))
    asked = checkpointed(clean(queries).where(fits).select(F.col("id").alias("query_id"), F.col("code").alias("query")))
    segments = int(usual["words"]) * (64 // SEGMENT_BITS)
    open_queries = asked
    found = spark.createDataFrame([], "query_id bigint, code_id bigint, n bigint, distance int")
    for radius in range(SEGMENT_BITS + 1):
        masks = spark.createDataFrame([(m,) for m in _masks(radius)], "mask int")
        probes = open_queries.select("query_id", "query", F.explode(_segments("query")).alias("s")).select("query_id", "query", "s.segment", "s.value").join(F.broadcast(masks)).select("query_id", "query", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        met = probes.join(buckets, ["segment", "value"]).groupBy("query_id", "code_id").agg(F.first("n").alias("n"), F.first(_distance("query", "code")).cast("int").alias("distance"))
        found = found.unionByName(met.select("query_id", "code_id", "n", "distance")).groupBy("query_id", "code_id").agg(F.min("n").alias("n"), F.min("distance").alias("distance"))
        # beyond the k + 1st row (a query may meet itself) nothing found can matter
        nearer = Window.partitionBy("query_id").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        found = checkpointed(found.withColumn("nearer", F.coalesce(F.sum("n").over(nearer), F.lit(0))).where(F.col("nearer") <= k).drop("nearer"))
        covered = segments * (radius + 1) - 1
        done = found.where(F.col("distance") <= covered).groupBy("query_id").agg(F.sum("n").alias("n")).where(F.col("n") >= k + 1)
        open_queries = checkpointed(open_queries.join(done, "query_id", "left_anti"))
        if not open_queries.head(1):
            break
    ranked = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    named = members.join(codes.select(F.col("code").alias("_code"), "code_id"), F.col("code") == F.col("_code")).select("code_id", F.col("id").alias("neighbor_id"))
    rows = found.join(named, "code_id").where("neighbor_id <> query_id")
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "neighbor_id", "distance", "rank")
