"""Relational building blocks: contracts, dedupe by an explicit order, validity, cascades, as-of joins, unions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import text, times
from waymark.session import checkpointed


def require_columns(df: DataFrame, columns: Iterable[str], source: str) -> DataFrame:
    """``df`` itself, or an error that names what ``source`` lacks."""
    if lacking := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{source}: missing columns {', '.join(lacking)}")
    return df


def clean_names(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Column names in lower case, trimmed, spaces as underscores, then renamed."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*[(renames or {}).get(n, n) for n in names])


def available(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def with_default(df: DataFrame, column: str, default) -> DataFrame:
    """A column that may be missing, with a default value then."""
    return df if column in df.columns else df.withColumn(column, F.lit(default))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``. Ranked in a window, of which Spark keeps one row per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "positie") -> DataFrame:
    """The first ``k`` rows per key, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def latest_valid(df: DataFrame, keys: Sequence[str], begin: str, end: str, day: Column, order: Sequence[Column]) -> DataFrame:
    """Rows valid on ``day``, the latest per key by ``order`` (given latest first)."""
    return first_per_key(df.where(times.valid_on(F.col(begin), F.col(end), day)), keys, order)


def valid_in_years(df: DataFrame, begin: str, end: str, years: Sequence[int]) -> DataFrame:
    """A row for each year on whose last day it is valid, as column ``jaar``."""
    each = df.withColumn("jaar", F.explode(F.array(*[F.lit(y) for y in years])))
    return each.where(times.valid_on(F.col(begin), F.col(end), F.concat(F.col("jaar").cast("string"), F.lit("-12-31"))))


def keep_members(df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
    """Rows whose key occurs among the members: a semi-join."""
    return df.join(members.select(F.col(member_key).alias("_member")).distinct(), F.col(key) == F.col("_member"), "left_semi")


def cascade(steps: Sequence[tuple[DataFrame, str, str]], start: DataFrame, start_key: str) -> list[DataFrame]:
    """Selections down a hierarchy: each step (table, parent key, own key) keeps rows of the parents kept before."""
    out, parents, key = [], start, start_key
    for table, parent_key, own_key in steps:
        parents = keep_members(table, parent_key, parents, key)
        key = own_key
        out.append(parents)
    return out


def groups_with_hit(df: DataFrame, key: str, hit: Column) -> DataFrame:
    """All rows of the groups in which at least one row is a hit."""
    return df.join(df.where(hit).select(F.col(key).alias("_group")).distinct(), F.col(key) == F.col("_group"), "left_semi")


def best_candidate(df: DataFrame, candidates: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Cascading match: of (name, condition, value) the first whose condition holds gives ``match`` and ``match_type``."""
    value, kind = F.lit(None), F.lit("geen_match")
    for name, condition, c in reversed(candidates):
        holds = F.coalesce(condition, F.lit(False))
        value, kind = F.when(holds, c).otherwise(value), F.when(holds, name).otherwise(kind)
    return df.withColumn("match", value).withColumn("match_type", kind)


def append_unmatched(base: DataFrame, more: DataFrame, condition: Column) -> DataFrame:
    """``base`` and those rows of ``more`` for which no row of ``base`` meets the (equi) condition; columns by name."""
    return base.unionByName(more.join(base, condition, "left_anti"), allowMissingColumns=True)


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows by column name, with nulls where a table lacks a column."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def asof_forward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, keep: Sequence[str]) -> DataFrame:
    """Each left row with the first right row of its key at or after its time (columns ``keep`` and ``right_time``).

    Both sides go on one timeline per key; one backward window fill finds the next event, so the join costs
    one shuffle by key and no pairs.
    """
    lefts = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    found = F.struct(F.col(right_time).alias(right_time), *[F.col(c) for c in keep])
    rights = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_left"), found.alias("_right"))
    line = lefts.withColumn("_right", F.lit(None).cast(rights.schema["_right"].dataType)).unionByName(rights.withColumn("_left", F.lit(None).cast(lefts.schema["_left"].dataType)))
    after = Window.partitionBy("_k").orderBy(F.col("_t").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = line.withColumn("_next", F.last("_right", ignorenulls=True).over(after)).where("_side = 0")
    return filled.select("_left.*", *[F.col("_next")[c].alias(c if c not in left.columns else f"next_{c}") for c in (right_time, *keep)])


def split_set(df: DataFrame, column: str, separator: str, keys: Sequence[str], out: str) -> DataFrame:
    """The distinct trimmed parts of a delimited text over each group, sorted and joined again."""
    parts = df.select(*keys, F.explode(F.split(F.col(column), separator)).alias("_part"))
    return parts.groupBy(*keys).agg(text.text_set(F.col("_part"), separator).alias(out))


def checks(rules: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """Data-quality records (onderwerp, verwacht, werkelijk, status): rows of each table that break its rule."""
    out = None
    for name, table, broken in rules:
        row = table.agg(F.count_if(broken).alias("werkelijk")).select(F.lit(name).alias("onderwerp"), F.lit(0).cast("bigint").alias("verwacht"), "werkelijk", F.when(F.col("werkelijk") == 0, "OK").otherwise("FOUT").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def active_services(calendar: DataFrame | None, exceptions: DataFrame, day: str) -> DataFrame:
    """Services that run on a day (yyyymmdd): by weekday and dates, with additions (1) and without removals (2)."""
    when = F.to_date(F.lit(day), "yyyyMMdd")
    regular = exceptions.select("service_id").limit(0)
    if calendar is not None:
        flag = times.weekday_flag(when, *[F.col(d).cast("string") for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
        regular = calendar.where((flag == "1") & F.lit(day).between(F.col("start_date").cast("string"), F.col("end_date").cast("string"))).select("service_id")
    today = exceptions.where(F.col("date").cast("string") == day)
    added = today.where(F.col("exception_type").cast("string") == "1").select("service_id")
    removed = today.where(F.col("exception_type").cast("string") == "2").select("service_id")
    return regular.union(added).distinct().join(removed, "service_id", "left_anti")


def dense_numbers(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in an explicit order, without a window over the whole table.

    Rows are dealt by ranges of the order and sorted; the driver sees one count per range, and each range begins behind those before it.
    """
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {int(r["p"]): int(r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    # as many rows as ranges
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint"))
    return ranged.join(base, part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same ones each time: those whose key hashes lowest with the seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, empty ones as (leeg), the most frequent first."""
    return df.groupBy(F.coalesce(text.blank_to_null(F.col(column)), F.lit("(leeg)")).alias(column)).agg(F.count("*").alias("aantal")).orderBy(F.col("aantal").desc(), F.col(column))


def unique_or_fail(df: DataFrame, key: str, source: str) -> DataFrame:
    """``df`` if no key occurs twice, else an error that shows one."""
    if twice := df.groupBy(key).count().where("count > 1").head(1):
        raise ValueError(f"{source}: {key} {twice[0][0]} occurs {twice[0][1]} times")
    return df


def matched_or_fail(left: DataFrame, right: DataFrame, key: str, source: str) -> DataFrame:
    """A left join by normalised id in which each left row must find one right row."""
    there = unique_or_fail(right.withColumn("_key", text.plain_id(F.col(key))).drop(key), "_key", source)
    rows = left.join(there.withColumn("_found", F.lit(True)), text.plain_id(F.col(key)) == F.col("_key"), "left")
    if missing := rows.where("_found is null").select(key).head(1):
        raise ValueError(f"{source}: nothing for {missing[0][0]}")
    return rows.drop("_key", "_found")
