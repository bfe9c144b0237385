"""Per-entity picks and duplicate handling, written as aggregates so that the map side combines
before the shuffle: an entity holding a large share of all rows costs one row per task.

Picks of whole rows or of several values first take the greatest (or least) date of each key, a number of fixed width that a hash
aggregate holds, and then only look at the rows that lie there. What is sorted are those few rows, never the raw ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY = ["collection_identifier", "chain"]


def series_window(keys: list[str], order: str = "day"):
    """One series in calendar order. Callers feed it at most one row per key and day, so a
    partition is never longer than the calendar."""
    return Window.partitionBy(*keys).orderBy(order)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash the series over the session's shuffle partitions ahead of its windows.

    It is the exchange the windows need anyway. The explicit number keeps AQE from merging
    partitions by their bytes: sliding windows are bound by CPU, not by size.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def apart(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions, none exchanged: what comes before and what comes after are generated as code of their own.

    The JVM compiles no method of more than 8,000 bytes and interprets it for every row; many wide steps in one stage make one.
    """
    return df.coalesce(1 << 30)  # never more partitions than there are


def last_known(c: str, by: str | Column) -> Column:
    """Aggregate: the non-null value of ``c`` with the greatest ``by``."""
    order = F.col(by) if isinstance(by, str) else by
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, F.col(c))))


def first_known(c: str, by: str | Column) -> Column:
    """Aggregate: the non-null value of ``c`` with the smallest ``by``."""
    order = F.col(by) if isinstance(by, str) else by
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, F.col(c))))


def dedupe_days(df: DataFrame, keys: list[str], date: str = "date", price: str = "floor_native",
                columns: list[str] | None = None, count_as: str | None = None) -> DataFrame:
    """One row per (keys, date). Each column takes its own first non-null value in descending
    price order (missing prices last), ties going to the greater value."""
    columns = columns or [c for c in df.columns if c not in (*keys, date)]
    picks = [last_known(c, price).alias(c) for c in columns]
    if count_as:
        picks.append(F.count("*").alias(count_as))
    return df.groupBy(*keys, date).agg(*picks)


def _bounds(df: DataFrame, keys: list[str], *bounds: Column) -> tuple[DataFrame, Column]:
    """Bounds of each key and the condition (NULL equal to NULL) that joins them to the rows."""
    named = [f"_key{i}" for i in range(len(keys))]
    found = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named)]).agg(*bounds)
    same = F.lit(True)
    for k, n in zip(keys, named):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return found, same


def latest_known(df: DataFrame, keys: list[str], columns: list[str], date: str = "date",
                 until=None) -> DataFrame:
    """Per key: the latest date and, per column, the latest non-null value up to ``until``, ties to the greater value."""
    if until is not None:
        df = df.filter(F.col(date) <= until)
    df = df.select(*keys, F.col(date).alias("_date"), *[c for c in columns if c not in keys])
    at = {c: f"_at{i}" for i, c in enumerate(columns)}
    bounds, same = _bounds(df, keys, F.max("_date").alias("_top"),
                           *[F.max(F.when(F.col(c).isNotNull(), F.col("_date"))).alias(a) for c, a in at.items()])
    there = {c: F.col(c).isNotNull() & F.col("_date").eqNullSafe(F.col(a)) for c, a in at.items()}
    some = F.col("_date").eqNullSafe(F.col("_top"))
    for hit in there.values():
        some = some | hit
    near = df.join(bounds, same & some)
    return near.groupBy(*keys).agg(F.max("_date").alias(date), *[F.max(F.when(hit, F.col(c))).alias(c) for c, hit in there.items()])


def latest_row(df: DataFrame, keys: list[str], date: str = "date", tie: list[str] = ()) -> DataFrame:
    """The whole row at each key's latest date; ``tie`` columns (descending) settle equal dates."""
    bounds, same = _bounds(df, keys, F.max(date).alias("_top"))
    near = df.join(bounds, same & F.col(date).eqNullSafe(F.col("_top"))).select(*df.columns)
    return last_row(near, keys, [date, *tie])


def last_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole row that comes last per key in ``order`` (NULLs first), in one pass: for tables of one row a key or few."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
              .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns))


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The whole row that comes first per key in ascending ``order`` (NULLs first), in one pass like ``last_row``."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
              .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns))


def pair_counts(prices: DataFrame) -> DataFrame:
    """Rows per (slug, entity)."""
    return prices.groupBy("slug", *ENTITY).agg(F.count("*").alias("cnt"))


def canonical_ids(prices: DataFrame) -> DataFrame:
    """One entity per slug: the one with most rows, ties to the smaller identifier."""
    counts = pair_counts(prices).filter(F.col("collection_identifier").isNotNull() & F.col("chain").isNotNull())
    bounds, same = _bounds(counts, ["slug"], F.max("cnt").alias("_most"))
    most = counts.join(bounds, same & (F.col("cnt") == F.col("_most")))
    return (most.groupBy("slug").agg(F.min(F.struct(*ENTITY, "cnt")).alias("c"))
                .select("slug", "c.collection_identifier", "c.chain", "c.cnt"))


def keep_canonical(prices: DataFrame) -> DataFrame:
    """Price rows of canonical entities only. A semi join: two slugs on one entity do not double it."""
    return prices.join(canonical_ids(prices).select(*ENTITY), ENTITY, "left_semi")


def entities_with_history(prices: DataFrame, min_days: int) -> DataFrame:
    """Rows of entities that have at least ``min_days`` rows; counted by an aggregate and kept by
    a semi join, so no entity is gathered for it."""
    enough = prices.groupBy(*ENTITY).agg(F.count("*").alias("n")).filter(F.col("n") >= min_days)
    return prices.join(enough.select(*ENTITY), ENTITY, "left_semi")


def first_of_day(df: DataFrame, keys: list[str], ts: str, tie: list[str] = ()) -> DataFrame:
    """Hourly snapshots to daily: the earliest row per (keys, day)."""
    daily = df.withColumn("date", F.to_date(ts))
    bounds, same = _bounds(daily, [*keys, "date"], F.min(ts).alias("_first"))
    near = daily.join(bounds, same & F.col(ts).eqNullSafe(F.col("_first"))).select(*daily.columns)
    rest = [c for c in df.columns if c not in (*keys, "date")]
    return first_row(near, [*keys, "date"], [ts, *tie]).select(*keys, "date", *rest)
