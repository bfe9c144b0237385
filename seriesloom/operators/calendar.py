"""Calendar completion and calendar gaps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.keyed import series_window


def fill_days(df: DataFrame, keys: list[str], reach: int | None = None, carried: list[str] = ()) -> DataFrame:
    """Add the missing days between observed ones as rows with NULL values (``observed`` = false).

    Every observed row emits itself and the gap behind it, so there is neither a calendar
    table nor a join, and the partitioning by ``keys`` is kept. ``reach`` limits how many days
    are added behind a row, for callers that drop the rest anyway. An added day takes the
    ``carried`` columns of the row before it: what is carried forward is found on the observed rows, which are fewer.
    """
    w = series_window(keys)
    nxt = F.coalesce(F.lead("day").over(w), F.col("day") + 1) - 1
    if reach is not None:
        nxt = F.least(nxt, F.col("day") + reach)
    values = [c for c in df.columns if c not in (*keys, "day", "date")]
    rows = df.withColumn("_until", nxt).withColumn("_at", F.explode(F.sequence("day", "_until")))
    own = F.col("_at") == F.col("day")
    return rows.select(
        *keys, F.date_from_unix_date("_at").alias("date"), F.col("_at").alias("day"),
        own.alias("observed"), *[F.col(c) if c in carried else F.when(own, F.col(c)).alias(c) for c in values])


def missing_days(df: DataFrame, keys: list[str]) -> DataFrame:
    """Days between an entity's first and last row on which it has none."""
    days = df.select(*keys, "day").distinct()
    w = series_window(keys)
    gaps = days.withColumn("_next", F.lead("day").over(w)).filter(F.col("_next") > F.col("day") + 1)
    return gaps.select(*keys, F.explode(F.sequence(F.col("day") + 1, F.col("_next") - 1)).alias("_d")) \
               .select(*keys, F.date_from_unix_date("_d").alias("missing_date"))


def rows_per_day(df: DataFrame, date: str = "date") -> DataFrame:
    return df.groupBy(F.col(date).alias("date")).agg(F.count("*").alias("n"))


def full_days(df: DataFrame, above: int, since: dt.date, date: str = "date") -> DataFrame:
    """Days from ``since`` on that hold more than ``above`` rows."""
    return rows_per_day(df.filter(F.col(date) >= F.lit(since)), date).filter(F.col("n") > above)


def incomplete_days(df: DataFrame, above: int, since: dt.date, date: str = "date") -> DataFrame:
    """Days from ``since`` to the last full day that are not full. No full day: no row."""
    full = full_days(df, above, since, date)
    span = full.agg(F.max("date").alias("hi")).filter(F.col("hi").isNotNull())
    every = span.select(F.explode(F.sequence(F.lit(since), F.col("hi"))).alias("date"))
    return every.join(full, "date", "left_anti")
