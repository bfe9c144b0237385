"""As-of joins, values at a horizon, interpolation on an even grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.keyed import latest_known, series_window


def latest_until(df: DataFrame, signals: DataFrame, keys: list[str], columns: list[str], until) -> DataFrame:
    """Left join of each entity's latest known signal values up to one shared date."""
    latest = latest_known(signals, keys, columns, until=until).select(*keys, *columns)
    return df.join(latest, keys, "left")


#: Days of one key are cut into slices where they hold more rows, at most so many days, by so many quantiles of their times.
SLICED, MOST_SLICED, CUTS = 200_000, 20_000, 63
#: Parts of the rows of one side at one time that a quantile hits.
PARTS = 16


def time_chunks(both: DataFrame, keys: list[str], sliced: int = SLICED) -> DataFrame:
    """Rows (keys, _ts, _side) with ``_chunk``: (day, slice of the day, part), in the order of time inside a key.

    A key's day of more than ``sliced`` rows is cut at quantiles of its times, so that a slice holds about as many rows as any
    other. A time that holds so many rows that it is a quantile is cut further, by a hash: first the right rows' parts, then
    the left rows', as a left row finds right rows of its own time. The days to cut are the largest, at most
    MOST_SLICED of them: any other holds fewer than one row in MOST_SLICED.
    """
    day = F.to_date("_ts")
    narrow = both.select(*keys, day.alias("_day"), F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(both.schema["_ts"].dataType), "_ts").alias("_at"))
    large = narrow.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > sliced)
    large = large.orderBy(F.desc("_n"), *keys, "_day").limit(MOST_SLICED).drop("_n").collect()
    if not large:
        none = F.lit(0).cast("int")
        return both.withColumn("_chunk", F.struct(day.alias("day"), none.alias("slice"), none.alias("part")))
    named = [*[f"_key{i}" for i in range(len(keys))], "_on"]
    large = both.sparkSession.createDataFrame([tuple(r) for r in large], narrow.select(*keys, "_day").toDF(*named).schema)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*keys, "_day"], named)]
    share = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    cuts = narrow.join(F.broadcast(large), same).groupBy(*named).agg(F.percentile_approx("_at", share, 10_000).alias("_cuts"))
    rows = both.withColumn("_day", day).withColumn(
        "_at", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(both.schema["_ts"].dataType), "_ts"))
    rows = rows.join(F.broadcast(cuts), same, "left")
    part = F.pmod(F.xxhash64(*[c for c in both.columns if c != "_ts"]), F.lit(PARTS)) + 1 + F.col("_side") * PARTS
    hit = F.coalesce(F.array_contains("_cuts", F.col("_at")), F.lit(False))
    chunk = F.struct(F.col("_day").alias("day"), F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_at"))), F.lit(0)).alias("slice"),
                     F.when(hit, part).otherwise(0).cast("int").alias("part"))
    return rows.withColumn("_chunk", chunk).select(*both.columns, "_chunk")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str],
              tie: str, sliced: int = SLICED) -> DataFrame:
    """For every left row the ``columns`` of the latest right row of its key at or before ``ts``.

    A key may own a large share of all rows, and a day of it too, so a series is never gathered: rows are windowed
    inside (key, chunk of time), where chunks of a busy day are as fine as its rows ask for, and the value carried into a chunk
    comes from a window over one summary row per chunk. ``tie`` orders right rows of equal time (the greatest wins). A
    left row with a NULL key or time finds nothing.
    """
    value = F.struct(F.col(ts).alias("asof_ts"), *columns)
    for c in (*keys, ts):  # NULL equals nothing
        right = right.filter(F.col(c).isNotNull())
    tie_type = right.schema[tie].dataType
    lcols = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"),
                    F.struct(*lcols).alias("_row"))
    rr = right.select(*keys, F.col(ts).alias("_ts"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"),
                      value.alias("_val"))
    both = time_chunks(l.unionByName(rr, allowMissingColumns=True), keys, sliced)

    ends = both.groupBy(*keys, "_chunk").agg(F.max(F.when(F.col("_side") == 0, F.struct("_ts", "_tie", "_val"))).alias("_end"))
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    carry = ends.withColumn("_carry", F.max("_end").over(
        over_chunks.rowsBetween(Window.unboundedPreceding, -1))["_val"]).drop("_end")

    inside = Window.partitionBy(*keys, "_chunk").orderBy("_ts", "_side", "_tie") \
                   .rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.last("_val", ignorenulls=True).over(inside)).filter(F.col("_side") == 1)
    out = found.join(carry, [*keys, "_chunk"], "left").withColumn("_hit", F.coalesce("_in", "_carry"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in lcols], "_hit.asof_ts",
                      *[F.col(f"_hit.{c}").alias(c) for c in columns])


def value_near(value: str, w, horizon: int, offsets: tuple[int, ...] = (0, 1, -1, 2, -2)) -> Column:
    """Value ``horizon`` days ahead, else at the first neighbouring day of ``offsets`` that has one.

    One-day RANGE frames over the series, so there is no join.
    """
    return F.coalesce(*[F.max(value).over(w.rangeBetween(horizon + o, horizon + o)) for o in offsets])


def even_grid(df: DataFrame, keys: list[str], value: str, at_least: int = 10) -> DataFrame:
    """Linear interpolation on max(``at_least``, rows) evenly spaced points from the first to the
    last row; rows without a value are skipped, and beyond the outer values the nearest line goes on.

    Grid point k lies ``k * span / (n - 1)`` days behind the start. Every pair of neighbouring
    values emits the points between them, found in whole numbers, so no point falls out or doubles.
    """
    w = series_window(keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.select(*keys, "day", F.col(value).cast("double").alias("v")).withColumns({
        "day0": F.min("day").over(whole), "span": F.max("day").over(whole) - F.min("day").over(whole),
        "n": F.greatest(F.count("*").over(whole), F.lit(at_least)).cast("bigint")})
    known = rows.filter(F.col("v").isNotNull()).withColumn("d", (F.col("day") - F.col("day0")).cast("bigint"))
    known = known.withColumns({"d1": F.lead("d").over(w), "v1": F.lead("v").over(w),
                               "first": F.lag("d").over(w).isNull(), "last": F.lead("d", 2).over(w).isNull(),
                               "only": F.lag("d").over(w).isNull() & F.lead("d").over(w).isNull()})
    pairs = known.filter(F.col("d1").isNotNull() | F.col("only"))
    # ceil(d * (n-1) / span) in whole numbers
    lo = F.when(F.col("first"), F.lit(0)).otherwise(F.expr("(d * (n - 1) + span - 1) div span"))
    hi = F.when(F.col("last"), F.col("n") - 1).otherwise(F.expr("(d1 * (n - 1) + span - 1) div span - 1"))
    points = (pairs.withColumn("lo", lo.cast("bigint")).withColumn("hi", hi.cast("bigint"))
                   .filter(F.col("lo") <= F.col("hi")).withColumn("k", F.explode(F.sequence("lo", "hi"))))
    at = F.col("k") * F.col("span") / (F.col("n") - 1)
    slope = F.try_divide(F.col("v1") - F.col("v"), (F.col("d1") - F.col("d")).cast("double"))
    return points.select(
        *keys, "k", (F.col("day0") + at).alias("at_day"), F.floor(F.col("day0") + at).cast("int").alias("day"),
        F.when(F.col("d1").isNull(), F.col("v")).otherwise(F.col("v") + slope * (at - F.col("d"))).alias(value))
