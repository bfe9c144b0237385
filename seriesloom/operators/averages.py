"""Calendar moving averages that tolerate gaps.

An average over P calendar days is valid while at most ``allowed`` of them lack a value. Missing
days are filled from left to right with the midpoint of the (possibly filled) day before and the
next observed value; the ends copy their neighbour. In a gap of m days between a and b the fills
sum to ``m*b - (b-a)*(1 - 2**-m)``, which turns the running fill into one sum over a RANGE frame.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.keyed import series_window


def _with_gap_sum(df: DataFrame, keys: list[str], value: str, sparse: bool) -> DataFrame:
    """Add ``_gap``, the sum of the fills between a row's value and the observed one before it."""
    w = series_window(keys)
    v = F.col(value)
    if sparse:
        seen = F.last(F.when(v.isNotNull(), F.struct("day", v.alias("v"))), ignorenulls=True) \
                .over(w.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("_seen", seen)
        day0, v0 = F.col("_seen.day"), F.col("_seen.v")
    else:
        df = df.withColumn("_day0", F.lag("day").over(w)).withColumn("_v0", F.lag(value).over(w))
        day0, v0 = F.col("_day0"), F.col("_v0")
    m = F.col("day") - day0 - 1
    gap = F.when(m > 0, m * v - (v - v0) * (1 - F.pow(F.lit(2.0), -m))).otherwise(F.lit(0.0))
    return df.withColumn("_gap", F.when(v.isNotNull(), gap)).drop("_seen", "_day0", "_v0")


def gap_filled_sma(df: DataFrame, keys: list[str], value: str, spans: dict[int, int],
                   prefix: str = "sma", sparse: bool = False) -> DataFrame:
    """Add ``{prefix}{P}`` for each ``P: allowed`` of ``spans``.

    ``df`` holds one row per (keys, day). ``sparse`` allows rows without a value, whose average
    ends on a missing day.
    """
    out = _with_gap_sum(df, keys, value, sparse)
    w = series_window(keys)
    v = F.col(value)
    exprs = {}
    for span, allowed in spans.items():
        f = w.rangeBetween(-(span - 1), 0)
        start = F.col("day") - (span - 1)
        n = F.count(v).over(f)
        total = F.sum(v + F.col("_gap")).over(f)
        if sparse:
            head = F.first(F.when(v.isNotNull(), F.struct("day", v.alias("v"), "_gap")), ignorenulls=True).over(f)
            tail = F.last(F.when(v.isNotNull(), F.struct("day", v.alias("v"))), ignorenulls=True).over(f)
            total = total - head["_gap"] + (head["day"] - start) * head["v"] \
                + (F.col("day") - tail["day"]) * tail["v"]
        else:
            total = total - F.first("_gap").over(f) + (F.first("day").over(f) - start) * F.first(v).over(f)
        exprs[f"{prefix}{span}"] = F.when((n > 0) & (span - n <= allowed), total / span)
    return out.withColumns(exprs).drop("_gap")


def days_present(df: DataFrame, keys: list[str], spans: list[int]) -> DataFrame:
    """Add ``present_{P}`` and ``missing_{P}``; a row without a value still counts as present."""
    w = series_window(keys)
    out = df
    for span in spans:
        n = F.count("*").over(w.rangeBetween(-(span - 1), 0))
        out = out.withColumn(f"present_{span}", n).withColumn(f"missing_{span}", F.lit(span) - F.col(f"present_{span}"))
    return out


def sma_as_of(df: DataFrame, keys: list[str], value: str, as_of: dt.date, spans: dict[int, int],
              present_span: int) -> DataFrame:
    """One row per entity: averages ending on ``as_of``, days present and missing, size of the history up to then.

    Only the longest span is windowed (the gap that opens before a frame never counts), so the
    date bound reaches the scan; row count and first date are a plain aggregate beside it.
    """
    end = (as_of - dt.date(1970, 1, 1)).days
    longest = max(*spans, present_span)
    recent = df.filter(F.col("date").between(F.lit(as_of - dt.timedelta(days=longest - 1)), F.lit(as_of)))
    recent = _with_gap_sum(recent, keys, value, sparse=True)
    v = F.col(value)
    known = v.isNotNull()
    parts = [F.sum(F.when(F.col("day") > end - present_span, 1).otherwise(0)).alias("days_present")]
    for span in spans:
        inside = known & (F.col("day") > end - span)
        parts += [
            F.sum(F.when(inside, v + F.col("_gap"))).alias(f"s{span}"),
            F.count(F.when(inside, v)).alias(f"n{span}"),
            F.min(F.when(inside, F.struct("day", v.alias("v"), "_gap"))).alias(f"a{span}"),
            F.max(F.when(inside, F.struct("day", v.alias("v")))).alias(f"z{span}"),
        ]
    agg = recent.groupBy(*keys).agg(*parts)
    smas = []
    for span, allowed in spans.items():
        a, z, n = F.col(f"a{span}"), F.col(f"z{span}"), F.col(f"n{span}")
        total = F.col(f"s{span}") - a["_gap"] + (a["day"] - (end - span + 1)) * a["v"] + (end - z["day"]) * z["v"]
        smas.append(F.when((n > 0) & (span - n <= allowed), total / span).alias(f"sma{span}"))
    recent_part = agg.select(*keys, *smas, "days_present")
    whole = df.filter(F.col("date") <= F.lit(as_of)).groupBy(*keys).agg(F.count("*").alias("records"), F.min("date").alias("first_date"))
    present = F.coalesce("days_present", F.lit(0))
    return (whole.join(recent_part, keys, "left")
                 .select(*keys, "records", "first_date", *[f"sma{p}" for p in spans],
                         present.alias("days_present"), (F.lit(present_span) - present).alias("days_missing")))


def last_value_means(df: DataFrame, keys: list[str], value: str, spans: tuple[int, int] = (7, 30),
                     rows: int = 60) -> DataFrame:
    """Plain means of the newest 7 and 30 known values among the newest ``rows`` rows."""
    w = series_window(keys).orderBy(F.desc("day"))
    newest = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rows)
    known = newest.withColumn("_k", F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    means = [F.avg(F.when(F.col("_k") <= k, F.col(value))).alias(f"ma{k}") for k in spans]
    return known.groupBy(*keys).agg(*means)
