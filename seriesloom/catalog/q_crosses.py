"""Moving averages and crossovers."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom import fixtures as fx
from seriesloom.catalog import query
from seriesloom.catalog.base import panel_sql, r, rs, sma_sql
from seriesloom.operators import averages as A
from seriesloom.operators import crosses as X

SLUG = ["slug", "chain"]

CROSS_COLUMNS = ["slug", "chain", "date", "is_native", "floor_native", "floor_usd", "ma_short", "ma_long",
                 "ma_short_previous_day", "ma_long_previous_day", "ma_short_period", "ma_long_period"]
# Prices come from one division and are equal to the last bit; only sums are rounded.
_ROUNDED = {"ma_short", "ma_long", "ma_short_previous_day", "ma_long_previous_day"}


def cross_rows(df):
    return df.select(*[r(c).alias(c) if c in _ROUNDED else F.col(c) for c in CROSS_COLUMNS])


def series_sql(key: str) -> str:
    return f"""{panel_sql(key)}, series AS (
 SELECT slug, chain, TRUE AS is_native, date, day, floor_native AS price, floor_native, floor_usd, ranking FROM panel
 UNION ALL
 SELECT slug, chain, FALSE, date, day, floor_usd, floor_native, floor_usd, ranking FROM panel)"""


def crosses_sql(key: str, short: int, long: int, sg: int, lg: int) -> str:
    """CTE ``crossed``: every row of every series with its averages, the ones before and flags."""
    sma = sma_sql("series", "slug, chain, is_native", "price", {short: sg, long: lg}, "ma_")
    return f"""{series_sql(key)}, {sma}, lagged AS (
 SELECT *, lag(ma_{short}) OVER w AS s0, lag(ma_{long}) OVER w AS l0, row_number() OVER w AS obs,
   lead(day) OVER w IS NULL AS is_last
 FROM series_sma WINDOW w AS (PARTITION BY slug, chain, is_native ORDER BY day)), crossed AS (
 SELECT slug, chain, date, is_native, floor_native, floor_usd, ranking, ma_{short} AS ma_short, ma_{long} AS ma_long,
   s0 AS ma_short_previous_day, l0 AS ma_long_previous_day, {short} AS ma_short_period, {long} AS ma_long_period,
   is_last
 FROM lagged WHERE obs > {long} AND ma_{short} - ma_{long} > abs(ma_{long}) * 1e-12
   AND NOT (s0 - l0 > abs(l0) * 1e-12))"""


def cross_select(where: str = "TRUE", src: str = "crossed") -> str:
    cols = ", ".join(f"{rs(c)} AS {c}" if c in _ROUNDED else c for c in CROSS_COLUMNS)
    return f"SELECT {cols} FROM {src} WHERE {where}"


@query("cross_history_20_50", f"WITH {crosses_sql('p_type', 20, 50, 1, 3)} {cross_select()}")
def cross_history_20_50(spark, sf):
    return cross_rows(X.detect_crosses(fx.panel(spark, sf, "p_type"), 20, 50, 1, 3))


@query("cross_history_50_200", f"WITH {crosses_sql('p_brand', 50, 200, 50, 200)} {cross_select()}")
def cross_history_50_200(spark, sf):
    return cross_rows(X.detect_crosses(fx.panel(spark, sf, "p_brand"), 50, 200, 50, 200))
