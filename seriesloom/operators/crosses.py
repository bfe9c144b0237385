"""Short-over-long average crossovers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import scalars as S
from seriesloom.operators.averages import gap_filled_sma
from seriesloom.operators.keyed import latest_row, series_window, spread
from seriesloom.session import stored

SERIES = ["slug", "chain", "is_native"]
CROSS_KEY = ["date", "slug", "chain", "is_native", "ma_short_period", "ma_long_period"]

# Two averages closer than this share of the long one are equal: sums of the same prices in
# another order must not decide a crossing.
SAME = 1e-12


def above(short: Column, long: Column) -> Column:
    return short - long > F.abs(long) * SAME


def price_series(panel: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Native and USD prices as separate series per (slug, chain), known prices only.

    ``pairs`` restricts to the (slug, chain) pairs of the metadata. Several identifiers may share a
    slug: its price of a day is the lowest of theirs, and so is its rank.
    """
    if pairs is not None:
        panel = panel.join(pairs.select("slug", "chain").distinct(), ["slug", "chain"], "left_semi")
    panel = panel.groupBy("slug", "chain", "date").agg(*[F.min(c).alias(c) for c in ("floor_native", "floor_usd", "ranking")])
    both = panel.select(
        "slug", "chain", "date", S.day_number("date").alias("day"), "floor_native", "floor_usd", "ranking",
        F.explode(F.array(
            F.struct(F.lit(True).alias("is_native"), F.col("floor_native").alias("price")),
            F.struct(F.lit(False).alias("is_native"), F.col("floor_usd").alias("price")))).alias("s"))
    both = both.select("*", "s.is_native", "s.price").drop("s").filter(F.col("price").isNotNull())
    return spread(both, SERIES)


def _crossings(series: DataFrame, short: int, long: int, short_gap: int, long_gap: int) -> DataFrame:
    """Rows whose short average is above the long one while it was not on the row before."""
    spans = {short: short_gap, long: long_gap}
    w = series_window(SERIES)
    ma = gap_filled_sma(series, SERIES, "price", spans, prefix="ma_")
    ma = (ma.withColumn("_s0", F.lag(f"ma_{short}").over(w)).withColumn("_l0", F.lag(f"ma_{long}").over(w)))
    hit = above(F.col(f"ma_{short}"), F.col(f"ma_{long}")) & ~above(F.col("_s0"), F.col("_l0"))
    return ma.withColumn("_cross", F.coalesce(hit, F.lit(False)))


def _as_crosses(rows: DataFrame, short: int, long: int) -> DataFrame:
    return rows.select(
        "slug", "chain", "date", "is_native", "floor_native", "floor_usd", "ranking",
        F.col(f"ma_{short}").alias("ma_short"), F.col(f"ma_{long}").alias("ma_long"),
        F.col("_s0").alias("ma_short_previous_day"), F.col("_l0").alias("ma_long_previous_day"),
        F.lit(short).alias("ma_short_period"), F.lit(long).alias("ma_long_period"))


def detect_crosses(panel: DataFrame, short: int, long: int, short_gap: int, long_gap: int,
                   start_date: dt.date | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """All crossovers of the history, from ``start_date`` on.

    A crossing needs ``long`` earlier observations. The start date is applied behind the
    averages because they and the observation count look further back.
    """
    series = price_series(panel, pairs)
    series = series.withColumn("_obs", F.row_number().over(series_window(SERIES)))
    rows = _crossings(series, short, long, short_gap, long_gap)
    rows = rows.filter(F.col("_cross") & (F.col("_obs") > long))
    if start_date is not None:
        rows = rows.filter(F.col("date") >= F.lit(start_date))
    return _as_crosses(rows, short, long)


def last_days(panel: DataFrame) -> DataFrame:
    """Days with a price of each series: how many (``n``), the last one and the one before it (``prev``), as day numbers.

    Days are bits of one number for 64 days, so that a hash aggregate unites them ahead of the exchange and several
    identifiers or rows of a day count once.
    """
    day = S.day_number("date")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(day, F.lit(64)))
    masks = {True: "floor_native", False: "floor_usd"}
    blocks = panel.groupBy("slug", "chain", F.floor(day / 64).cast("int").alias("block")).agg(
        *[F.bit_or(F.when(F.col(c).isNotNull(), bit)).alias(c) for c in masks.values()])
    blocks = blocks.select("slug", "chain", "block", F.inline(F.array(*[
        F.struct(F.lit(k).alias("is_native"), F.coalesce(c, F.lit(0).cast("bigint")).alias("mask")) for k, c in masks.items()]))).filter("mask <> 0")

    def highest(mask: str) -> Column:
        return F.length(F.bin(mask)) - 1

    blocks = blocks.withColumn("_top", highest("mask"))
    blocks = blocks.withColumn("_rest", F.col("mask").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_top"))))
    blocks = blocks.withColumn("top", F.col("block") * 64 + F.col("_top")) \
                   .withColumn("second", F.when(F.col("_rest") != 0, F.col("block") * 64 + highest("_rest")))
    return blocks.groupBy(*SERIES).agg(
        F.sum(F.bit_count("mask")).alias("n"), F.max("top").alias("last"),
        F.max(F.struct("block", "top", "second")).alias("_end"),
        F.sort_array(F.collect_set("top"), asc=False).alias("_tops")) \
        .select(*SERIES, "n", "last", F.coalesce("_end.second", F.get("_tops", F.lit(1))).alias("prev"))


def detect_current_crosses(panel: DataFrame, short: int, long: int, short_gap: int, long_gap: int,
                           pairs: DataFrame | None = None) -> DataFrame:
    """Crossovers on the last row of each series.

    The last two rows need no more than ``long`` days before the row before last. The days that each series still needs come from
    ``last_days`` and meet the rows ahead of the first exchange; the earliest of them reaches the scan as a literal.
    """
    ends = stored(last_days(panel).filter(F.col("n") > long), "series-ends")  # one row a series, asked three times
    needed = ends.groupBy("slug", "chain").agg((F.min("prev") - long).alias("_after"))
    first = needed.agg(F.min("_after")).first()[0]
    if first is not None:
        panel = panel.filter(F.col("date") > F.date_from_unix_date(F.lit(int(first))))
    recent = panel.join(needed, ["slug", "chain"]).filter(S.day_number("date") > F.col("_after")).drop("_after")
    series = price_series(recent, pairs).join(ends.select(*SERIES, "last", "prev"), SERIES)
    rows = _crossings(series.filter(F.col("day") > F.col("prev") - long).drop("prev"), short, long, short_gap, long_gap)
    return _as_crosses(rows.filter(F.col("_cross") & (F.col("day") == F.col("last"))), short, long)


def price_lookup(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """Add native price, USD price and rank at (slug, date, chain); NULLs where there is no row."""
    keys = ["slug", "date", "chain"]
    prices = panel.select(*keys, "floor_native", "floor_usd", "ranking")
    prices = prices.groupBy(*keys).agg(F.max(F.struct("floor_native", "floor_usd", "ranking")).alias("p"))
    return rows.join(prices.select(*keys, "p.*"), keys, "left")


def between_dates(crosses: DataFrame, start: dt.date, end: dt.date, short: int | None = None,
                  long: int | None = None) -> DataFrame:
    """Native crossovers of an inclusive date range, optionally of one period pair."""
    rows = crosses.filter(F.col("is_native") & F.col("date").between(F.lit(start), F.lit(end)))
    if short is not None and long is not None:
        rows = rows.filter((F.col("ma_short_period") == short) & (F.col("ma_long_period") == long))
    return rows


def pending(crosses: DataFrame, on: dt.date) -> DataFrame:
    """Native crossovers of a date that still miss a delivery."""
    return crosses.filter(F.col("is_native") & (F.col("date") == F.lit(on))
                          & (~F.col("telegram_sent") | ~F.col("x_sent")))


def enrich_alerts(crosses: DataFrame, panel: DataFrame, metadata: DataFrame) -> DataFrame:
    """Crossovers with their price row (required) and their metadata row (optional)."""
    info = ["contract_address", "chain_currency_symbol", "unique_owners", "total_supply", "listed_count",
            "best_price_url"]
    panel = panel.withColumns({c: F.lit(None).cast("string") for c in info if c not in panel.columns})
    prices = panel.groupBy("slug", "chain", "date").agg(F.max(F.struct(*info)).alias("p")) \
                  .select("slug", "chain", "date", "p.*")
    meta = metadata.groupBy("slug").agg(
        F.max(F.struct(S.blank_to_null("x_page").alias("x_page"),
                       S.blank_to_null("marketplace_url").alias("marketplace_url"), "name")).alias("m")) \
        .select("slug", "m.*")
    return crosses.join(prices, ["slug", "chain", "date"]).join(meta, "slug", "left")


def with_post_quota(alerts: DataFrame, quota: int = 5) -> DataFrame:
    """Mark which rows are posted in this run: the first ``quota`` unposted ones by date and slug.

    A top-k of the key columns decides (no global window); the rest is carried to the next run.
    """
    keys = CROSS_KEY
    now = (alerts.filter(~F.col("x_sent")).select(*keys).distinct()
           .orderBy(*keys).limit(quota).withColumn("post_now", F.lit(True)))
    return (alerts.join(F.broadcast(now), keys, "left")
                  .withColumn("post_now", F.coalesce("post_now", F.lit(False)))
                  .withColumn("send_now", ~F.col("telegram_sent"))
                  .withColumn("carried_over", ~F.col("x_sent") & ~F.col("post_now")))


def recap(crosses: DataFrame, panel: DataFrame) -> DataFrame:
    """Crossovers with the price of their day, the entity's latest price and the gain in percent."""
    day_rows = panel.groupBy("slug", "chain", "date").agg(
        F.max("chain_currency_symbol").alias("chain_currency_symbol"))
    now = latest_row(panel.select("slug", "chain", "date", F.col("floor_native").alias("current_floor_native"),
                                  F.col("floor_usd").alias("current_floor_usd")),
                     ["slug", "chain"], "date", ["current_floor_native"]).drop("date")
    rows = crosses.join(day_rows, ["slug", "chain", "date"]).join(now, ["slug", "chain"])
    then = F.when(F.col("is_native"), F.col("floor_native")).otherwise(F.col("floor_usd"))
    today = F.when(F.col("is_native"), F.col("current_floor_native")).otherwise(F.col("current_floor_usd"))
    return (rows.withColumn("profit_pct", S.profit_pct(today, then))
                .withColumn("currency", S.currency_suffix("is_native", "chain_currency_symbol"))
                .withColumn("cross_day", S.day_text("date")))


def mark_delivered(crosses: DataFrame, delivered: DataFrame, flag: str) -> DataFrame:
    """Set a delivery flag on the crossovers whose whole key is in ``delivered``."""
    keys = CROSS_KEY
    done = delivered.select(*keys).distinct().withColumn("_done", F.lit(True))
    return (crosses.join(done, keys, "left")
                   .withColumn(flag, F.col(flag) | F.coalesce("_done", F.lit(False))).drop("_done")
                   .select(*crosses.columns))
