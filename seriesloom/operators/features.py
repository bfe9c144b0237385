"""The 39-column feature panel: one row per (entity, day), nothing from later days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import codes
from seriesloom.functions import scalars as S
from seriesloom.operators import moves as M
from seriesloom.operators.asof import latest_until
from seriesloom.operators.calendar import fill_days
from seriesloom.operators.joins import calendar_rows, left_join_bounded
from seriesloom.operators.keyed import (ENTITY, dedupe_days, first_of_day, keep_canonical, last_known,
                                        series_window, spread)

PRICE_COLUMNS = ["slug", "floor_native", "floor_usd", "sale_count_24h", "sale_volume_native_24h",
                 "highest_sale_native_24h", "lowest_sale_native_24h", "listed_count", "unique_owners",
                 "total_supply", "ranking"]
SENTIMENT_COLUMNS = {"sentiment_score": "xsent_score", "community_engagement": "xsent_engagement",
                     "volume_activity": "xsent_volume"}
XSENT = list(SENTIMENT_COLUMNS.values())
SIGNAL_REACH = 7
SENTIMENT_REACH = 45
SYMBOL_REACH = 3
#: Columns carried over so many rows.
CARRIED = {"listed_count": 7, "total_supply": 30, "unique_owners": 30, "ranking": 7, **{c: SENTIMENT_REACH for c in XSENT}}


# --- market-wide series ---------------------------------------------------------------------

def fill_signal(daily: DataFrame, keys: list[str], columns: list[str], reach: int) -> DataFrame:
    """Carry the columns of a daily series over at most ``reach`` days without an entry."""
    dense = fill_days(daily.withColumn("day", S.day_number("date")), keys, reach)
    # The days behind the last entry are carried as well.
    w = series_window(keys)
    last = daily.groupBy(*keys).agg(F.max("date").alias("_end"))
    tail = last.select(*keys, F.explode(F.sequence(F.date_add("_end", 1), F.date_add("_end", reach))).alias("date"))
    tail = tail.withColumn("day", S.day_number("date")).withColumn("observed", F.lit(False))
    rows = dense.select(*keys, "date", "day", "observed", *columns).unionByName(tail, allowMissingColumns=True)
    return rows.select(*keys, "date", *[M.filled_days(c, w, reach).alias(c) for c in columns])


def market_mood(hype: DataFrame) -> DataFrame:
    """Daily mood with coded sentiment and trend, carried over 7 days."""
    # one row a day: of several the one of greatest score
    hype = hype.filter(F.col("date").isNotNull()).groupBy("date").agg(F.max(F.struct("hype_score", "sentiment", "trend")).alias("h")).select("date", "h.*")
    coded = hype.select(F.lit("mood").alias("series"), "date", F.col("hype_score").cast("double").alias("hype_score"),
                        S.mood_code("sentiment").alias("hype_sentiment"), S.trend_code("trend").alias("hype_trend"))
    return fill_signal(coded, ["series"], ["hype_score", "hype_sentiment", "hype_trend"], SIGNAL_REACH).drop("series")


def fear_index(snapshots: DataFrame, tie: list[str] = ()) -> DataFrame:
    """Daily index (first snapshot of the day) with its change over 7 entries, carried over 7 days."""
    first = first_of_day(snapshots.withColumn("series", F.lit("index")).withColumnRenamed("date", "ts"),
                         ["series"], "ts", list(tie))
    w = series_window(["series"], "date")
    daily = first.select("series", "date", S.to_number("value").alias("fear_greed_value"))
    daily = daily.withColumn("fear_greed_change_7d", M.difference("fear_greed_value", w, 7))
    return fill_signal(daily, ["series"], ["fear_greed_value", "fear_greed_change_7d"], SIGNAL_REACH).drop("series")


SYMBOL_FEATURES = ["ret_1d", "ret_7d", "ret_30d", "vol_7d", "ath_pct", "volume_rel"]


def symbol_features(daily: DataFrame) -> DataFrame:
    """Features per (currency symbol, day) on the full calendar between a symbol's first and last day.

    ``daily`` may hold several snapshots a day (``date`` a timestamp): the first of each day counts.
    """
    keys = ["crypto_symbol"]
    wanted = sorted({*codes.CHAIN_SYMBOLS.values(), codes.MACRO_SYMBOL})
    values = ["current_price", "total_volume", "market_cap", "ath_change_percentage"]
    d = daily.filter(F.col("crypto_symbol").isin(wanted) & F.col("date").isNotNull()).select(*keys, F.col("date").alias("ts"), *values)
    d = first_of_day(d, keys, "ts", values).withColumn("day", S.day_number("date"))
    d = d.select(*keys, "date", "day", S.to_number("current_price").alias("current_price"),
                 S.ratio("total_volume", F.nullif(F.col("market_cap").cast("double"), F.lit(0.0))).alias("volume_rel"),
                 S.to_number("ath_change_percentage").alias("ath_pct"))
    w = series_window(keys)
    dense = fill_days(d, keys)
    p = dense.select(*keys, "date", "day", *[M.filled_days(c, w, SYMBOL_REACH).alias(c)
                                            for c in ("current_price", "ath_pct", "volume_rel")])
    p = p.withColumns({"_log": M.log_change("current_price", w),
                       **{f"ret_{n}d": M.change("current_price", w, n) for n in (1, 7, 30)}})
    return p.select(*keys, "date", *[f"ret_{n}d" for n in (1, 7, 30)],
                    M.rolling_std("_log", w, 7, 3).alias("vol_7d"), "ath_pct", "volume_rel")


def symbols_wide(features: DataFrame, symbols: list[str]) -> DataFrame:
    """One column set per symbol, for display."""
    wide = features.groupBy("date").pivot("crypto_symbol", symbols)
    return wide.agg(*[F.first(c, ignorenulls=True).alias(c) for c in SYMBOL_FEATURES])


# --- entity series --------------------------------------------------------------------------

def _daily_rows(prices: DataFrame, sentiment: DataFrame | None, min_days: int) -> DataFrame:
    """One row per (entity, day) from price rows and, beside them, sentiment rows.

    Sentiment rides in the same aggregation, so that it costs no join on (entity, date): a day
    that only has sentiment is a calendar day without a price. Entities with fewer than
    ``min_days`` price rows are dropped.
    """
    rows = prices.select(*ENTITY, "date", *PRICE_COLUMNS, F.lit(1).alias("_price_row"))
    if sentiment is not None:
        x = sentiment.select(*ENTITY, "date", *[F.col(a).cast("double").alias(b) for a, b in SENTIMENT_COLUMNS.items()])
        rows = rows.unionByName(x, allowMissingColumns=True)
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in XSENT})
    rows = rows.dropna(subset=[*ENTITY, "date"])
    picks = [last_known(c, "floor_native").alias(c) for c in PRICE_COLUMNS]
    picks += [F.max(c).alias(c) for c in XSENT]
    daily = rows.groupBy(*ENTITY, "date").agg(*picks, F.count("_price_row").alias("_n"))
    daily = spread(daily, ENTITY).withColumn("day", S.day_number("date"))
    w = series_window(ENTITY)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    priced = F.col("_n") > 0
    daily = daily.withColumns({"_rows": F.sum("_n").over(whole),
                               "_lo": F.min(F.when(priced, F.col("day"))).over(whole),
                               "_hi": F.max(F.when(priced, F.col("day"))).over(whole)})
    return daily.filter((F.col("_rows") >= min_days) & F.col("day").between(F.col("_lo"), F.col("_hi")))


def entity_features(prices: DataFrame, sentiment: DataFrame | None = None, min_days: int = 60,
                    max_fill_gap: int = 7, last_only: bool = False) -> DataFrame:
    """Price, sales, listing and sentiment features of every entity.

    All windows share one specification on the entity, so the panel is exchanged once. A hot
    entity is reduced to one row per day before that exchange.
    """
    w = series_window(ENTITY)
    daily = _daily_rows(prices, sentiment, min_days)
    # What is carried forward, and the place of a row among the priced days, is found on the observed rows; the days between them
    # take it from the row before. Days further behind a price than max_fill_gap get none and are dropped; do not create them.
    grown = w.rowsBetween(Window.unboundedPreceding, 0)
    prices = {f"_{c}": M.last_seen(c, w, "day") for c in ("floor_native", "floor_usd")}
    daily = daily.drop("_n", "_rows", "_lo", "_hi").withColumns({
        "slug": M.filled("slug", w, None), **prices, "_next": F.coalesce(F.lead("day").over(w), F.col("day") + 1)})
    until = F.least(F.col("_next") - 1, F.col("_floor_native.at") + max_fill_gap)
    daily = daily.withColumn("_days", F.when(F.col("_floor_native").isNotNull(), F.greatest(until - F.col("day") + 1, F.lit(0))).otherwise(0))
    priced_here = F.col("_days") > 0
    daily = daily.withColumns({
        "_place": F.sum("_days").over(grown) - F.col("_days") + 1 - F.col("day"),  # of a day: this and the day's number
        "_sold": F.sum(F.when(priced_here, F.coalesce("sale_count_24h", F.lit(0))).otherwise(0)).over(grown)})
    daily = daily.withColumns({"_pos": F.col("_place") + F.col("day"), **{c: F.when(priced_here, F.col(c)) for c in CARRIED}})
    daily = daily.withColumns({f"_{c}": M.last_seen(c, w, "_pos") for c in CARRIED}).drop("_next", "_days", "_pos", *CARRIED)
    carried = [*prices, *[f"_{c}" for c in CARRIED]]
    dense = fill_days(daily, ENTITY, max_fill_gap, ["slug", "_place", "_sold", *carried])
    pos = F.col("_place") + F.col("day")
    priced = dense.withColumns({**{c[1:]: M.within(F.col(c), max_fill_gap) for c in prices}, "pos": pos,
                                **{c: M.within(F.col(f"_{c}"), n, pos) for c, n in CARRIED.items()}}) \
                  .drop(*carried, "_place").filter(F.col("floor_native").isNotNull())
    # What a row says by itself goes through the windows as the few columns that are shown.
    supply = F.nullif(F.col("total_supply"), F.lit(0))
    high = F.when(F.col("highest_sale_native_24h") > 0, F.col("highest_sale_native_24h"))
    low = F.when(F.col("lowest_sale_native_24h") > 0, F.col("lowest_sale_native_24h"))
    priced = priced.withColumns({
        "listing_ratio": S.ratio("listed_count", supply), "owner_ratio": S.ratio("unique_owners", supply),
        "intraday_range": S.ratio(high - low, F.col("floor_native")), "ranking": F.col("ranking").cast("double")}) \
        .drop("total_supply", "unique_owners", "listed_count", "highest_sale_native_24h", "lowest_sale_native_24h")

    # Sums over rows from single rows of before: a sliding frame would read all its rows again for each row.
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("sale_count_24h", "sale_volume_native_24h")}
    seen = {n: F.least("pos", F.lit(n)) for n in (7, 20, 30, 50, 200)}

    def sold(n):  # whole numbers, so the difference of running totals is exact
        return (F.col("_sold") - F.coalesce(F.lag("_sold", n).over(w), F.lit(0))) / seen[n]

    first = priced.withColumns(zero).withColumns({
        **{f"ret_{n}d": M.change("floor_native", w, n) for n in (3, 7, 14, 30)},
        "_log": M.log_change("floor_native", w),
        "_s10": M.blocks("floor_native", w, 1, 10),
        "sale_count_ma7": sold(7),
        "_count30": F.when(F.col("pos") >= 3, sold(30)),
        "sale_vol_ma7": M.blocks("sale_volume_native_24h", w, 1, 7) / seen[7],
        "_newest": F.lead("day").over(w).isNull(),
    })
    # Count, sum and squares of 7 log changes; 14 and 30 are put together from them below.
    logs = [F.col("_log"), *[F.lag("_log", i).over(w) for i in range(1, 7)]]
    parts = {"_n": lambda x: F.when(x.isNull(), 0.0).otherwise(1.0), "_x": lambda x: F.coalesce(x, F.lit(0.0)),
             "_q": lambda x: F.coalesce(x * x, F.lit(0.0))}
    second = first.withColumns({
        "_s50": M.blocks("_s10", w, 10, 5),
        "ma20": F.when(F.col("pos") >= 10, M.blocks("_s10", w, 10, 2) / seen[20]),
        **{f"{k}7": sum(map(part, logs[1:]), part(logs[0])) for k, part in parts.items()},
    }).withColumn("ma50", F.when(F.col("pos") >= 25, F.col("_s50") / seen[50]))
    outer = [F.lag("_log", i).over(w) for i in (28, 29)]
    third = second.withColumns({
        **{f"{k}14": M.blocks(f"{k}7", w, 7, 2) for k in parts},
        **{f"{k}30": M.blocks(f"{k}7", w, 7, 4) + sum(map(part, outer[1:]), part(outer[0])) for k, part in parts.items()},
        "ma200": F.when(F.col("pos") >= 100, M.blocks("_s50", w, 50, 4) / seen[200]),
        **{f"ma{n}_slope": M.change(f"ma{n}", w, 5) for n in (20, 50)},
        **{f"floor_vs_ma{n}": S.ratio("floor_native", f"ma{n}") for n in (20, 50)},
        "spread_20_50": S.ratio(F.col("ma20") - F.col("ma50"), "ma50"),
        "sale_count_momentum": S.ratio("sale_count_ma7", "_count30"),
    })
    step2 = third.withColumns({
        f"vol_{n}d": M.std_of_sums(F.col(f"_n{n}"), F.col(f"_x{n}"), F.col(f"_q{n}"), max(3, n // 3)) for n in (7, 14, 30)})
    if last_only:
        step2 = step2.filter("_newest")
    return step2.select(
        *ENTITY, "slug", "date", "day", "floor_native", "floor_usd",
        *[f"ret_{n}d" for n in (3, 7, 14, 30)], *[f"vol_{n}d" for n in (7, 14, 30)],
        "floor_vs_ma20", "floor_vs_ma50", S.ratio("floor_native", "ma200").alias("floor_vs_ma200"), "spread_20_50",
        S.ratio(F.col("ma50") - F.col("ma200"), "ma200").alias("spread_50_200"),
        "ma20_slope", "ma50_slope",
        "listing_ratio", "owner_ratio",
        "sale_count_ma7", "sale_vol_ma7", "sale_count_momentum",
        "intraday_range", "ranking", *XSENT,
        S.chain_code("chain").cast("double").alias("chain_enc"))


def newest_panel_day(prices: DataFrame, min_days: int, max_fill_gap: int) -> DataFrame:
    """One row: the last day any entity has in the panel, from an aggregate alone.

    An entity's last panel day is its last row, or the last day its last price is carried to.
    """
    ends = prices.dropna(subset=[*ENTITY, "date"]).groupBy(*ENTITY).agg(
        F.count("*").alias("n"), F.max("date").alias("row_end"),
        F.max(F.when(F.col("floor_native").isNotNull(), F.col("date"))).alias("price_end"))
    carried = F.date_add("price_end", max_fill_gap)
    return ends.filter((F.col("n") >= min_days) & F.col("price_end").isNotNull()) \
               .agg(F.max(F.least("row_end", carried)).alias("day"))


# --- the panel ------------------------------------------------------------------------------

def with_symbols(df: DataFrame, features: DataFrame, rows: int) -> DataFrame:
    """Features of the entity's own currency as ``native_*`` and of the macro symbol as ``btc_*``."""
    native = features.select(F.col("crypto_symbol").alias("_symbol"), "date",
                             *[F.col(c).alias(f"native_{c}") for c in SYMBOL_FEATURES])
    macro = features.filter(F.col("crypto_symbol") == codes.MACRO_SYMBOL).select(
        "date", *[F.col(c).alias(f"btc_{c}") for c in ("ret_7d", "vol_7d", "ath_pct")])
    out = df.withColumn("_symbol", S.chain_symbol("chain"))
    out = left_join_bounded(out, native, ["_symbol", "date"], rows)
    return left_join_bounded(out, macro, ["date"], rows).drop("_symbol")


def feature_panel(prices: DataFrame, hype: DataFrame, sentiment: DataFrame, index: DataFrame, symbols: DataFrame,
                  min_days: int = 60, max_fill_gap: int = 7, lookback_days: int | None = None,
                  index_tie: list[str] = (), newest: dt.date | None = None,
                  signal_days: int | None = None) -> DataFrame:
    """All features of every (entity, day), or of each entity's last day with ``lookback_days``.

    The look-back bound is computed first and reaches the scan as a literal. Market series hold
    one row per day and are broadcast when the span of their dates proves them small. A caller
    that knows the newest price date, or the number of days the market series span, passes them
    and saves the jobs that ask for them.
    """
    canonical = keep_canonical(prices)
    if lookback_days is not None:
        newest = newest or prices.agg(F.max("date")).first()[0]
        if newest is not None:
            canonical = canonical.filter(F.col("date") >= F.lit(newest - dt.timedelta(days=lookback_days)))
        out = entity_features(canonical, None, min_days, max_fill_gap, last_only=True).drop(*XSENT)
        latest = newest_panel_day(canonical, min_days, max_fill_gap).scalar()
        x = sentiment.select(*ENTITY, "date", *[F.col(a).cast("double").alias(b) for a, b in SENTIMENT_COLUMNS.items()])
        out = latest_until(out, x, ENTITY, XSENT, latest)
    else:
        out = entity_features(canonical, sentiment, min_days, max_fill_gap)
    n_symbols = len({*codes.CHAIN_SYMBOLS.values(), codes.MACRO_SYMBOL})

    def days(df):
        return signal_days if signal_days is not None else calendar_rows(df, "date")

    number = {c: F.col(c).cast("double") for c in ("hype_sentiment", "hype_trend")}
    out = left_join_bounded(out, market_mood(hype).withColumns(number), ["date"], days(hype) + SIGNAL_REACH)
    out = left_join_bounded(out, fear_index(index, index_tie), ["date"], days(index) + SIGNAL_REACH)
    out = with_symbols(out, symbol_features(symbols), days(symbols) * n_symbols)
    return out.select(*ENTITY, "slug", "date", "day", "floor_native", "floor_usd", *codes.FEATURES)


def model_matrix(df: DataFrame, label: str, drop_missing_label: bool = True) -> DataFrame:
    """Features with infinities as missing, and the label."""
    have = [c for c in codes.FEATURES if c in df.columns]
    out = df.withColumns({c: S.finite(c) for c in have})
    return out.dropna(subset=[label]) if drop_missing_label else out
