"""User-level reports. Each returns a frame; nothing is formatted for a console or a chat."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import codes
from seriesloom.functions import scalars as S
from seriesloom.operators import asof, averages, crosses, lookups
from seriesloom.operators.keyed import ENTITY


def freshest_ids(meta: DataFrame, prices: DataFrame) -> DataFrame:
    """Per slug the identifier with the most recent price; identifiers without prices come last."""
    last = prices.groupBy("collection_identifier").agg(F.max("date").alias("last_date"))
    ids = meta.select("slug", "collection_identifier").distinct().join(last, "collection_identifier", "left")
    best = F.max_by(F.struct("collection_identifier", "last_date"), F.struct("last_date", "collection_identifier"))
    return ids.groupBy("slug").agg(best.alias("b")).select("slug", "b.collection_identifier", "b.last_date")


def average_report(meta: DataFrame, prices: DataFrame, as_of: dt.date, value: str = "floor_native",
                   spans: dict[int, int] = codes.SMA_SPANS) -> DataFrame:
    """Averages over 20, 50, 100 and 200 days per slug, with history size and days present.

    ``prices`` holds one row per (entity, day).
    """
    ids = freshest_ids(meta, prices).filter(F.col("last_date").isNotNull()).select("slug", "collection_identifier")
    sma = averages.sma_as_of(prices, ["collection_identifier"], value, as_of, spans, 200)
    return ids.join(sma, "collection_identifier")


def metadata_report(meta: DataFrame, prices: DataFrame) -> DataFrame:
    """Per slug: metadata of the identifier priced last, with its latest price row."""
    latest = prices.groupBy("collection_identifier").agg(
        F.max_by(F.struct("date", "floor_native", "floor_usd"), F.struct("date", "floor_native")).alias("p"))
    rows = meta.join(latest, "collection_identifier")
    best = F.max_by(F.struct("collection_identifier", "name", "chain", "categories", "p"),
                    F.struct("p.date", "collection_identifier"))
    return rows.groupBy("slug").agg(best.alias("b")).select(
        "slug", "b.collection_identifier", "b.name", "b.chain", "b.categories", F.col("b.p.date").alias("last_date"),
        "b.p.floor_native", "b.p.floor_usd")


def table_coverage(main: DataFrame, archive: DataFrame) -> DataFrame:
    return lookups.coverage_shares([lookups.coverage(main, "main"), lookups.coverage(archive, "archive")])


def daily_insert_check(prices: DataFrame, on: dt.date) -> DataFrame:
    return prices.filter(F.col("date") == F.lit(on)).agg(F.count("*").alias("n")).withColumn("date", F.lit(on))


def market_card(hype: DataFrame, n: int = 1) -> DataFrame:
    """Newest market moods with their heat."""
    return lookups.newest(hype, n).select(
        "date", "hype_score", "sentiment", "trend", S.heat("hype_score").alias("heat"))


def sentiment_card(sentiment: DataFrame) -> DataFrame:
    """Latest sentiment of every (slug, chain) with symbol and level flags."""
    from seriesloom.operators.keyed import latest_row
    rows = latest_row(sentiment.select("slug", "chain", "date", "sentiment_score", "sentiment_category",
                                       "community_engagement", "volume_activity"), ["slug", "chain"])
    return rows.withColumns({"symbol": S.category_symbol("sentiment_category"),
                             "engagement_flag": S.level_flag("community_engagement"),
                             "activity_flag": S.level_flag("volume_activity")})


def sentiment_ranking(sentiment: DataFrame, n: int = 5) -> DataFrame:
    """The n highest and the n lowest scores of the latest date."""
    cols = ["slug", "chain", "sentiment_score"]
    top = lookups.top_on_latest(sentiment, n).select(F.lit("highest").alias("side"), *cols)
    return top.unionByName(lookups.top_on_latest(sentiment, n, lowest=True).select(F.lit("lowest").alias("side"), *cols))


def sentiment_snapshot(sentiment: DataFrame, prices: DataFrame) -> DataFrame:
    """Sentiment of the latest date with each entity's latest rank."""
    ranks = lookups.latest_prices(prices).select("slug", "chain", "ranking")
    rows = lookups.on_latest_date(sentiment).join(ranks, ["slug", "chain"], "left")
    return rows.select("slug", "chain", "sentiment_score", "sentiment_category", "community_engagement",
                       "volume_activity", "ranking")


def snapshot_stats(sentiment: DataFrame) -> DataFrame:
    return lookups.on_latest_date(sentiment).agg(
        F.count_distinct("collection_identifier").alias("entities"), F.avg("sentiment_score").alias("avg_score"),
        F.min("sentiment_score").alias("min_score"), F.max("sentiment_score").alias("max_score"),
        F.avg("community_engagement").alias("avg_engagement"), F.avg("volume_activity").alias("avg_activity"))


def category_shares(sentiment: DataFrame) -> DataFrame:
    """Rows per category of the latest date in percent of its entities."""
    latest = lookups.on_latest_date(sentiment)
    total = latest.agg(F.count_distinct("collection_identifier")).scalar()
    return latest.groupBy("sentiment_category").agg(F.count("*").alias("n")) \
                 .withColumn("pct", F.col("n") * 100.0 / total)


def refresh_candidates(prices: DataFrame, meta: DataFrame, sentiment: DataFrame, as_of: dt.date,
                       top_n: int = 100, per_run: int | None = None) -> DataFrame:
    """Top-ranked entities whose sentiment is missing or at least 30 days old."""
    rows = lookups.with_last_analysis(lookups.ranked_with_handle(prices, meta, top_n), sentiment, as_of)
    rows = lookups.display_names(rows.filter("stale"), meta)
    return rows if per_run is None else rows.orderBy("ranking", "slug", "chain").limit(per_run)


def cross_summary(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Crossovers found and, of these, not yet stored."""
    from seriesloom.sinks.keyed_tables import insert_counts
    periods = ["ma_short_period", "ma_long_period"]
    counts = insert_counts(stored, found, crosses.CROSS_KEY, periods)
    return counts.select(*periods, F.col("total").alias("found"), F.col("inserted").alias("saved"))


def pending_alerts(stored: DataFrame, panel: DataFrame, meta: DataFrame, on: dt.date, quota: int = 5) -> DataFrame:
    """Alert feed of a date: enriched crossovers, what to send now and the texts."""
    rows = crosses.with_post_quota(crosses.enrich_alerts(crosses.pending(stored, on), panel, meta), quota)
    return rows.withColumn("alert_text", S.alert_text()).withColumn("post_text", S.post_text())


def cross_recap(stored: DataFrame, panel: DataFrame, as_of: dt.date, days: int = 365,
                short: int | None = None, long: int | None = None) -> DataFrame:
    rows = crosses.between_dates(stored, as_of - dt.timedelta(days=days), as_of, short, long)
    return crosses.recap(rows, panel)


def chart_data(prices: DataFrame, keys: list[str], as_of: dt.date, days: int, value: str = "floor_native",
               allowed: dict[int, int] = codes.SMA_SPANS) -> DataFrame:
    """Interpolated price on an even grid and the averages the period is long enough for, each with the missing days ``allowed``."""
    recent = lookups.since(prices, as_of, days).select(*keys, "day", value)
    grid = asof.even_grid(recent, keys, value)
    spans = {p: allowed[p] for p, least in codes.CHART_SPANS.items() if days >= least}
    if not spans:
        return grid
    days_needed = grid.select(*keys, "day").distinct().withColumn(value, F.lit(None).cast("double"))
    rows = recent.unionByName(days_needed).groupBy(*keys, "day").agg(F.max(value).alias(value))
    sma = averages.gap_filled_sma(rows, keys, value, spans, sparse=True).drop(value)
    return grid.join(sma, [*keys, "day"], "left")


def confident_buys(signals: DataFrame, min_confidence: float) -> DataFrame:
    """BUY signals of at least a confidence."""
    return signals.filter((F.col("signal") == "BUY") & (F.col("confidence") >= min_confidence))


def signal_report(signals: DataFrame, min_confidence: float = 0.6, top_n: int = 15) -> DataFrame:
    """The best BUY signals."""
    return confident_buys(signals, min_confidence).orderBy(F.desc("confidence"), *ENTITY).limit(top_n)


def signal_totals(signals: DataFrame) -> DataFrame:
    return signals.agg(F.count("*").alias("tracked"), *[F.count_if(F.col("signal") == s).alias(s.lower())
                                                        for s in codes.SIGNAL_TEXT.values()])
