"""Filters, counts, rankings and paging behind the user-level reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import scalars as S
from seriesloom.operators.keyed import ENTITY, latest_row

NAME_ORDER = "lower(slug)"


# --- names ----------------------------------------------------------------------------------

def names_by_prefix(meta: DataFrame, prefix: str) -> DataFrame:
    return meta.filter(S.starts_with("slug", prefix)).select("slug")


def names_by_chain(meta: DataFrame, chain: str) -> DataFrame:
    return meta.filter(S.same_text("chain", chain)).select("slug")


def names_by_category(meta: DataFrame, category: str, any_of_list: bool = False) -> DataFrame:
    """Names whose category text equals ``category``, or holds it as one list element."""
    if any_of_list:
        hit = F.array_contains(F.split(F.lower("categories"), ", *"), category.lower())
        return meta.filter(hit).select("slug")
    return meta.filter(S.same_text("categories", category)).select("slug")


def sorted_names(names: DataFrame) -> DataFrame:
    return names.orderBy(F.lower("slug"), "slug")


def page(df: DataFrame, order: list[Column | str], number: int, size: int = 10) -> DataFrame:
    """Page ``number`` (from 0) of the ordered rows."""
    return df.orderBy(*order).offset(number * size).limit(size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    """Number of pages; no rows still make one page."""
    n = F.count("*")
    return df.agg(n.alias("n_rows"), F.greatest(F.ceil(n / size), F.lit(1)).alias("pages"))


def metadata_of(meta: DataFrame, slug: str) -> DataFrame:
    """One metadata row of an exact name (the smallest id)."""
    return meta.filter(F.col("slug") == slug).orderBy("id").limit(1)


# --- dates ----------------------------------------------------------------------------------

def since(df: DataFrame, as_of: dt.date, days: int, date: str = "date") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; the bound is a literal and is pushed down."""
    return df.filter(F.col(date) >= F.lit(as_of - dt.timedelta(days=days)))


def max_date(df: DataFrame, date: str = "date") -> Column:
    return df.agg(F.max(date)).scalar()


def on_latest_date(df: DataFrame, date: str = "date") -> DataFrame:
    return df.filter(F.col(date) == max_date(df, date))


# --- counts ---------------------------------------------------------------------------------

def coverage(df: DataFrame, name: str, date: str = "date") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date")) \
             .select(F.lit(name).alias("table_name"), "n", "first_date", "last_date")


def coverage_shares(parts: list[DataFrame]) -> DataFrame:
    """Coverage of several tables with each one's percent of all rows."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    total = F.nullif(rows.agg(F.sum("n")).scalar(), F.lit(0))
    share = F.bround(F.coalesce(F.try_divide((F.col("n") * 100).cast("double"), total.cast("double")), F.lit(0.0)), 1)
    return rows.withColumn("pct", share)


def pairs_with_metadata(meta: DataFrame) -> DataFrame:
    return meta.select("slug", "chain").distinct()


def pair_count(meta: DataFrame) -> DataFrame:
    """Number of distinct (slug, chain) pairs."""
    return meta.agg(F.count_distinct("slug", "chain").alias("pairs"))


def names_inserted(prices: DataFrame, on: dt.date) -> DataFrame:
    """Names with a row on a date."""
    return prices.filter(F.col("date") == F.lit(on)).select("slug").distinct()


def with_archive(main: DataFrame, archive: DataFrame) -> DataFrame:
    """The whole history: current rows and archived ones."""
    return main.unionByName(archive)


def symbols_available(df: DataFrame, wanted: list[str], symbol: str = "crypto_symbol") -> DataFrame:
    """Wanted symbols of which the table holds rows."""
    return df.filter(F.col(symbol).isin(wanted)).select(F.col(symbol).alias("symbol")).distinct()


def symbols_missing(df: DataFrame, wanted: list[str], symbol: str = "crypto_symbol") -> DataFrame:
    """Wanted symbols of which the table holds no row."""
    names = df.sparkSession.createDataFrame([(w,) for w in wanted], "symbol string")
    return names.join(df.select(F.col(symbol).alias("symbol")).distinct(), "symbol", "left_anti")


def volume_usd(prices: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Sales volume in USD per entity over the last ``days`` days."""
    usd = S.ratio("floor_usd", "floor_native") * F.col("sale_volume_native_24h")
    return since(prices, as_of, days).groupBy(*ENTITY).agg(F.sum(usd).alias("volume_usd"))


def first_symbol(prices: DataFrame, keys: list[str] = ENTITY) -> DataFrame:
    """First known currency symbol in date order."""
    from seriesloom.operators.keyed import first_known
    return prices.groupBy(*keys).agg(first_known("chain_currency_symbol", "date").alias("symbol"))


# --- rankings -------------------------------------------------------------------------------

def top_on_latest(sentiment: DataFrame, n: int, lowest: bool = False) -> DataFrame:
    order = F.asc("sentiment_score") if lowest else F.desc("sentiment_score")
    return on_latest_date(sentiment).orderBy(order, "slug", "chain").limit(n)


def engagement_screen(sentiment: DataFrame, engagement: int = 7, activity: int = 5) -> DataFrame:
    """Entities of the latest date with strong engagement and little activity yet."""
    return on_latest_date(sentiment).filter((F.col("community_engagement") >= engagement) & (F.col("volume_activity") < activity))


def newest(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    return df.orderBy(F.desc(date)).limit(n)


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows by a hash of their key: the same rows however the data is partitioned."""
    return df.orderBy(F.md5(F.concat_ws("|", *keys, F.lit(seed))), *keys).limit(n)


# --- sentiment refresh ----------------------------------------------------------------------

def rows_at_latest_date(prices: DataFrame) -> DataFrame:
    """All rows an entity has on its latest date."""
    last = prices.groupBy(*ENTITY).agg(F.max("date").alias("date"))
    return prices.join(last, [*ENTITY, "date"], "left_semi")


def best_ranked(prices: DataFrame, top_n: int) -> DataFrame:
    """Per (slug, chain) the entity with the best rank among the latest rows; ties to the smallest id."""
    latest = rows_at_latest_date(prices).filter(F.col("ranking") <= top_n)
    best = latest.groupBy("slug", "chain").agg(F.min(F.struct("ranking", "collection_identifier")).alias("b"))
    return best.select("b.collection_identifier", "slug", "chain", "b.ranking")


def handles(meta: DataFrame) -> DataFrame:
    """One non-empty handle per (slug, chain)."""
    return (meta.filter(F.col("x_page").isNotNull() & (F.col("x_page") != ""))
                .groupBy("slug", "chain").agg(F.max("x_page").alias("x_page")))


def ranked_with_handle(prices: DataFrame, meta: DataFrame, top_n: int) -> DataFrame:
    rows = best_ranked(prices, top_n).join(handles(meta), ["slug", "chain"])
    return rows.orderBy("ranking", "slug", "chain").limit(top_n)


def with_last_analysis(rows: DataFrame, sentiment: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Add the last analysis date and whether it is missing or at least ``days`` old."""
    last = sentiment.groupBy("slug", "chain").agg(F.max("date").alias("last_analysis"))
    stale = F.col("last_analysis").isNull() | (F.col("last_analysis") <= F.lit(as_of - dt.timedelta(days=days)))
    return rows.join(last, ["slug", "chain"], "left").withColumn("stale", stale)


def refresh_shares(rows: DataFrame) -> DataFrame:
    """Number and percentage of candidates that are due for a refresh, and of those that are not."""
    counts = rows.groupBy("stale").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.bround((F.col("n") * 100).cast("double") / total.cast("double"), 1))


def display_names(rows: DataFrame, meta: DataFrame) -> DataFrame:
    names = meta.groupBy("slug", "chain").agg(F.min("name").alias("name"))
    return rows.join(names, ["slug", "chain"], "left") \
               .withColumn("display_name", F.coalesce("name", "slug")).drop("name")


def latest_prices(prices: DataFrame) -> DataFrame:
    return latest_row(prices.select("slug", "chain", "date", "collection_identifier", "floor_native", "ranking"),
                      ["slug", "chain"], "date", ["collection_identifier"])


def trend(sentiment: DataFrame, days: int) -> DataFrame:
    """Newest minus oldest score among the newest ``days // 30 + 1`` rows of each entity, as a word."""
    k = days // 30 + 1
    w = Window.partitionBy("slug", "chain").orderBy(F.desc("date"))
    rows = sentiment.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    agg = rows.groupBy("slug", "chain").agg(
        F.count("*").alias("n"), (F.max_by("sentiment_score", "date") - F.min_by("sentiment_score", "date")).alias("change"))
    word = F.when(F.col("change") > 0, "UP").when(F.col("change") < 0, "DOWN").otherwise("STABLE")
    return agg.filter(F.col("n") > 1).withColumn("trend", word)
