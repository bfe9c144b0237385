"""The given tables seen as a price panel, its metadata and its signals.

Amounts are summed in whole cents so that every derived number is the same in any order of
summation. Everything is lazy: a caller that reads three columns pays for three columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesloom.functions import scalars as S

# Fixture values: chain names dealt out by number, currency series dealt out by order status.
CHAINS = ["Ethereum", "solana", "polygon", "Base", "avalanche", "arbitrum", "optimism", "bnb", "blast", "tezos"]
SYMBOLS = {"F": "ETH", "O": "SOL", "P": "BTC"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def chain_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CHAINS]), (number % len(CHAINS) + 1).cast("int"))


def _number_in(c: str) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).cast("int")


# panel key -> (slug, number that picks the chain)
PANEL_KEYS = {
    "p_brand": (lambda: F.col("p_brand"), lambda: _number_in("p_brand")),
    "p_type": (lambda: F.col("p_type"), lambda: F.length("p_type")),
    "l_suppkey": (lambda: F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), lambda: F.col("l_suppkey")),
}

#: Keys that hold a few rows a day, however many rows there are.
FEW_A_DAY = {"l_suppkey"}


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sold lines with day and unit prices."""
    li = table(spark, sf, "lineitem")
    return li.withColumns({
        "date": F.to_date("l_shipdate"),
        "unit": S.ratio("l_extendedprice", "l_quantity"),
        "unit_usd": S.ratio(F.col("l_extendedprice") * (1 - F.col("l_discount")), "l_quantity"),
        "cents": cents("l_extendedprice"),
    })


def panel(spark: SparkSession, sf: str, key: str = "p_brand", ranked: bool = False) -> DataFrame:
    """One row per (entity, day). ``ranked`` adds the rank of the day by volume."""
    rows = sales(spark, sf)
    if key.startswith("p_"):
        rows = rows.join(table(spark, sf, "part").select("p_partkey", key), F.col("l_partkey") == F.col("p_partkey"))
    slug, number = (f() for f in PANEL_KEYS[key])
    day, orders, parts = [key, "date"], F.count_distinct("l_orderkey"), F.count_distinct("l_partkey")
    if key in FEW_A_DAY:
        # Such rows hardly combine ahead of the exchange: they are exchanged once, and distinct orders and parts are counted
        # in the order of each, where two distinct counts exchange three copies of every row.
        rows = rows.select(*day, "unit", "unit_usd", "cents", "l_linenumber", "l_orderkey", "l_partkey").repartition(*day)
        for c in ("l_orderkey", "l_partkey"):
            before = F.lag(c).over(W.partitionBy(*day).orderBy(c))  # NULLs come first
            rows = rows.withColumn(f"_new_{c}", F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(before), 1))
        orders, parts = F.count("_new_l_orderkey"), F.count("_new_l_partkey")
    daily = rows.groupBy(*day).agg(  # the key stands for slug and chain
        F.min("unit").alias("floor_native"),
        F.min("unit_usd").alias("floor_usd"),
        F.count("*").alias("sale_count_24h"),
        (F.sum("cents") / 100.0).alias("sale_volume_native_24h"),
        F.max("unit").alias("highest_sale_native_24h"),
        F.min("unit").alias("lowest_sale_native_24h"),
        F.sum("l_linenumber").alias("listed_count"),
        orders.alias("unique_owners"),
        parts.alias("total_supply"),
    )
    names = daily.columns[len(day):]
    daily = daily.select(slug.alias("slug"), chain_of(number).alias("chain"), "date", *names)
    daily = (daily.withColumn("collection_identifier", F.concat(F.lit("id-"), "slug"))
                  .withColumn("contract_address", F.when(F.length("slug") % 3 != 0, F.md5("slug")))
                  .withColumn("best_price_url", F.when(F.dayofmonth("date") % 3 != 0, F.concat(F.lit("https://best.example/"), "slug")))
                  .withColumn("chain_currency_symbol", S.chain_symbol("chain"))
                  .withColumn("day", S.day_number("date")))
    if ranked:
        by_day = W.partitionBy("date").orderBy(F.desc("sale_volume_native_24h"))
        return daily.withColumn("ranking", F.dense_rank().over(by_day).cast("bigint"))
    return daily.withColumn("ranking", F.lit(None).cast("bigint"))


def raw_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Unaggregated price rows per part: a slug has many ids, an id has several rows a day, and
    some values are missing."""
    rows = sales(spark, sf).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("p_partkey").cast("string").alias("collection_identifier"), F.col("p_name").alias("slug"),
        F.col("p_brand").alias("chain"), "date", S.day_number("date").alias("day"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("unit")).alias("floor_native"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("unit_usd")).alias("floor_usd"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("bigint")).alias("listed_count"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("p_size").cast("bigint")).alias("ranking"),
        F.lit("SYM").alias("chain_currency_symbol"), "cents")


def collections(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata, one row per part."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("collection_identifier"),
        F.col("p_name").alias("slug"), F.initcap("p_name").alias("name"), F.col("p_brand").alias("chain"),
        F.lower("p_type").alias("categories"),
        F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1,
               F.concat(F.lit("@"), F.translate("p_name", " ", "_"))).alias("x_page"),
        F.concat(F.lit("https://market.example/"), F.col("p_partkey").cast("string")).alias("marketplace_url"))


def market_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Market-wide mood per order date: score 0-100, sentiment, trend."""
    o = table(spark, sf, "orders")
    daily = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.sum(cents("o_totalprice")).alias("c"), F.count("*").alias("n"))
    score = F.expr("(2 * c + n * 500000) div (2 * n * 500000)")
    return daily.select(
        "date", score.alias("hype_score"),
        F.when(score >= 55, "POSITIVE").when(score <= 45, "NEGATIVE").otherwise("NEUTRAL").alias("sentiment"),
        F.when(F.col("n") % 3 == 0, "UP").when(F.col("n") % 3 == 1, "DOWN").otherwise("STABLE").alias("trend"))


def index_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Index snapshots, several a day: (date as timestamp, value)."""
    o = table(spark, sf, "orders")
    hourly = F.to_timestamp_ntz(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "),
                                         F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":00:00")))
    return o.select(hourly.alias("date"), (cents("o_totalprice") % 101).cast("double").alias("value"), "o_orderkey")


def symbol_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Currency series: price, traded volume and capitalisation per (symbol, day)."""
    o = table(spark, sf, "orders")
    daily = o.groupBy(S.lookup("o_orderstatus", SYMBOLS).alias("crypto_symbol"),
                      F.to_date("o_orderdate").alias("date")).agg(
        F.sum(cents("o_totalprice")).alias("c"), F.count("*").alias("n"))
    run = F.sum("c").over(W.partitionBy("crypto_symbol").orderBy("date"))
    return daily.select("crypto_symbol", "date", (F.col("c") / F.col("n") / 100.0).alias("current_price"),
                        (F.col("c") / 100.0).alias("total_volume"), (run / 100.0).alias("market_cap"),
                        (-(F.col("c") % 9000) / 100.0).alias("ath_change_percentage"))


def entity_sentiment(spark: SparkSession, sf: str, key: str = "p_brand") -> DataFrame:
    """Monthly sentiment per entity, dated at its last sale of the month."""
    rows = sales(spark, sf)
    if key.startswith("p_"):
        rows = rows.join(table(spark, sf, "part").select("p_partkey", key), F.col("l_partkey") == F.col("p_partkey"))
    slug, number = (f() for f in PANEL_KEYS[key])
    monthly = (rows.withColumn("slug", slug).withColumn("chain", chain_of(number))
               .groupBy("slug", "chain", F.trunc("date", "month").alias("month"))
               .agg(F.max("date").alias("date"), F.count("*").alias("n"),
                    F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("d"),
                    F.sum("l_linenumber").alias("ln")))
    score = F.expr("(20 * d + n) div (2 * n)")
    return monthly.select(
        F.concat(F.lit("id-"), "slug").alias("collection_identifier"), "slug", "chain", "date",
        score.alias("sentiment_score"),
        F.when(score >= 60, "EXTREMELY_BULLISH").when(score >= 52, "BULLISH").when(score >= 48, "NEUTRAL")
         .when(score >= 40, "BEARISH").otherwise("EXTREMELY_BEARISH").alias("sentiment_category"),
        (1 + F.col("n") % 10).alias("community_engagement"), (1 + F.col("ln") % 10).alias("volume_activity"))


def part_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Raw part prices as one row per (entity, day)."""
    return raw_prices(spark, sf).groupBy("collection_identifier", "slug", "chain", "date", "day").agg(
        F.min("floor_native").alias("floor_native"), F.min("floor_usd").alias("floor_usd"),
        F.min("ranking").alias("ranking"), (F.sum("cents") / 100.0).alias("sale_volume_native_24h"))


def brand_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata per brand, the slug of the ``p_brand`` panel."""
    p = table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("slug")).agg(F.max("p_partkey").alias("k")).select(
        "slug", F.concat(F.lit("The "), "slug", F.lit(" - Co")).alias("name"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("@"), "slug")).otherwise("").alias("x_page"),
        F.concat(F.lit("https://market.example/"), F.col("k").cast("string")).alias("marketplace_url"))


def stored_crosses(panel_rows: DataFrame) -> DataFrame:
    """Crossovers of a panel with delivery flags that vary by day."""
    from seriesloom.operators.crosses import detect_crosses
    rows = detect_crosses(panel_rows, 20, 50, 20, 50)
    return (rows.withColumn("telegram_sent", F.dayofmonth("date") % 2 == 0)
                .withColumn("x_sent", F.length("slug") % 2 == 0))
