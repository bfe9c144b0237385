"""Nested payloads to rows: price snapshots, metadata, coins, the index and model replies.

Every function takes a frame that holds the payload, so that files, streams and tables share it.
A row that cannot be used stays, with its ``outcome``, for the run report.
"""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom import schemas
from seriesloom.functions import codes
from seriesloom.functions import scalars as S

# --- files ----------------------------------------------------------------------------------


def read_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of JSON files that hold an array, or an object with the array under ``data``.

    Each file is one text; files are read in parallel. A file of another shape gives no item and
    is named by ``rejected_files``.
    """
    text = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return text.select("file", F.explode(_items("value", item)).alias("item"))


def _items(c: str, item: str) -> Column:
    plain = F.from_json(c, f"array<{item}>")
    wrapped = F.from_json(c, f"struct<data:array<{item}>>")["data"]
    return F.when(F.ltrim(F.col(c)).startswith("["), plain).otherwise(wrapped)


def rejected_files(spark: SparkSession, path: str, item: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return text.filter(_items("value", item).isNull()).select("file")


@contextmanager
def _listed_in_few_tasks(spark: SparkSession):
    """Folders of a read are listed in at most as many tasks as a shuffle has; Spark's own setting is a task a folder, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def snapshot_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of multi-line JSON files in one streaming read: file, outcome (item, empty, rejected), reason, item.

    A file holds an array of items or an object with the array under ``data`` (an empty one is told as such). What is no
    JSON, an object of another kind and an element without any known field come as one rejected row each. A file that is one bare
    item counts as an array of one: use ``read_items`` where that must be told apart, at the price of a text per file.
    """
    item = schemas._struct(schemas.SNAPSHOT_ITEM[len("struct<"):-1])
    schema = T.StructType([*item.fields, T.StructField("data", T.ArrayType(item)), T.StructField("_corrupt_record", T.StringType())])
    with _listed_in_few_tasks(spark):
        read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    read = read.select("*", F.col("_metadata.file_path").alias("file"))
    known = F.lit(False)
    for name in item.names:
        known = known | F.col(name).isNotNull()
    one = F.when(known, F.array(F.struct(*item.names)))
    items = F.when(F.col("_corrupt_record").isNull(), F.coalesce("data", one))
    rows = read.select("file", F.col("data").isNotNull().alias("_list"), F.substring("_corrupt_record", 1, 200).alias("reason"),
                       F.explode_outer(items).alias("item"))
    outcome = F.when(F.col("item").isNotNull(), "item").when(F.col("_list"), "empty").otherwise("rejected")
    return rows.select("file", outcome.alias("outcome"), "reason", "item")


def keep_raw(raw: DataFrame, landing: str, date: dt.date) -> None:
    """Keep a payload as dated JSON files."""
    raw.write.mode("append").json(f"{landing}/date={date.isoformat()}")


# --- price snapshots ------------------------------------------------------------------------

def price_rows(items: DataFrame, item: str = "item") -> DataFrame:
    """The 19 panel columns of each snapshot item; empty text counts as missing, 0 does not."""
    def text(path):
        return S.blank_to_null(F.col(f"{item}.{path}"))

    def value(path):
        return F.col(f"{item}.{path}")

    ts = value("stats.floorInfo.latestFloorTs")
    sales = "stats.salesTemporalityNative"
    return items.select(
        text("providerCollectionId").alias("collection_identifier"),
        text("stats.floorInfo.tokenInfo.contract").alias("contract_address"),
        text("slug").alias("slug"), S.epoch_date(ts).alias("date"), S.epoch_clock(ts).alias("latest_floor_timestamp"),
        value("stats.floorInfo.currentFloorNative").alias("floor_native"),
        value("stats.floorInfo.currentFloorUsd").alias("floor_usd"),
        text("blockchain").alias("chain"), text("nativeCurrency").alias("chain_currency_symbol"),
        text("stats.floorInfo.tokenInfo.source").alias("marketplace_source"), value("ranking").alias("ranking"),
        value("stats.totalOwners").alias("unique_owners"), value("stats.totalSupply").alias("total_supply"),
        value("stats.listedCount").alias("listed_count"), text("bestPriceUrl").alias("best_price_url"),
        value(f"{sales}.count.val24h").alias("sale_count_24h"),
        value(f"{sales}.volume.val24h").alias("sale_volume_native_24h"),
        value(f"{sales}.highest.val24h").alias("highest_sale_native_24h"),
        value(f"{sales}.lowest.val24h").alias("lowest_sale_native_24h"))


def with_date_outcome(rows: DataFrame, run_date: dt.date) -> DataFrame:
    """``outcome``: usable for rows of the run date, else other_date."""
    same = F.coalesce(F.col("date") == F.lit(run_date), F.lit(False))
    return rows.withColumn("outcome", F.when(same, "usable").otherwise("other_date"))


def metadata_rows(items: DataFrame, item: str = "item") -> DataFrame:
    """Metadata of each item with ``outcome``: usable, or error without an identifier or a chain."""
    i = F.col(item)
    text = {a: S.blank_to_null(i[b]) for a, b in {
        "collection_identifier": "providerCollectionId", "slug": "slug", "name": "name", "chain": "blockchain",
        "chain_currency_symbol": "nativeCurrency"}.items()}
    rows = items.select(
        *[c.alias(a) for a, c in text.items()],
        S.blank_to_null(i["stats"]["floorInfo"]["tokenInfo"]["contract"]).alias("contract_address"),
        S.joined(S.empty_to_null(i["types"])).alias("categories"))
    usable = F.col("collection_identifier").isNotNull() & F.col("chain").isNotNull()
    return rows.withColumn("outcome", F.when(usable, "usable").otherwise("error"))


#: Columns on which stored metadata is compared.
METADATA_MATCH = ["collection_identifier", "slug", "name", "chain", "chain_currency_symbol", "categories"]

# --- coins and the index --------------------------------------------------------------------


def coin_rows(items: DataFrame, taken_at: Column, item: str = "item") -> DataFrame:
    """Coin snapshot with upper-case symbol, the optional ``roi`` flattened and the hour stamped."""
    plain = [f.name for f in schemas.schema("crypto_daily_metrics").fields
             if f.name not in ("date", "crypto_symbol", "roi_times", "roi_currency", "roi_percentage", "last_updated")]
    i = F.col(item)
    return items.select(
        F.date_trunc("hour", taken_at).alias("date"), F.upper(i["symbol"]).alias("crypto_symbol"),
        *[i[c].alias(c) for c in plain], i["roi"]["times"].alias("roi_times"),
        i["roi"]["currency"].alias("roi_currency"), i["roi"]["percentage"].alias("roi_percentage"),
        i["last_updated"].alias("last_updated"))


def usable(rows: DataFrame, good: Column, outcomes: bool) -> DataFrame:
    """The good rows; or all of them with an ``outcome`` (usable, error), for the run report."""
    if outcomes:
        return rows.withColumn("outcome", F.when(F.coalesce(good, F.lit(False)), "usable").otherwise("error"))
    return rows.filter(good)


def index_rows(payload: DataFrame, taken_at: Column, data: str = "data", outcomes: bool = False) -> DataFrame:
    """First element of ``data``; payloads without a value or a class are rejected (see ``usable``)."""
    first = F.try_element_at(F.col(data), F.lit(1))
    rows = payload.select(
        F.date_trunc("hour", taken_at).alias("date"), S.to_number(first["value"]).alias("value"),
        S.blank_to_null(first["value_classification"]).alias("value_classification"),
        first["timestamp"].alias("api_timestamp"))
    return usable(rows, F.col("value").isNotNull() & F.col("value_classification").isNotNull(), outcomes)


# --- replies --------------------------------------------------------------------------------

def reply_object(text: str | Column, schema: str, strict: bool = False) -> Column:
    """The JSON object inside a free text, from the first to the last brace; NULL when there is none
    or it cannot be parsed. ``strict`` takes the whole text as the object."""
    t = S.col(text)
    body = F.trim(t) if strict else F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    # As the only element of an array, so that text behind a complete object makes it unparsable.
    one = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<struct<{_typed(schema)}>>",
                      {"allowSingleQuotes": "false"})
    return F.when(body.startswith("{") & (F.size(one) == 1), one[0])


def _typed(schema: str) -> str:
    """``a int, b string`` as the fields of a struct type."""
    return ", ".join(":".join(field.split()) for field in schema.split(","))


def market_replies(texts: DataFrame, text: str, date: str, outcomes: bool = False) -> DataFrame:
    """Market mood rows of parsed replies with the defaults of missing fields; others are rejected (see ``usable``)."""
    fields = list(codes.MARKET_REPLY_DEFAULTS)
    rows = usable(texts.withColumn("_r", reply_object(text, schemas.MARKET_REPLY)), F.col("_r").isNotNull(), outcomes)
    return rows.select(*["outcome"] * outcomes, F.col(date).alias("date"), *[S.or_default(F.col(f"_r.{c}"), codes.MARKET_REPLY_DEFAULTS[c]).alias(c)
                                                   for c in fields], F.col(text).alias("raw_response"))


def entity_replies(texts: DataFrame, text: str, keys: list[str], outcomes: bool = False) -> DataFrame:
    """Entity sentiment rows of replies that are one JSON object as a whole; others are rejected (see ``usable``)."""
    d = codes.ENTITY_REPLY_DEFAULTS
    rows = usable(texts.withColumn("_r", reply_object(text, schemas.ENTITY_REPLY, strict=True)), F.col("_r").isNotNull(), outcomes)
    return rows.select(*["outcome"] * outcomes, *keys, *[S.or_default(F.col(f"_r.{c}"), v).alias(c) for c, v in d.items()],
                       F.col("_r.summary").alias("summary"), F.col(text).alias("raw_response"))
