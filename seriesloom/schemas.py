"""Declared schemas of the stored tables and of the file payloads."""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string


def _struct(text: str) -> StructType:
    return _parse_datatype_string(text)


PRICE_PANEL = ("collection_identifier string, contract_address string, slug string, date date, "
               "latest_floor_timestamp string, floor_native double, floor_usd double, chain string, "
               "chain_currency_symbol string, marketplace_source string, ranking bigint, unique_owners bigint, "
               "total_supply bigint, listed_count bigint, best_price_url string, sale_count_24h bigint, "
               "sale_volume_native_24h double, highest_sale_native_24h double, lowest_sale_native_24h double")

TABLES = {
    "price_panel": PRICE_PANEL,
    "price_panel_archive": PRICE_PANEL,
    "collections": ("id bigint, collection_identifier string, contract_address string, slug string, name string, "
                    "chain string, chain_currency_symbol string, categories string, x_page string, "
                    "marketplace_url string"),
    "crosses": ("collection_identifier string, slug string, chain string, date date, inserted_ts timestamp, "
                "is_native boolean, floor_native double, floor_usd double, ranking bigint, ma_short double, "
                "ma_long double, ma_short_previous_day double, ma_long_previous_day double, ma_short_period int, "
                "ma_long_period int, telegram_sent boolean, x_sent boolean"),
    "social_hype": ("date date, timestamp timestamp, hype_score int, sentiment string, trend string, "
                    "keywords string, summary string, raw_response string, created_at timestamp"),
    "entity_sentiment": ("collection_identifier string, slug string, chain string, date date, timestamp timestamp, "
                         "sentiment_score int, sentiment_category string, bullish_indicators string, "
                         "bearish_indicators string, key_topics string, community_engagement int, "
                         "volume_activity int, raw_response string, created_at timestamp, summary string"),
    "sentiment_schedule": ("collection_identifier string, slug string, chain string, last_update timestamp, "
                           "next_update timestamp, status string"),
    "fear_greed_daily": "date timestamp, value double, value_classification string, api_timestamp string",
    "crypto_daily_metrics": (
        "date timestamp, crypto_symbol string, id string, name string, image string, current_price double, "
        "market_cap double, market_cap_rank bigint, fully_diluted_valuation double, total_volume double, "
        "high_24h double, low_24h double, price_change_24h double, price_change_percentage_24h double, "
        "market_cap_change_24h double, market_cap_change_percentage_24h double, circulating_supply double, "
        "total_supply double, max_supply double, ath double, ath_change_percentage double, ath_date timestamp, "
        "atl double, atl_change_percentage double, atl_date timestamp, roi_times double, roi_currency string, "
        "roi_percentage double, last_updated timestamp"),
    "ml_signals": ("run_date date, as_of_date date, collection_identifier string, slug string, chain string, "
                   "floor_native double, floor_usd double, signal string, confidence double, top_features string, "
                   "horizon_days int, threshold double, created_at timestamp"),
}

SNAPSHOT_ITEM = (
    "struct<providerCollectionId:string,slug:string,name:string,blockchain:string,nativeCurrency:string,"
    "types:array<string>,ranking:bigint,bestPriceUrl:string,stats:struct<totalOwners:bigint,totalSupply:bigint,"
    "listedCount:bigint,floorInfo:struct<latestFloorTs:bigint,currentFloorNative:double,currentFloorUsd:double,"
    "tokenInfo:struct<contract:string,source:string>>,salesTemporalityNative:struct<count:struct<val24h:bigint>,"
    "volume:struct<val24h:double>,highest:struct<val24h:double>,lowest:struct<val24h:double>>>>")

COIN_ITEM = (
    "struct<symbol:string,id:string,name:string,image:string,current_price:double,market_cap:double,"
    "market_cap_rank:bigint,fully_diluted_valuation:double,total_volume:double,high_24h:double,low_24h:double,"
    "price_change_24h:double,price_change_percentage_24h:double,market_cap_change_24h:double,"
    "market_cap_change_percentage_24h:double,circulating_supply:double,total_supply:double,max_supply:double,"
    "ath:double,ath_change_percentage:double,ath_date:timestamp,atl:double,atl_change_percentage:double,"
    "atl_date:timestamp,roi:struct<times:double,currency:string,percentage:double>,last_updated:timestamp>")

INDEX_PAYLOAD = "data array<struct<value:string,value_classification:string,timestamp:string>>"

CSV_HISTORY = "chain string, collection_identifier string, unused string, ts string, floor_native string"

MARKET_REPLY = "hype_score int, sentiment string, trend string, keywords string, summary string"
ENTITY_REPLY = ("sentiment_score int, sentiment_category string, bullish_indicators string, "
                "bearish_indicators string, key_topics string, community_engagement int, volume_activity int, "
                "summary string")


def schema(name: str) -> StructType:
    return _struct(TABLES[name])


def fields(name: str) -> dict[str, str]:
    """Columns of a table and their types as written, without a session."""
    return dict(field.split() for field in TABLES[name].split(", "))
