"""Ingest: payload projection, keyed writes, scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from seriesloom import fixtures as fx
from seriesloom import schemas
from seriesloom.catalog import query
from seriesloom.catalog.base import COLLECTIONS_SQL, r, rs
from seriesloom.functions import scalars as S
from seriesloom.operators import lookups as L
from seriesloom.sinks import keyed_tables as KT
from seriesloom.sources import payloads as P

RUN = dt.date(2024, 1, 15)
_MS = "epoch_us(ts) // 1000"
_SEC = "epoch_us(ts) // 1000000"


def _ms():
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000")


def _snapshots(s, sf):
    """Snapshot JSON text made of events: one payload per row, parsed back with the declared schema."""
    e = fx.table(s, sf, "events")
    text = F.to_json(F.struct(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("providerCollectionId"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("slug"),
        F.element_at(F.array(*[F.lit(c) for c in fx.CHAINS]), (F.col("user_id") % 10 + 1).cast("int")).alias("blockchain"),
        F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("types"),
        F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("Name "), F.col("user_id").cast("string"))).alias("name"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("CUR"), (F.col("user_id") % 3).cast("string"))).alias("nativeCurrency"),
        F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("https://best.example/"), F.col("event_id").cast("string"))).alias("bestPriceUrl"),
        (F.col("event_id") % 7).alias("ranking"),
        F.struct(F.struct(_ms().alias("latestFloorTs"), F.col("value").alias("currentFloorNative"),
                          F.when(F.col("event_id") % 4 != 0, F.col("value") * 2).alias("currentFloorUsd"),
                          F.struct(F.col("props").alias("contract"), F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string")).alias("source")).alias("tokenInfo")).alias("floorInfo"),
                 (F.col("event_id") % 11).alias("totalOwners"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 17).alias("totalSupply"),
                 (F.col("user_id") % 19).alias("listedCount"),
                 F.struct(F.struct((F.col("event_id") % 3).alias("val24h")).alias("count"), F.struct((F.col("value") * 3).alias("val24h")).alias("volume"),
                          F.when(F.col("event_id") % 2 == 0, F.struct((F.col("value") + 1).alias("val24h"))).alias("highest"),
                          F.struct((F.col("value") - 1).alias("val24h")).alias("lowest")).alias("salesTemporalityNative")).alias("stats")))
    return e.select("event_id", F.from_json(text, schemas.SNAPSHOT_ITEM).alias("item"))


_SNAP_SQL = f"""snap AS (SELECT event_id, 'c' || user_id AS collection_identifier, CASE WHEN event_type <> 'error' THEN event_type END AS slug,
 {"[" + ", ".join(f"'{c}'" for c in fx.CHAINS) + "]"}[user_id % 10 + 1] AS chain, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS latest_floor_timestamp,
 value AS floor_native, props AS contract_address, event_id % 7 AS ranking, event_id % 3 AS sale_count_24h,
 CASE WHEN user_id % 4 <> 0 THEN 'Name ' || user_id END AS name, CASE WHEN event_id % 5 <> 0 THEN 'CUR' || (user_id % 3) END AS chain_currency_symbol,
 CASE WHEN event_id % 6 <> 0 THEN 'https://best.example/' || event_id END AS best_price_url, CASE WHEN event_id % 4 <> 0 THEN value * 2 END AS floor_usd,
 'src' || (event_id % 3) AS marketplace_source, event_id % 11 AS unique_owners, CASE WHEN event_id % 13 <> 0 THEN event_id % 17 END AS total_supply,
 user_id % 19 AS listed_count, value * 3 AS sale_volume_native_24h, CASE WHEN event_id % 2 = 0 THEN value + 1 END AS highest_sale_native_24h,
 value - 1 AS lowest_sale_native_24h,
 CASE WHEN event_id % 2 = 0 THEN event_type || ', x' END AS categories FROM events)"""
_SNAP_COLS = list(schemas.fields("price_panel"))

query("snapshot_projection", f"WITH {_SNAP_SQL} SELECT {', '.join(_SNAP_COLS)} FROM snap")(
    lambda s, sf: P.price_rows(_snapshots(s, sf)).select(*_SNAP_COLS))
query("snapshot_run_date", f"WITH {_SNAP_SQL} SELECT CASE WHEN date = DATE '{RUN}' THEN 'usable' ELSE 'other_date' END AS outcome, count(*) AS n FROM snap GROUP BY 1")(
    lambda s, sf: KT.outcome_counts(P.with_date_outcome(P.price_rows(_snapshots(s, sf)), RUN)))
query("metadata_projection", f"WITH {_SNAP_SQL} SELECT collection_identifier, slug, chain, categories, contract_address, 'usable' AS outcome FROM snap")(
    lambda s, sf: P.metadata_rows(_snapshots(s, sf)).select("collection_identifier", "slug", "chain", "categories", "contract_address", "outcome"))
_MATCH = P.METADATA_MATCH
query("metadata_new_rows", f"""WITH {_SNAP_SQL} SELECT DISTINCT {', '.join(_MATCH)} FROM snap
 EXCEPT SELECT {', '.join(_MATCH)} FROM snap WHERE event_id % 5 = 0""")(
    lambda s, sf: KT.new_by_all(P.metadata_rows(_snapshots(s, sf).filter("event_id % 5 = 0")), P.metadata_rows(_snapshots(s, sf)), _MATCH).select(*_MATCH))


_COIN_NUMBERS = [c for c, kind in schemas.fields("crypto_daily_metrics").items() if kind in ("double", "bigint") and not c.startswith("roi_")]
_COIN_TIMES = ["ath_date", "atl_date", "last_updated"]


def _coins(s, sf):
    """Coin JSON of all fields: number k of the schema is value + k, or a whole number where the schema asks for one."""
    e = fx.table(s, sf, "events")
    whole = "market_cap_rank"
    numbers = [(F.col("event_id") % 100 if c == whole else F.when((F.col("event_id") % (k + 2) != 0) | F.lit(k == 0), F.col("value") + k)).alias(c)
               for k, c in enumerate(_COIN_NUMBERS)]
    text = F.to_json(F.struct(
        F.col("event_type").alias("symbol"), *[F.concat(F.lit(f"{c}-"), "event_type").alias(c) for c in ("id", "name", "image")], *numbers,
        *[F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) for c in _COIN_TIMES],
        F.when(F.col("event_id") % 2 == 0, F.struct(F.col("value").alias("times"), F.lit("usd").alias("currency"), (F.col("value") * 100).alias("percentage"))).alias("roi")))
    item = F.from_json(text, schemas.COIN_ITEM)
    return P.coin_rows(e.select("ts", item.alias("item")), F.col("ts"))


_COIN_SQL = [f"event_id % 100 AS {c}" if c == "market_cap_rank" else f"CASE WHEN event_id % {k + 2} <> 0 OR {k} = 0 THEN value + {k} END AS {c}" for k, c in enumerate(_COIN_NUMBERS)]
query("coin_projection", f"""SELECT date_trunc('hour', ts) AS date, upper(event_type) AS crypto_symbol, {', '.join(f"'{c}-' || event_type AS {c}" for c in ('id', 'name', 'image'))},
 {', '.join(_COIN_SQL)}, {', '.join(f"date_trunc('second', ts) AS {c}" for c in _COIN_TIMES)}, CASE WHEN event_id % 2 = 0 THEN value END AS roi_times,
 CASE WHEN event_id % 2 = 0 THEN 'usd' END AS roi_currency, CASE WHEN event_id % 2 = 0 THEN value * 100 END AS roi_percentage FROM events""")(
    lambda s, sf: _coins(s, sf).select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in _COIN_TIMES else F.col(c) for c in schemas.fields("crypto_daily_metrics")]))
query("coin_insert_hourly", """SELECT date_trunc('hour', ts) AS date, upper(event_type) AS crypto_symbol, min(value) AS current_price FROM events GROUP BY 1, 2""")(
    lambda s, sf: (lambda c: KT.new_rows(c.limit(0), c, ["date", "crypto_symbol"], ["current_price"]))(
        _coins(s, sf).select("date", "crypto_symbol", "current_price")))


def _index_payloads(s, sf):
    e = fx.table(s, sf, "events")
    entry = F.struct(F.col("value").cast("string").alias("value"),
                     F.when(F.col("event_type") != "error", F.col("event_type")).alias("value_classification"),
                     F.col("event_id").cast("string").alias("timestamp"))
    data = F.when(F.col("event_id") % 4 == 0, F.array().cast("array<struct<value:string,value_classification:string,timestamp:string>>")).otherwise(F.array(entry))
    return P.index_rows(e.select("ts", data.alias("data")), F.col("ts"))


query("index_projection", """SELECT date_trunc('hour', ts) AS date, value, event_type AS value_classification, CAST(event_id AS VARCHAR) AS api_timestamp
 FROM events WHERE event_id % 4 <> 0 AND event_type <> 'error'""")(_index_payloads)


def _replies(s, sf):
    e = fx.table(s, sf, "events")
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("Here it is:\n"), F.col("props"), F.lit("\nThanks"))) \
            .when(kind == 1, F.lit("no object here")).when(kind == 2, F.concat(F.lit("{broken "), F.col("props"))).otherwise(F.col("props"))
    return e.withColumn("text", text)


query("reply_object", """SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")(
    lambda s, sf: _replies(s, sf).select("event_id", P.reply_object("text", "k bigint")["k"].alias("k")))
query("reply_object_strict", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")(
    lambda s, sf: _replies(s, sf).select("event_id", P.reply_object("text", "k bigint", strict=True)["k"].alias("k")))


def _market_replies(s, sf):
    e = fx.table(s, sf, "events")
    k = e.select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return P.market_replies(k.withColumn("text", F.concat(F.lit("Sure! {\"hype_score\": "), "k", F.lit("} done"))), "text", "event_id")


query("market_replies", """SELECT event_id AS date, CAST(json_extract(props, '$.k') AS INTEGER) AS hype_score, 'NEUTRAL' AS sentiment, 'STABLE' AS trend,
 '' AS keywords FROM events""")(lambda s, sf: _market_replies(s, sf).select("date", "hype_score", "sentiment", "trend", "keywords"))

# --- keyed writes ---------------------------------------------------------------------------

_OD = "o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice FROM orders)"


def _orders(s, sf):
    return fx.table(s, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice")


_K = ["o_custkey", "date"]
query("insert_if_absent", f"""WITH {_OD} SELECT o_custkey, date, min(o_orderkey) AS o_orderkey FROM o
 WHERE (o_custkey, date) NOT IN (SELECT o_custkey, date FROM o WHERE o_orderkey % 3 = 0) GROUP BY 1, 2""")(
    lambda s, sf: (lambda o: KT.new_rows(o.filter("o_orderkey % 3 = 0"), o, _K, ["o_orderkey"]).select(*_K, "o_orderkey"))(_orders(s, sf)))
query("insert_report", f"""WITH {_OD}, t AS (SELECT *, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey, date)
  AND (o_custkey, date) NOT IN (SELECT o_custkey, date FROM o WHERE o_orderkey % 3 = 0) THEN 1 ELSE 0 END AS fresh FROM o)
 SELECT count(*) AS total, CAST(sum(fresh) AS BIGINT) AS inserted, count(*) - CAST(sum(fresh) AS BIGINT) AS skipped FROM t""")(
    lambda s, sf: (lambda o: KT.insert_counts(o.filter("o_orderkey % 3 = 0"), o, _K))(_orders(s, sf)))
query("ingest_run_report", f"""WITH {_SNAP_SQL}, k AS (SELECT DISTINCT collection_identifier, chain, date FROM snap WHERE date = DATE '{RUN}')
 SELECT 'inserted' AS outcome, (SELECT count(*) FROM k) AS n UNION ALL SELECT 'skipped', (SELECT count(*) FROM snap WHERE date = DATE '{RUN}') - (SELECT count(*) FROM k)
 UNION ALL SELECT 'other_date', count(*) FROM snap WHERE date <> DATE '{RUN}'""")(
    lambda s, sf: (lambda t: KT.run_report(t, t.limit(0), ["collection_identifier", "chain", "date"]))(
        P.with_date_outcome(P.price_rows(_snapshots(s, sf)), RUN)))
query("upsert_newest", f"""WITH {_OD}, m AS (SELECT *, o_orderkey % 2 AS side FROM o)
 SELECT o_custkey, date, o_orderkey, o_totalprice FROM m QUALIFY row_number() OVER (PARTITION BY o_custkey, date ORDER BY side DESC, o_orderkey DESC) = 1""")(
    lambda s, sf: (lambda o: KT.merged(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), _K, "o_orderkey"))(_orders(s, sf)))
query("upsert_defaults", """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE 5 END AS community_engagement,
 CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'NEUTRAL' END AS sentiment_category FROM part""")(
    lambda s, sf: KT.with_defaults(fx.table(s, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("community_engagement"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("sentiment_category")),
        {"community_engagement": 5, "sentiment_category": "NEUTRAL"}))
_CUT = dt.date(2001, 7, 31)
query("archive_kept", f"WITH {_OD} SELECT * FROM o WHERE date >= DATE '{_CUT}' - 365")(
    lambda s, sf: (lambda o: KT.archive_split(o, o.limit(0), ["o_orderkey"], _CUT)[0])(_orders(s, sf)))
query("archive_moved", f"WITH {_OD} SELECT * FROM o WHERE date < DATE '{_CUT}' - 365 AND date >= DATE '1996-01-01'")(
    lambda s, sf: (lambda o: KT.archive_split(o, o.filter("date < DATE '1996-01-01'"), ["o_orderkey"], _CUT)[1])(_orders(s, sf)))
query("archive_report", f"WITH {_OD} SELECT count(*) AS archived_count, CAST(DATE '{_CUT}' - 365 AS DATE) AS cutoff_date FROM o WHERE date < DATE '{_CUT}' - 365")(
    lambda s, sf: (lambda o: KT.archive_split(o, o.limit(0), ["o_orderkey"], _CUT)[2])(_orders(s, sf)))
query("backfill_column", f"""WITH {_OD}, v AS (SELECT o_custkey, date, max(o_totalprice) AS v FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)
 SELECT o.o_orderkey, o.o_custkey, o.date, v AS o_totalprice FROM o LEFT JOIN v USING (o_custkey, date)""")(
    lambda s, sf: (lambda o: KT.backfilled(o.drop("o_totalprice"), o.filter("o_orderkey % 2 = 0"), _K, "o_totalprice")
                   .select("o_orderkey", *_K, "o_totalprice"))(_orders(s, sf)))
query("stamp_signals", f"""WITH {_OD} SELECT o_orderkey, date, (SELECT max(date) FROM o) AS as_of_date, DATE '{RUN}' AS run_date,
 14 AS horizon_days, CAST(0.1 AS DOUBLE) AS threshold FROM o""")(
    lambda s, sf: KT.stamped_signals(_orders(s, sf), RUN, 14, 0.1).select(
        "o_orderkey", "date", "as_of_date", "run_date", "horizon_days", "threshold"))

# --- scalar functions -----------------------------------------------------------------------

query("epoch_conversions", f"""SELECT event_id, CAST(ts AS DATE) AS d_ms, CAST(ts AS DATE) AS d_s, strftime(ts, '%H:%M') AS t_ms, strftime(ts, '%H:%M') AS t_s FROM events""")(
    lambda s, sf: fx.table(s, sf, "events").withColumn("ms", _ms()).withColumn("sec", F.expr("ms div 1000")).select(
        "event_id", S.epoch_date("ms").alias("d_ms"), S.epoch_date("sec").alias("d_s"),
        S.epoch_clock("ms").alias("t_ms"), S.epoch_clock("sec").alias("t_s")))
query("offset_local_dates", """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS DATE) END AS d FROM events""")(
    lambda s, sf: fx.table(s, sf, "events").select("event_id", S.offset_local_date(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                 F.when(F.col("event_id") % 3 == 1, "+0530").when(F.col("event_id") % 3 == 2, "-08:00").otherwise(""))).alias("d")))
query("number_coercion", """SELECT c_custkey, c_acctbal AS n, NULL::DOUBLE AS bad FROM customer""")(
    lambda s, sf: fx.table(s, sf, "customer").select("c_custkey", S.to_number(F.col("c_acctbal").cast("string")).alias("n"),
                                                     S.to_number("c_name").alias("bad")))
query("chain_codes", """SELECT c_custkey, CASE lower(chain) WHEN 'ethereum' THEN 0 WHEN 'solana' THEN 1 WHEN 'polygon' THEN 2 WHEN 'base' THEN 3
 WHEN 'avalanche' THEN 4 WHEN 'arbitrum' THEN 5 WHEN 'optimism' THEN 6 WHEN 'bnb' THEN 7 WHEN 'blast' THEN 8 ELSE 99 END AS code,
 CASE lower(chain) WHEN 'ethereum' THEN 'ETH' WHEN 'base' THEN 'ETH' WHEN 'polygon' THEN 'MATIC' WHEN 'solana' THEN 'SOL' WHEN 'arbitrum' THEN 'ARB'
 WHEN 'optimism' THEN 'OP' WHEN 'bnb' THEN 'BNB' WHEN 'blast' THEN 'BLAST' END AS symbol
 FROM (SELECT c_custkey, """ + "[" + ", ".join(f"'{c}'" for c in fx.CHAINS) + "]" + """[c_custkey % 10 + 1] AS chain FROM customer)""")(
    lambda s, sf: fx.table(s, sf, "customer").withColumn("chain", fx.chain_of(F.col("c_custkey"))).select(
        "c_custkey", S.chain_code("chain").alias("code"), S.chain_symbol("chain").alias("symbol")))
query("mood_codes", """SELECT c_custkey, CASE m WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END AS mood, CASE t WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 ELSE 0 END AS trend
 FROM (SELECT c_custkey, ['POSITIVE', 'NEUTRAL', 'NEGATIVE', 'odd'][c_custkey % 4 + 1] AS m, ['UP', 'STABLE', 'DOWN'][c_custkey % 3 + 1] AS t FROM customer)""")(
    lambda s, sf: fx.table(s, sf, "customer").select(
        "c_custkey", S.mood_code(F.element_at(F.array(*[F.lit(x) for x in ("POSITIVE", "NEUTRAL", "NEGATIVE", "odd")]), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("mood"),
        S.trend_code(F.element_at(F.array(*[F.lit(x) for x in ("UP", "STABLE", "DOWN")]), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("trend")))
query("text_functions", """SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
 replace(replace(t, ' ', ''), '-', '') AS tag, c_name AS handle
 FROM (SELECT *, '<b>' || c_name || '</b> & co - ' || c_mktsegment AS t FROM customer)""")(
    lambda s, sf: fx.table(s, sf, "customer").withColumn("t", F.concat(F.lit("<b>"), "c_name", F.lit("</b> & co - "), "c_mktsegment")).select(
        "c_custkey", F.lower("c_name").alias("lo"), F.upper("c_mktsegment").alias("up"), S.html_escape("t").alias("html"),
        S.hash_tag("t").alias("tag"), S.without_at(F.concat(F.lit("@@"), "c_name")).alias("handle")))
query("labels_from_returns", """SELECT c_custkey, CASE WHEN x >= 0.1 THEN 1 WHEN x <= -0.1 THEN -1 ELSE 0 END AS three, CASE WHEN x >= 0.1 THEN 1 ELSE 0 END AS two,
 CASE WHEN x >= 0.1 THEN 'BUY' WHEN x <= -0.1 THEN 'SELL' ELSE 'HOLD' END AS signal
 FROM (SELECT c_custkey, (c_acctbal - 4500) / 20000 AS x FROM customer)""")(
    lambda s, sf: fx.table(s, sf, "customer").withColumn("x", (F.col("c_acctbal") - 4500) / 20000).select(
        "c_custkey", S.three_way("x", 0.1, 0.1).alias("three"), S.at_least("x", 0.1).alias("two"),
        S.signal_text(S.three_way("x", 0.1, 0.1)).alias("signal")))
query("finite_values", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS v FROM lineitem""")(
    lambda s, sf: fx.table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", S.finite(
        F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(S.ratio("l_extendedprice", "l_discount"))).alias("v")))
query("profit_and_dates", f"""SELECT o_orderkey, {rs('(o_totalprice - b) / nullif(b, 0) * 100')} AS profit_pct, strftime(o_orderdate, '%d-%m-%Y') AS day
 FROM (SELECT *, CAST(o_orderkey % 5 AS DOUBLE) AS b FROM orders)""")(
    lambda s, sf: fx.table(s, sf, "orders").select("o_orderkey", r(S.profit_pct("o_totalprice", (F.col("o_orderkey") % 5).cast("double"))).alias("profit_pct"),
                                                   S.day_text("o_orderdate").alias("day")))
query("seeded_sample", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey || '|42'), c_custkey LIMIT 200")(lambda s, sf: L.seeded_sample(fx.table(s, sf, "customer").select("c_custkey"), ["c_custkey"], 200))
query("rank_cutoff", f"WITH {COLLECTIONS_SQL} SELECT id FROM collections WHERE id <= 100 AND x_page IS NOT NULL AND x_page <> ''")(
    lambda s, sf: fx.collections(s, sf).filter((F.col("id") <= 100) & F.col("x_page").isNotNull() & (F.col("x_page") != "")).select("id"))
