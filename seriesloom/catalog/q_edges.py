"""Queries over inputs with awkward rows: several identifiers, several snapshots a day, NULL keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesloom import fixtures as fx
from seriesloom.catalog import ORACLES, q_crosses, q_features, q_lookups, query
from seriesloom.catalog.base import r
from seriesloom.operators import asof as AS
from seriesloom.operators import crosses as X
from seriesloom.operators import features as FE
from seriesloom.session import shared_folder
from seriesloom.sinks import keyed_tables as KT


@query("cross_history_many_ids", ORACLES["cross_history_20_50"])
def cross_history_many_ids(spark, sf):
    """A second identifier of each slug asks more, so the crossovers are those of the first."""
    panel = fx.panel(spark, sf, "p_type")
    dearer = panel.withColumns({"collection_identifier": F.concat(F.lit("second-"), "collection_identifier"),
                                "floor_native": F.col("floor_native") * 1.5, "floor_usd": F.col("floor_usd") * 1.5})
    return q_crosses.cross_rows(X.detect_crosses(panel.unionByName(dearer), 20, 50, 1, 3))


@query("symbol_features_hourly", ORACLES["symbol_features"])
def symbol_features_hourly(spark, sf):
    """Three snapshots a day; the first one counts."""
    daily = fx.symbol_daily(spark, sf)
    hourly = daily.withColumn("_h", F.explode(F.array(F.lit(7), F.lit(0), F.lit(23))))
    hourly = hourly.withColumn("current_price", F.col("current_price") * (1 + F.col("_h"))).withColumn(
        "date", F.to_timestamp_ntz(F.concat(F.date_format("date", "yyyy-MM-dd"), F.format_string(" %02d:30:00", "_h"))))
    f = FE.symbol_features(hourly.drop("_h"))
    return f.select("crypto_symbol", "date", *[r(c).alias(c) for c in FE.SYMBOL_FEATURES])


_NULLED = "CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts"


@query("asof_null_keys", f"""WITH e AS (SELECT event_id, event_type, value, {_NULLED} FROM events),
 v AS (SELECT user_id, ts, value AS view_value, CAST(event_id AS VARCHAR) AS view_id FROM e WHERE event_type = 'view' AND user_id IS NOT NULL AND ts IS NOT NULL)
 SELECT p.user_id, p.event_id, p.ts, v.ts AS asof_ts, v.view_value, v.view_id FROM (SELECT * FROM e WHERE event_type = 'purchase') p
 ASOF LEFT JOIN v ON v.user_id = p.user_id AND p.ts >= v.ts""")
def asof_null_keys(spark, sf):
    e = fx.table(spark, sf, "events").withColumns({
        "user_id": F.when(F.col("event_id") % 5 != 0, F.col("user_id")), "ts": F.when(F.col("event_id") % 7 != 0, F.col("ts"))})
    left = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"),
                                                   F.col("event_id").cast("string").alias("view_id"))
    return AS.asof_join(left, right, ["user_id"], "ts", ["view_value", "view_id"], "view_id")


@query("mark_delivered_by_chain", f"""WITH {q_lookups._FLAGS} SELECT {q_lookups._CK}, telegram_sent,
 x_sent OR (date < DATE '1999-01-01' AND chain < 'e' AND is_native) AS x_sent FROM stored""")
def mark_delivered_by_chain(spark, sf):
    stored = q_lookups._stored(spark, sf)
    sent = stored.filter("date < DATE '1999-01-01' AND chain < 'e' AND is_native")
    return X.mark_delivered(stored, sent, "x_sent").select(*q_lookups._CKEY, "telegram_sent", "x_sent")


# --- table writes, read back ------------------------------------------------------------------

_ORDER_ROWS = "SELECT CAST(o_orderkey % 1000 AS BIGINT) AS k, CAST(o_orderdate AS DATE) AS date, o_orderkey AS v FROM orders"
_NULL_DATES = "SELECT k, CASE WHEN v % 11 <> 0 THEN date END AS date, v FROM rows0"


def _order_rows(spark, sf):
    o = fx.table(spark, sf, "orders").select((F.col("o_orderkey") % 1000).alias("k"), F.to_date("o_orderdate").alias("date"),
                                             F.col("o_orderkey").alias("v"))
    return o.withColumn("date", F.when(F.col("v") % 11 != 0, F.col("date")))


def _table(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("upsert_table", f"""WITH rows0 AS ({_ORDER_ROWS}), rows AS ({_NULL_DATES})
 SELECT k, date, max(v) AS v FROM rows GROUP BY k, date""")
def upsert_table(spark, sf):
    """Two batches into one table by (k, date); the greatest v of a key stays, without a date as well."""
    rows, path = _order_rows(spark, sf), _table(spark, "upsert")
    for part in (0, 1):
        KT.upsert(rows.filter(F.col("v") % 2 == part), path, ["k", "date"], "v")
    return spark.read.parquet(path).select("k", "date", "v")


@query("archive_table", f"""WITH rows0 AS ({_ORDER_ROWS}), rows AS ({_NULL_DATES}), one AS (SELECT k, date, max(v) AS v FROM rows GROUP BY k, date)
 SELECT CASE WHEN date < DATE '{q_lookups.AS_OF}' - 365 THEN 'archive' ELSE 'main' END AS place, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM one GROUP BY 1""")
def archive_table(spark, sf):
    """Rows older than a year leave the main table for the archive."""
    rows, main, archive = _order_rows(spark, sf), _table(spark, "main"), _table(spark, "archive")
    KT.upsert(rows, main, ["k", "date"], "v")
    schema = rows.schema
    KT.archive_move(spark, main, archive, schema, ["k", "date"], q_lookups.AS_OF)
    places = [KT.stored_rows(spark, p, schema).withColumn("place", F.lit(n)) for n, p in (("main", main), ("archive", archive))]
    return places[0].unionByName(places[1]).groupBy("place").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
