"""Lookups, counts, rankings, joins and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from seriesloom import fixtures as fx
from seriesloom.catalog import query
from seriesloom.catalog.base import (COLLECTIONS_SQL, MARKET_SQL, RAW_SQL, filled_day_by_day_sql, panel_sql, r, rs, sales_sql,
                                     sentiment_sql)
from seriesloom.catalog.q_crosses import crosses_sql, series_sql
from seriesloom.functions import codes
from seriesloom.operators import asof as AS
from seriesloom.operators import averages as A
from seriesloom.operators import calendar as C
from seriesloom.operators import crosses as X
from seriesloom.operators import keyed as K
from seriesloom.operators import lookups as L
from seriesloom.plans import reports as R
from seriesloom.session import stored

AS_OF = dt.date(2001, 6, 30)
ON = dt.date(1998, 8, 2)
PART_DAILY = f"""{RAW_SQL}, part_daily AS (
 SELECT collection_identifier, slug, chain, date, day, min(floor_native) AS floor_native, min(floor_usd) AS floor_usd,
  min(ranking) AS ranking, CAST(sum(cents) AS DOUBLE) / 100.0 AS sale_volume_native_24h
 FROM raw GROUP BY 1, 2, 3, 4, 5)"""
SENT = f"{sales_sql('p_brand')}, {sentiment_sql()}"
LATEST_SENT = f"{SENT}, latest AS (SELECT * FROM sentiment WHERE date = (SELECT max(date) FROM sentiment))"


def add(name, sql):
    return query(name, sql)


# --- names and paging -----------------------------------------------------------------------

add("names_by_prefix", "SELECT p_name AS slug FROM part WHERE p_name ILIKE 'S%'")(
    lambda s, sf: L.sorted_names(L.names_by_prefix(fx.collections(s, sf), "S")))
add("names_by_chain", "SELECT p_name AS slug FROM part WHERE lower(p_brand) = 'brand#12'")(
    lambda s, sf: L.sorted_names(L.names_by_chain(fx.collections(s, sf), "BRAND#12")))
add("names_by_category", "SELECT p_name AS slug FROM part WHERE lower(p_type) = 'promo'")(
    lambda s, sf: L.sorted_names(L.names_by_category(fx.collections(s, sf), "Promo")))
add("names_by_category_element", "SELECT p_name AS slug FROM part WHERE lower(p_type) = 'small'")(
    lambda s, sf: L.names_by_category(fx.collections(s, sf), "Small", any_of_list=True))
add("names_page", "SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 10 OFFSET 30")(
    lambda s, sf: L.page(fx.table(s, sf, "customer").select("c_custkey", "c_name"),
                         [F.lower("c_name"), "c_custkey"], 3))
add("page_count", "SELECT count(*) AS n_rows, greatest(CAST(ceil(count(*) / 10.0) AS BIGINT), 1) AS pages FROM part WHERE p_name ILIKE 'S%'")(
    lambda s, sf: L.page_count(L.names_by_prefix(fx.collections(s, sf), "S")))
add("metadata_of_name", f"WITH {COLLECTIONS_SQL} SELECT * FROM collections WHERE slug = 'red widget' ORDER BY id LIMIT 1")(
    lambda s, sf: L.metadata_of(fx.collections(s, sf), "red widget"))
add("known_handles", f"""WITH {COLLECTIONS_SQL} SELECT slug, chain, max(x_page) AS x_page FROM collections
 WHERE x_page IS NOT NULL AND x_page <> '' GROUP BY 1, 2""")(
    lambda s, sf: L.handles(fx.collections(s, sf)))
add("pairs_with_metadata", "SELECT DISTINCT p_name AS slug, p_brand AS chain FROM part")(
    lambda s, sf: L.pairs_with_metadata(fx.collections(s, sf)))

# --- dates and counts -----------------------------------------------------------------------

for _n in (7, 30, 90, 180, 365, 730, 1095):
    add(f"rows_last_{_n}_days", f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders
 WHERE o_orderdate >= DATE '{AS_OF}' - {_n}""")(
        lambda s, sf, n=_n: L.since(fx.table(s, sf, "orders"), AS_OF, n, "o_orderdate")
        .select("o_orderkey", F.to_date("o_orderdate").alias("date")))


def _lookback(s, sf):
    o = fx.table(s, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    newest = o.agg(F.max("date")).first()[0]
    return L.since(o, newest, 280).select("o_orderkey", "date")


add("rows_since_lookback", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders
 WHERE CAST(o_orderdate AS DATE) >= (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - 280""")(_lookback)

_ORDERS = "orders_d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)"


def _orders(s, sf):
    return fx.table(s, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))


add("max_date", "SELECT CAST(max(o_orderdate) AS DATE) AS max_date FROM orders")(
    lambda s, sf: _orders(s, sf).agg(F.max("date").alias("max_date")))
add("rows_on_latest_date", f"WITH {_ORDERS} SELECT * FROM orders_d WHERE date = (SELECT max(date) FROM orders_d)")(
    lambda s, sf: L.on_latest_date(_orders(s, sf)))
add("rows_per_day", f"WITH {_ORDERS} SELECT date, count(*) AS n FROM orders_d GROUP BY 1")(
    lambda s, sf: C.rows_per_day(_orders(s, sf)).orderBy(F.desc("date")))
add("full_days", f"WITH {_ORDERS} SELECT date, count(*) AS n FROM orders_d WHERE date >= DATE '1996-01-01' GROUP BY 1 HAVING count(*) > 6")(
    lambda s, sf: C.full_days(_orders(s, sf), 6, dt.date(1996, 1, 1)))
add("incomplete_days", f"""WITH {_ORDERS}, f AS (SELECT date FROM orders_d WHERE date >= DATE '1996-01-01' GROUP BY 1 HAVING count(*) > 6)
 SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(DATE '1996-01-01', (SELECT max(date) FROM f), INTERVAL 1 DAY)) AS d)
 WHERE CAST(d AS DATE) NOT IN (SELECT date FROM f)""")(
    lambda s, sf: C.incomplete_days(_orders(s, sf), 6, dt.date(1996, 1, 1)))
add("missing_days", f"""WITH {panel_sql('p_brand')}, sp AS (SELECT collection_identifier, chain, min(date) AS lo, max(date) AS hi FROM panel GROUP BY 1, 2),
 c AS (SELECT collection_identifier, chain, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM sp)
 SELECT collection_identifier, chain, date AS missing_date FROM c ANTI JOIN panel USING (collection_identifier, chain, date)""")(
    lambda s, sf: C.missing_days(fx.panel(s, sf), K.ENTITY))
add("daily_insert_count", f"WITH {_ORDERS} SELECT DATE '{ON}' AS date, count(*) AS n FROM orders_d WHERE date = DATE '{ON}'")(
    lambda s, sf: R.daily_insert_check(_orders(s, sf), ON))
add("daily_insert_names", f"WITH {RAW_SQL} SELECT DISTINCT slug FROM raw WHERE date = DATE '{ON}'")(
    lambda s, sf: L.names_inserted(fx.raw_prices(s, sf), ON))
add("table_coverage", f"""WITH {_ORDERS}, t AS (
 SELECT 'main' AS table_name, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM orders_d WHERE date >= DATE '1998-01-01'
 UNION ALL SELECT 'archive', count(*), min(date), max(date) FROM orders_d WHERE date < DATE '1998-01-01')
 SELECT *, round_even(n * 100.0 / (SELECT sum(n) FROM t), 1) AS pct FROM t""")(
    lambda s, sf: R.table_coverage(_orders(s, sf).filter("date >= DATE '1998-01-01'"),
                                   _orders(s, sf).filter("date < DATE '1998-01-01'")))
add("history_with_archive", f"WITH {_ORDERS} SELECT * FROM orders_d")(
    lambda s, sf: L.with_archive(_orders(s, sf).filter("date >= DATE '1998-01-01'"), _orders(s, sf).filter("date < DATE '1998-01-01'")))
add("distinct_pair_count", "SELECT count(*) AS pairs FROM (SELECT DISTINCT p_name, p_brand FROM part)")(
    lambda s, sf: L.pair_count(fx.collections(s, sf)))
add("volume_usd_30d", f"""WITH {panel_sql('p_brand')} SELECT collection_identifier, chain,
 {rs('sum(floor_usd / floor_native * sale_volume_native_24h)', 4)} AS volume_usd FROM panel WHERE date >= DATE '{AS_OF}' - 30 GROUP BY 1, 2""")(
    lambda s, sf: L.volume_usd(fx.panel(s, sf), AS_OF).withColumn("volume_usd", r("volume_usd", 4)))
add("first_currency_symbol", f"""WITH {panel_sql('p_brand')} SELECT collection_identifier, chain,
 first(chain_currency_symbol ORDER BY date) FILTER (chain_currency_symbol IS NOT NULL) AS symbol FROM panel GROUP BY 1, 2""")(
    lambda s, sf: L.first_symbol(fx.panel(s, sf)))
add("first_snapshot_of_day", """SELECT event_type, CAST(ts AS DATE) AS date, first(ts ORDER BY ts, event_id) AS ts,
 first(value ORDER BY ts, event_id) AS value FROM events GROUP BY 1, 2""")(
    lambda s, sf: K.first_of_day(fx.table(s, sf, "events").select("event_type", "ts", "value", "event_id"),
                                 ["event_type"], "ts", ["event_id"]).drop("event_id"))
add("symbols_missing", """SELECT * FROM (VALUES ('signup'), ('view'), ('refund')) v(symbol)
 WHERE symbol NOT IN (SELECT DISTINCT event_type FROM events)""")(
    lambda s, sf: L.symbols_missing(fx.table(s, sf, "events"), ["signup", "view", "refund"], "event_type"))
add("symbols_available", """SELECT DISTINCT event_type AS symbol FROM events WHERE event_type IN ('signup', 'view', 'refund')""")(
    lambda s, sf: L.symbols_available(fx.table(s, sf, "events"), ["signup", "view", "refund"], "event_type"))

# --- sentiment ------------------------------------------------------------------------------


def _sent(s, sf):
    return fx.entity_sentiment(s, sf)


add("sentiment_latest_rows", f"WITH {LATEST_SENT} SELECT * FROM latest")(lambda s, sf: L.on_latest_date(_sent(s, sf)))
add("sentiment_top10", f"WITH {LATEST_SENT} SELECT slug, sentiment_score FROM latest ORDER BY sentiment_score DESC, slug, chain LIMIT 10")(
    lambda s, sf: L.top_on_latest(_sent(s, sf), 10).select("slug", "sentiment_score"))
add("sentiment_ranking", f"""WITH {LATEST_SENT}
 (SELECT 'highest' AS side, slug, chain, sentiment_score FROM latest ORDER BY sentiment_score DESC, slug, chain LIMIT 5)
 UNION ALL (SELECT 'lowest', slug, chain, sentiment_score FROM latest ORDER BY sentiment_score, slug, chain LIMIT 5)""")(
    lambda s, sf: R.sentiment_ranking(_sent(s, sf)))
add("sentiment_screen", f"WITH {LATEST_SENT} SELECT slug, community_engagement, volume_activity FROM latest WHERE community_engagement >= 7 AND volume_activity < 5")(
    lambda s, sf: L.engagement_screen(_sent(s, sf))
    .select("slug", "community_engagement", "volume_activity"))
add("sentiment_card", f"""WITH {SENT}, l AS (SELECT * FROM sentiment QUALIFY row_number() OVER (PARTITION BY slug, chain ORDER BY date DESC) = 1)
 SELECT slug, chain, date, sentiment_score, sentiment_category, community_engagement, volume_activity,
  CASE sentiment_category WHEN 'EXTREMELY_BULLISH' THEN '🚀🚀' WHEN 'BULLISH' THEN '📈' WHEN 'NEUTRAL' THEN '➡️' WHEN 'BEARISH' THEN '📉' WHEN 'EXTREMELY_BEARISH' THEN '🔴🔴' ELSE '❓' END AS symbol,
  CASE WHEN community_engagement >= 7 THEN 'high' WHEN community_engagement <= 3 THEN 'low' ELSE '' END AS engagement_flag,
  CASE WHEN volume_activity >= 7 THEN 'high' WHEN volume_activity <= 3 THEN 'low' ELSE '' END AS activity_flag FROM l""")(
    lambda s, sf: R.sentiment_card(_sent(s, sf)))
add("sentiment_last3", f"""WITH {SENT} SELECT date, sentiment_score FROM sentiment WHERE slug = 'Brand#12' ORDER BY date DESC LIMIT 3""")(
    lambda s, sf: L.newest(_sent(s, sf).filter("slug = 'Brand#12'"), 3).select("date", "sentiment_score"))
add("sentiment_stats", f"""WITH {LATEST_SENT} SELECT count(DISTINCT collection_identifier) AS entities, {rs('avg(sentiment_score)')} AS avg_score,
 min(sentiment_score) AS min_score, max(sentiment_score) AS max_score, {rs('avg(community_engagement)')} AS avg_engagement,
 {rs('avg(volume_activity)')} AS avg_activity FROM latest""")(
    lambda s, sf: (lambda d: d.withColumns({c: r(c) for c in ("avg_score", "avg_engagement", "avg_activity")}))(
        R.snapshot_stats(_sent(s, sf))))
add("sentiment_category_shares", f"""WITH {LATEST_SENT} SELECT sentiment_category, count(*) AS n,
 {rs('count(*) * 100.0 / (SELECT count(DISTINCT collection_identifier) FROM latest)')} AS pct FROM latest GROUP BY 1""")(
    lambda s, sf: R.category_shares(_sent(s, sf)).withColumn("pct", r("pct")))
_SNAP = f"""{panel_sql('p_brand')}, {sentiment_sql()}, latest AS (SELECT * FROM sentiment WHERE date = (SELECT max(date) FROM sentiment)),
 ranks AS (SELECT slug, chain, ranking FROM panel QUALIFY row_number() OVER (PARTITION BY slug, chain ORDER BY date DESC) = 1)"""
add("sentiment_snapshot", f"""WITH {_SNAP} SELECT slug, chain, sentiment_score, sentiment_category, community_engagement, volume_activity, ranking
 FROM latest LEFT JOIN ranks USING (slug, chain)""")(
    lambda s, sf: R.sentiment_snapshot(_sent(s, sf), fx.panel(s, sf, ranked=True))
    .orderBy(F.asc_nulls_first("ranking"), F.desc("sentiment_score")))
add("sentiment_trend", f"""WITH {SENT}, k AS (SELECT * FROM sentiment QUALIFY row_number() OVER (PARTITION BY slug, chain ORDER BY date DESC) <= 4),
 t AS (SELECT slug, chain, count(*) AS n, arg_max(sentiment_score, date) - arg_min(sentiment_score, date) AS change FROM k GROUP BY 1, 2)
 SELECT *, CASE WHEN change > 0 THEN 'UP' WHEN change < 0 THEN 'DOWN' ELSE 'STABLE' END AS trend FROM t WHERE n > 1""")(
    lambda s, sf: L.trend(_sent(s, sf), 90))
_HEAT = "CASE WHEN hype_score >= 75 THEN 'hot' WHEN hype_score >= 50 THEN 'warm' WHEN hype_score IS NOT NULL THEN 'cold' END AS heat"
add("market_card", f"WITH {MARKET_SQL} SELECT date, hype_score, sentiment, trend, {_HEAT} FROM market ORDER BY date DESC LIMIT 1")(
    lambda s, sf: R.market_card(fx.market_daily(s, sf)))
add("market_history", f"WITH {MARKET_SQL} SELECT date, hype_score, sentiment, trend, {_HEAT} FROM market ORDER BY date DESC LIMIT 10")(
    lambda s, sf: R.market_card(fx.market_daily(s, sf), 10))

# --- refresh candidates ---------------------------------------------------------------------

_REFRESH = f"""{RAW_SQL}, {COLLECTIONS_SQL}, last AS (SELECT collection_identifier, chain, max(date) AS date FROM raw GROUP BY 1, 2),
 latest AS (SELECT raw.* FROM raw JOIN last USING (collection_identifier, chain, date)),
 best AS (SELECT * FROM latest WHERE ranking <= 20 QUALIFY row_number() OVER (PARTITION BY slug, chain ORDER BY ranking, collection_identifier) = 1),
 handle AS (SELECT slug, chain, max(x_page) AS x_page FROM collections WHERE x_page <> '' GROUP BY 1, 2),
 ranked AS (SELECT collection_identifier, slug, chain, ranking, x_page FROM best JOIN handle USING (slug, chain) ORDER BY ranking, slug, chain LIMIT 20),
 seen AS (SELECT slug, chain, max(date) AS last_analysis FROM raw WHERE date <= DATE '{AS_OF}' GROUP BY 1, 2),
 cand AS (SELECT ranked.*, last_analysis, last_analysis IS NULL OR last_analysis <= DATE '{AS_OF}' - 30 AS stale FROM ranked LEFT JOIN seen USING (slug, chain))"""


def _seen(s, sf):
    return fx.raw_prices(s, sf).filter(F.col("date") <= F.lit(AS_OF))


add("rows_at_latest_date", f"WITH {_REFRESH} SELECT collection_identifier, slug, chain, date, cents FROM latest")(
    lambda s, sf: L.rows_at_latest_date(fx.raw_prices(s, sf)).select("collection_identifier", "slug", "chain", "date", "cents"))
add("best_ranked_entities", f"WITH {_REFRESH} SELECT collection_identifier, slug, chain, ranking FROM best")(
    lambda s, sf: L.best_ranked(fx.raw_prices(s, sf), 20))
add("ranked_with_handle", f"WITH {_REFRESH} SELECT * FROM ranked")(
    lambda s, sf: L.ranked_with_handle(fx.raw_prices(s, sf), fx.collections(s, sf), 20))
add("refresh_candidates", f"""WITH {_REFRESH}, names AS (SELECT slug, chain, min(name) AS name FROM collections GROUP BY 1, 2)
 SELECT cand.*, coalesce(name, slug) AS display_name FROM cand LEFT JOIN names USING (slug, chain) WHERE stale""")(
    lambda s, sf: R.refresh_candidates(fx.raw_prices(s, sf), fx.collections(s, sf), _seen(s, sf), AS_OF, 20))
add("refresh_status_shares", f"WITH {_REFRESH} SELECT stale, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM cand), 1) AS pct FROM cand GROUP BY 1")(
    lambda s, sf: L.refresh_shares(L.with_last_analysis(
        L.ranked_with_handle(fx.raw_prices(s, sf), fx.collections(s, sf), 20), _seen(s, sf), AS_OF)))
add("display_names", f"""WITH {RAW_SQL}, {COLLECTIONS_SQL}, names AS (SELECT slug, chain, min(name) AS name FROM collections WHERE id % 2 = 0 GROUP BY 1, 2)
 SELECT p.slug, p.chain, coalesce(name, p.slug) AS display_name FROM (SELECT DISTINCT slug, chain FROM raw) p LEFT JOIN names USING (slug, chain)""")(
    lambda s, sf: L.display_names(fx.raw_prices(s, sf).select("slug", "chain").distinct(), fx.collections(s, sf).filter("id % 2 = 0")))

# --- averages and charts --------------------------------------------------------------------

_LOOSE = {20: 20, 50: 50, 100: 100, 200: 200}
_END = (AS_OF - dt.date(1970, 1, 1)).days


_AVG = f"""{PART_DAILY}, {COLLECTIONS_SQL}, last AS (SELECT collection_identifier, max(date) AS d FROM part_daily GROUP BY 1),
 ids AS (SELECT slug, collection_identifier FROM (SELECT DISTINCT slug, collection_identifier FROM collections) JOIN last USING (collection_identifier)
  QUALIFY row_number() OVER (PARTITION BY slug ORDER BY d DESC, collection_identifier DESC) = 1),
 obs AS (SELECT collection_identifier, day, floor_native AS v FROM part_daily WHERE floor_native IS NOT NULL),
 ends AS (SELECT DISTINCT collection_identifier, {_END} AS end_day FROM part_daily),
 {filled_day_by_day_sql('a', 'ends', 'obs', ['collection_identifier'], _LOOSE)},
 whole AS (SELECT collection_identifier, count(*) AS records, min(date) AS first_date,
  count(*) FILTER (day > {_END} - 200) AS days_present FROM part_daily WHERE date <= DATE '{AS_OF}' GROUP BY 1)"""
add("average_report", f"""WITH {_AVG} SELECT slug, collection_identifier, records, first_date, {', '.join(f'{rs(f"sma{p}")} AS sma{p}' for p in _LOOSE)},
 days_present, 200 - days_present AS days_missing FROM ids JOIN whole USING (collection_identifier)
 {' '.join(f'LEFT JOIN a{p} USING (collection_identifier)' for p in _LOOSE)}""")(
    lambda s, sf: (lambda d: d.withColumns({f"sma{p}": r(f"sma{p}") for p in _LOOSE}))(
        R.average_report(fx.collections(s, sf), fx.part_daily(s, sf), AS_OF, spans=_LOOSE)))
add("metadata_report", f"""WITH {PART_DAILY}, {COLLECTIONS_SQL}, l AS (SELECT * FROM part_daily QUALIFY row_number() OVER (PARTITION BY collection_identifier ORDER BY date DESC) = 1)
 SELECT c.slug, c.collection_identifier, c.name, c.chain, c.categories, l.date AS last_date, l.floor_native, l.floor_usd
 FROM collections c JOIN l USING (collection_identifier)
 QUALIFY row_number() OVER (PARTITION BY c.slug ORDER BY l.date DESC, c.collection_identifier DESC) = 1""")(
    lambda s, sf: R.metadata_report(fx.collections(s, sf), fx.part_daily(s, sf)))
add("freshest_ids", f"""WITH {RAW_SQL}, {COLLECTIONS_SQL}, last AS (SELECT collection_identifier, max(date) AS last_date FROM raw GROUP BY 1)
 SELECT slug, collection_identifier, last_date FROM collections LEFT JOIN last USING (collection_identifier)
 QUALIFY row_number() OVER (PARTITION BY slug ORDER BY last_date DESC NULLS LAST, collection_identifier DESC) = 1""")(
    lambda s, sf: R.freshest_ids(fx.collections(s, sf), fx.raw_prices(s, sf)))
add("last_value_means", f"""WITH {PART_DAILY}, n AS (SELECT collection_identifier, chain, day, floor_native FROM part_daily
  QUALIFY row_number() OVER (PARTITION BY collection_identifier, chain ORDER BY day DESC) <= 60),
 k AS (SELECT *, row_number() OVER (PARTITION BY collection_identifier, chain ORDER BY day DESC) AS k FROM n WHERE floor_native IS NOT NULL)
 SELECT collection_identifier, chain, {rs('avg(floor_native) FILTER (k <= 7)', 5)} AS ma7, {rs('avg(floor_native) FILTER (k <= 30)', 5)} AS ma30
 FROM n LEFT JOIN k USING (collection_identifier, chain, day, floor_native) GROUP BY 1, 2""")(
    lambda s, sf: (lambda d: d.withColumns({c: r(c, 5) for c in ("ma7", "ma30")}))(
        A.last_value_means(fx.part_daily(s, sf), K.ENTITY, "floor_native")))
_GRID = """pts AS (SELECT slug, chain, day, floor_native AS v, min(day) OVER p AS d0, max(day) OVER p AS d9, greatest(count(*) OVER p, 10) AS n
  FROM recent WINDOW p AS (PARTITION BY slug, chain)),
 g AS (SELECT slug, chain, d0, unnest(range(0, n)) AS k, CAST(d9 - d0 AS DOUBLE) AS span, n FROM (SELECT DISTINCT slug, chain, d0, d9, n FROM pts)),
 grid AS (SELECT slug, chain, k, d0 + k * span / (n - 1) AS at_day FROM g),
 lo AS (SELECT grid.slug, grid.chain, k, at_day, max(day) AS dl FROM grid JOIN pts ON pts.slug = grid.slug AND pts.chain = grid.chain AND day <= at_day + 1e-9 GROUP BY 1, 2, 3, 4),
 hi AS (SELECT grid.slug, grid.chain, k, min(day) AS dh FROM grid JOIN pts ON pts.slug = grid.slug AND pts.chain = grid.chain AND day >= at_day - 1e-9 GROUP BY 1, 2, 3)"""
add("chart_grid", f"""WITH {panel_sql('p_brand')}, recent AS (SELECT * FROM panel WHERE date >= DATE '{AS_OF}' - 90), {_GRID}
 SELECT lo.slug, lo.chain, lo.k, {rs('at_day')} AS at_day,
  {rs('(CASE WHEN dh = dl THEN a.v ELSE a.v + (b.v - a.v) * (at_day - dl) / (dh - dl) END)', 5)} AS floor_native
 FROM lo JOIN hi USING (slug, chain, k) JOIN pts a ON a.slug = lo.slug AND a.chain = lo.chain AND a.day = dl
 JOIN pts b ON b.slug = lo.slug AND b.chain = lo.chain AND b.day = dh""")(
    lambda s, sf: AS.even_grid(L.since(fx.panel(s, sf), AS_OF, 90).select("slug", "chain", "day", "floor_native"),
                               ["slug", "chain"], "floor_native")
    .select("slug", "chain", "k", r("at_day").alias("at_day"), r("floor_native", 5).alias("floor_native")))


def _chart_sql(key, days, spans):
    """The grid of ``chart_grid`` with averages that end on the day of each point."""
    return f"""WITH {panel_sql(key)}, recent AS (SELECT * FROM panel WHERE date >= DATE '{AS_OF}' - {days}), {_GRID},
 points AS (SELECT lo.slug, lo.chain, lo.k, at_day, CAST(floor(at_day + 1e-9) AS BIGINT) AS end_day,
  CASE WHEN dh = dl THEN a.v ELSE a.v + (b.v - a.v) * (at_day - dl) / (dh - dl) END AS price
  FROM lo JOIN hi USING (slug, chain, k) JOIN pts a ON a.slug = lo.slug AND a.chain = lo.chain AND a.day = dl
  JOIN pts b ON b.slug = lo.slug AND b.chain = lo.chain AND b.day = dh),
 ends AS (SELECT DISTINCT slug, chain, end_day FROM points), obs AS (SELECT slug, chain, day, floor_native AS v FROM recent),
 {filled_day_by_day_sql('m', 'ends', 'obs', ['slug', 'chain'], spans)}
 SELECT slug, chain, k, {rs('at_day')} AS at_day, {rs('price', 4)} AS floor_native, {', '.join(f'{rs(f"sma{p}", 4)} AS sma{p}' for p in spans)}
 FROM points {' '.join(f'LEFT JOIN m{p} USING (slug, chain, end_day)' for p in spans)}"""


def _chart(s, sf, key, days, allowed):
    d = R.chart_data(fx.panel(s, sf, key), ["slug", "chain"], AS_OF, days, allowed=allowed)
    smas = [c for c in d.columns if c.startswith("sma")]
    return d.select("slug", "chain", "k", r("at_day").alias("at_day"), *[r(c, 4).alias(c) for c in ("floor_native", *smas)])


add("chart_data", _chart_sql("p_type", 365, codes.SMA_SPANS))(lambda s, sf: _chart(s, sf, "p_type", 365, codes.SMA_SPANS))
add("chart_averages", _chart_sql("p_brand", 100, {p: _LOOSE[p] for p in (20, 50)}))(lambda s, sf: _chart(s, sf, "p_brand", 100, _LOOSE))


# --- crossovers -----------------------------------------------------------------------------

_SPANS = {20: 20, 50: 50, 100: 100, 200: 200}


def _sma_query(s, sf):
    p = K.spread(fx.panel(s, sf).select("slug", "chain", "day", "floor_native"), ["slug", "chain"])
    p = A.gap_filled_sma(p, ["slug", "chain"], "floor_native", _SPANS)
    return p.select("slug", "chain", "day", *[r(f"sma{x}").alias(f"sma{x}") for x in _SPANS])


def _sma_brute_sql():
    """The running fill itself, day by day: every missing day takes the midpoint of the day before
    and the next observed value. Computed once per series, then averaged per frame with its edges."""
    from seriesloom.catalog.base import sma_sql
    return sma_sql("base", "slug, chain", "floor_native", _SPANS)


add("sma_gap_filled", f"""WITH {panel_sql('p_brand')}, base AS (SELECT slug, chain, day, floor_native FROM panel), {_sma_brute_sql()}
 SELECT slug, chain, day, {', '.join(f'{rs(f"sma{x}")} AS sma{x}' for x in _SPANS)} FROM base_sma""")(_sma_query)
add("days_present", f"""WITH {panel_sql('p_brand')} SELECT slug, chain, day,
 {', '.join(f"count(*) OVER (PARTITION BY slug, chain ORDER BY day RANGE BETWEEN {p - 1} PRECEDING AND CURRENT ROW) AS present_{p}, {p} - count(*) OVER (PARTITION BY slug, chain ORDER BY day RANGE BETWEEN {p - 1} PRECEDING AND CURRENT ROW) AS missing_{p}" for p in (20, 200))} FROM panel""")(
    lambda s, sf: A.days_present(fx.panel(s, sf).select("slug", "chain", "day"), ["slug", "chain"], [20, 200]))

_CX = crosses_sql("p_brand", 20, 50, 20, 50)
_FLAGS = f"""{_CX}, stored AS (SELECT * EXCLUDE (is_last), day(date) % 2 = 0 AS telegram_sent, length(slug) % 2 = 0 AS x_sent FROM crossed)"""
_CKEY = ["slug", "chain", "date", "is_native", "ma_short_period", "ma_long_period"]
_CK = ", ".join(_CKEY)


def _stored(s, sf):
    return fx.stored_crosses(fx.panel(s, sf, ranked=True))


add("cross_current", f"""WITH {crosses_sql('p_brand', 5, 20, 5, 20)} SELECT slug, chain, date, is_native, {rs('ma_short')} AS ma_short, {rs('ma_long')} AS ma_long
 FROM crossed WHERE is_last""")(
    lambda s, sf: X.detect_current_crosses(fx.panel(s, sf), 5, 20, 5, 20)
    .select("slug", "chain", "date", "is_native", r("ma_short").alias("ma_short"), r("ma_long").alias("ma_long")))
add("cross_from_date", f"WITH {_CX} SELECT {_CK} FROM crossed WHERE date >= DATE '2000-01-01'")(
    lambda s, sf: X.detect_crosses(fx.panel(s, sf), 20, 50, 20, 50, start_date=dt.date(2000, 1, 1)).select(*_CKEY))


def _brand_pairs(s, sf):
    return fx.panel(s, sf).filter("chain <> 'tezos'").select("slug", "chain").distinct()


add("cross_for_known_pairs", f"WITH {_CX} SELECT {_CK} FROM crossed WHERE chain <> 'tezos'")(
    lambda s, sf: X.detect_crosses(fx.panel(s, sf), 20, 50, 20, 50, pairs=_brand_pairs(s, sf)).select(*_CKEY))
add("price_series_by_column", f"WITH {series_sql('p_brand')} SELECT slug, chain, date, is_native, price FROM series WHERE price IS NOT NULL")(
    lambda s, sf: X.price_series(fx.panel(s, sf)).select("slug", "chain", "date", "is_native", "price"))
add("cross_price_lookup", f"""WITH {_CX}, shifted AS (SELECT slug, chain, CAST(date + 1 AS DATE) AS date, is_native FROM crossed)
 SELECT s.*, p.floor_native, p.floor_usd, p.ranking FROM shifted s LEFT JOIN panel p ON p.slug = s.slug AND p.chain = s.chain AND p.date = s.date""")(
    lambda s, sf: X.price_lookup(_stored(s, sf).select("slug", "chain", F.date_add("date", 1).alias("date"), "is_native"),
                                 fx.panel(s, sf, ranked=True)))
add("crosses_between", f"WITH {_CX} SELECT {_CK} FROM crossed WHERE is_native AND date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND ma_short_period = 20 AND ma_long_period = 50")(
    lambda s, sf: X.between_dates(_stored(s, sf), dt.date(1998, 1, 1), dt.date(1999, 12, 31), 20, 50)
    .orderBy(F.desc("date")).select(*_CKEY))
PEND = dt.date(1997, 4, 3)
add("crosses_pending", f"WITH {_FLAGS} SELECT {_CK} FROM stored WHERE is_native AND date = DATE '{PEND}' AND (NOT telegram_sent OR NOT x_sent)")(
    lambda s, sf: X.pending(_stored(s, sf), PEND).select(*_CKEY))

_META = """meta AS (SELECT p_brand AS slug, 'The ' || p_brand || ' - Co' AS name, CASE WHEN max(p_partkey) % 2 = 0 THEN '@' || p_brand END AS x_page FROM part GROUP BY 1)"""
_F4 = "CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('%.{n}f', {c}) END"


def _fx(c, n):
    return _F4.format(c=c, n=n)


_ALERTS = f"""{_FLAGS}, {_META}, unsent AS (SELECT * FROM stored WHERE is_native AND NOT x_sent),
 quota AS (SELECT DISTINCT date, slug, chain FROM unsent ORDER BY date, slug, chain LIMIT 5),
 alerts AS (SELECT s.*, p.chain_currency_symbol AS sym, p.unique_owners, p.total_supply, p.listed_count, p.contract_address, p.best_price_url, name, x_page,
  q.slug IS NOT NULL AND NOT s.x_sent AS post_now, NOT telegram_sent AS send_now
  FROM stored s JOIN panel p ON p.slug = s.slug AND p.chain = s.chain AND p.date = s.date LEFT JOIN meta m ON m.slug = s.slug
  LEFT JOIN quota q ON q.slug = s.slug AND q.chain = s.chain AND q.date = s.date WHERE is_native)"""
_TEXT = f"""slug || ' on ' || chain || ' ' || CAST(date AS VARCHAR) || ' | rank ' || coalesce(CAST(ranking AS VARCHAR), 'N/A') || ' | floor ' || {_fx('floor_native', 4)} || ' ' || coalesce(sym, '')
 || ' / $' || {_fx('floor_usd', 2)} || ' | MA20 ' || {_fx('ma_short', 4)} || ' > MA50 ' || {_fx('ma_long', 4)} || ' ' || coalesce(sym, '')
 || ' | owners ' || unique_owners || ', supply ' || total_supply || ', listed ' || listed_count
 || ' | contract ' || coalesce(contract_address, 'N/A') || ' | best price ' || coalesce(best_price_url, '')"""
_POST = f"""name || ' by ' || coalesce(x_page, slug) || ' on #' || chain || ': MA20 (' || {_fx('ma_short', 4)} || ' ' || coalesce(sym, '') || ') > MA50 (' || {_fx('ma_long', 4)} || ' ' || coalesce(sym, '')
 || '), floor ' || {_fx('floor_native', 4)} || ' ' || coalesce(sym, '') || ' (~$' || {_fx('floor_usd', 2)} || '), ' || total_supply || ' supply, ' || unique_owners
 || ' owners, ' || listed_count || ' listed #' || replace(replace(name, ' ', ''), '-', '') || coalesce(' ' || best_price_url, '')"""
add("alert_feed", f"""WITH {_ALERTS} SELECT slug, chain, date, send_now, post_now, NOT x_sent AND NOT post_now AS carried_over, {_TEXT} AS alert_text, {_POST} AS post_text FROM alerts""")(
    lambda s, sf: (lambda d: d.select("slug", "chain", "date", "send_now", "post_now", "carried_over",
                                      R.S.alert_text().alias("alert_text"), R.S.post_text().alias("post_text")))(
        X.with_post_quota(X.enrich_alerts(stored(_stored(s, sf), "crosses").filter("is_native"), fx.panel(s, sf), fx.brand_metadata(s, sf)))))
add("pending_alerts", f"""WITH {_FLAGS}, pend AS (SELECT * FROM stored WHERE is_native AND date = DATE '{PEND}' AND (NOT telegram_sent OR NOT x_sent)),
 q AS (SELECT slug FROM pend WHERE NOT x_sent ORDER BY date, slug LIMIT 2)
 SELECT slug, chain, date, NOT telegram_sent AS send_now, NOT x_sent AND slug IN (SELECT slug FROM q) AS post_now,
  NOT x_sent AND slug NOT IN (SELECT slug FROM q) AS carried_over FROM pend""")(
    lambda s, sf: R.pending_alerts(stored(_stored(s, sf), "crosses"), fx.panel(s, sf), fx.brand_metadata(s, sf), PEND, 2)
    .select("slug", "chain", "date", "send_now", "post_now", "carried_over"))
add("cross_recap", f"""WITH {_CX}, now AS (SELECT slug, chain, floor_native AS cn FROM panel QUALIFY row_number() OVER (PARTITION BY slug, chain ORDER BY date DESC) = 1)
 SELECT c.slug, c.chain, c.date, c.floor_native, cn AS current_floor_native, {rs('(cn - c.floor_native) / c.floor_native * 100')} AS profit_pct,
  coalesce(p.chain_currency_symbol, '') AS currency, strftime(c.date, '%d-%m-%Y') AS cross_day
 FROM crossed c JOIN now USING (slug, chain) JOIN panel p ON p.slug = c.slug AND p.chain = c.chain AND p.date = c.date
 WHERE is_native AND c.date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}'""")(
    lambda s, sf: R.cross_recap(_stored(s, sf), fx.panel(s, sf), AS_OF).select(
        "slug", "chain", "date", "floor_native", "current_floor_native", r("profit_pct").alias("profit_pct"), "currency", "cross_day"))
add("mark_delivered", f"""WITH {_FLAGS} SELECT {_CK}, telegram_sent, x_sent OR date < DATE '1998-01-01' AS x_sent FROM stored""")(
    lambda s, sf: (lambda c: X.mark_delivered(c, c.filter("date < DATE '1998-01-01'"), "x_sent")
                   .select(*_CKEY, "telegram_sent", "x_sent"))(_stored(s, sf)))
add("cross_run_summary", f"WITH {_CX} SELECT ma_short_period, ma_long_period, count(*) AS found, count(*) FILTER (date >= DATE '1998-01-01') AS saved FROM crossed GROUP BY 1, 2")(
    lambda s, sf: (lambda c: R.cross_summary(c, c.filter("date < DATE '1998-01-01'")))(_stored(s, sf)))
add("cross_insert_new", f"WITH {_CX} SELECT {_CK} FROM crossed WHERE date >= DATE '1998-01-01'")(
    lambda s, sf: (lambda c: __import__("seriesloom.sinks.keyed_tables", fromlist=["new_rows"]).new_rows(
        c.filter("date < DATE '1998-01-01'"), c, X.CROSS_KEY).select(*_CKEY))(_stored(s, sf)))

# --- as-of ----------------------------------------------------------------------------------


def _asof(s, sf):
    e = fx.table(s, sf, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"), F.col("event_id").alias("view_id"))
    return AS.asof_join(left, right, ["user_id"], "ts", ["view_value", "view_id"], "view_id")


add("asof_join", """WITH v AS (SELECT user_id, ts, value AS view_value, event_id AS view_id FROM events WHERE event_type = 'view')
 SELECT p.user_id, p.event_id, p.ts, v.ts AS asof_ts, v.view_value, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
 ASOF LEFT JOIN v ON v.user_id = p.user_id AND p.ts >= v.ts""")(_asof)
_UNTIL = dt.date(2000, 1, 1)
add("latest_signal_until", f"""WITH {panel_sql('p_brand')}, {sentiment_sql()}, lx AS (
 SELECT collection_identifier, chain, arg_max(sentiment_score, date) AS sentiment_score FROM sentiment WHERE date <= DATE '{_UNTIL}' GROUP BY 1, 2)
 SELECT p.collection_identifier, p.chain, p.date, lx.sentiment_score FROM panel p LEFT JOIN lx USING (collection_identifier, chain)""")(
    lambda s, sf: AS.latest_until(fx.panel(s, sf).select(*K.ENTITY, "date"), _sent(s, sf), K.ENTITY, ["sentiment_score"], F.lit(_UNTIL)))
