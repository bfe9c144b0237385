"""Series operators and the feature panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom import fixtures as fx
from seriesloom.catalog import query
from seriesloom.catalog.base import (INDEX_SQL, MARKET_SQL, RAW_SQL, SYMBOL_SQL, nearest, panel_sql, r, rs,
                                     sales_sql, sentiment_sql)
from seriesloom.functions import codes
from seriesloom.operators import calendar as C
from seriesloom.operators import features as FE
from seriesloom.operators import keyed as K
from seriesloom.operators import moves as M
from seriesloom.operators.joins import calendar_rows, left_join_bounded
from seriesloom.session import stored

KEY = "l_suppkey"
MIN_DAYS = 60
EXACT = {"slug", "collection_identifier", "chain", "date", "day", "floor_native", "floor_usd"}


def rounded(df, columns, places=6):
    return df.select(*[F.col(c) if c in EXACT else nearest(c, places).alias(c) for c in columns])


def rounded_sql(columns, src, places=6, where="TRUE"):
    cols = ", ".join(c if c in EXACT else f"{rs(c, places)} AS {c}" for c in columns)
    return f"SELECT {cols} FROM {src} WHERE {where}"


PART = "PARTITION BY collection_identifier, chain ORDER BY day"


def _over(n):
    return f"OVER ({PART} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def _last(c, n):
    return f"last_value({c} IGNORE NULLS) {_over(n)}"


def _roll(fn, c, n, least):
    return f"CASE WHEN count({c}) {_over(n - 1)} >= {least} THEN {fn}({c}) {_over(n - 1)} END"


def entity_features_sql(key=KEY, min_days=MIN_DAYS, panel="panel", ctes=None):
    """CTEs up to ``feats``: the dense calendar written out and joined, then row windows."""
    head = ctes or f"{panel_sql(key)}, {sentiment_sql()}"
    return f"""{head}, spans AS (
 SELECT collection_identifier, chain, min(day) AS lo, max(day) AS hi FROM {panel} GROUP BY 1, 2 HAVING count(*) >= {min_days}),
cal AS (SELECT collection_identifier, chain, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS day FROM spans),
dense AS (
 SELECT cal.collection_identifier, cal.chain, cal.day, DATE '1970-01-01' + cal.day AS date,
  p.* EXCLUDE (collection_identifier, chain, day, date)
 FROM cal LEFT JOIN {panel} p ON p.collection_identifier = cal.collection_identifier AND p.chain = cal.chain AND p.day = cal.day),
fill1 AS (
 SELECT * REPLACE ({_last('floor_native', 7)} AS floor_native, {_last('floor_usd', 7)} AS floor_usd,
   last_value(slug IGNORE NULLS) OVER ({PART} ROWS UNBOUNDED PRECEDING) AS slug,
   coalesce(sale_count_24h, 0) AS sale_count_24h, coalesce(sale_volume_native_24h, 0) AS sale_volume_native_24h)
 FROM dense),
kept AS (SELECT * FROM fill1 WHERE floor_native IS NOT NULL),
sent AS (
 SELECT kept.*, s.sentiment_score, s.community_engagement, s.volume_activity
 FROM kept LEFT JOIN sentiment s ON s.collection_identifier = kept.collection_identifier AND s.chain = kept.chain
   AND s.date = kept.date),
row1 AS (
 SELECT *, floor_native / lag(floor_native, 3) OVER w - 1 AS ret_3d, floor_native / lag(floor_native, 7) OVER w - 1 AS ret_7d,
  floor_native / lag(floor_native, 14) OVER w - 1 AS ret_14d, floor_native / lag(floor_native, 30) OVER w - 1 AS ret_30d,
  ln(floor_native / lag(floor_native) OVER w) AS lr,
  {', '.join(f"{_roll('avg', 'floor_native', n, n // 2)} AS ma{n}" for n in (20, 50, 200))},
  {_last('listed_count', 7)} AS listed, {_last('total_supply', 30)} AS supply, {_last('unique_owners', 30)} AS owners,
  {_last('ranking', 7)} AS rank7, {_roll('avg', 'sale_count_24h', 7, 1)} AS sale_count_ma7,
  {_roll('avg', 'sale_volume_native_24h', 7, 1)} AS sale_vol_ma7, {_roll('avg', 'sale_count_24h', 30, 3)} AS count30,
  {_last('sentiment_score', 45)} AS xsent_score, {_last('community_engagement', 45)} AS xsent_engagement,
  {_last('volume_activity', 45)} AS xsent_volume
 FROM sent WINDOW w AS ({PART})),
feats AS (
 SELECT collection_identifier, chain, slug, date, day, floor_native, floor_usd, ret_3d, ret_7d, ret_14d, ret_30d,
  {', '.join(f"{_roll('stddev_samp', 'lr', n, max(3, n // 3))} AS vol_{n}d" for n in (7, 14, 30))},
  floor_native / ma20 AS floor_vs_ma20, floor_native / ma50 AS floor_vs_ma50, floor_native / ma200 AS floor_vs_ma200,
  (ma20 - ma50) / ma50 AS spread_20_50, (ma50 - ma200) / ma200 AS spread_50_200,
  ma20 / lag(ma20, 5) OVER w - 1 AS ma20_slope, ma50 / lag(ma50, 5) OVER w - 1 AS ma50_slope,
  CAST(listed AS DOUBLE) / nullif(supply, 0) AS listing_ratio, CAST(owners AS DOUBLE) / nullif(supply, 0) AS owner_ratio,
  sale_count_ma7, sale_vol_ma7, sale_count_ma7 / nullif(count30, 0) AS sale_count_momentum,
  (CASE WHEN highest_sale_native_24h > 0 THEN highest_sale_native_24h END
   - CASE WHEN lowest_sale_native_24h > 0 THEN lowest_sale_native_24h END) / floor_native AS intraday_range,
  CAST(rank7 AS DOUBLE) AS ranking, CAST(xsent_score AS DOUBLE) AS xsent_score,
  CAST(xsent_engagement AS DOUBLE) AS xsent_engagement, CAST(xsent_volume AS DOUBLE) AS xsent_volume,
  CAST(CASE lower(chain) WHEN 'ethereum' THEN 0 WHEN 'solana' THEN 1 WHEN 'polygon' THEN 2 WHEN 'base' THEN 3
   WHEN 'avalanche' THEN 4 WHEN 'arbitrum' THEN 5 WHEN 'optimism' THEN 6 WHEN 'bnb' THEN 7 WHEN 'blast' THEN 8
   ELSE 99 END AS DOUBLE) AS chain_enc
 FROM row1 WINDOW w AS ({PART}))"""


def _carried(src, columns, reach=7):
    cols = ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN {reach} PRECEDING AND CURRENT ROW) AS {c}"
                     for c in columns)
    return f"""(SELECT CAST(d AS DATE) AS date, {cols}
 FROM (SELECT unnest(generate_series(min(date), max(date) + INTERVAL {reach} DAY, INTERVAL 1 DAY)) AS d FROM {src}) c
 LEFT JOIN {src} m ON m.date = c.d)"""


MOOD_SQL = f"""{MARKET_SQL}, mood0 AS (
 SELECT date, CAST(hype_score AS DOUBLE) AS hype_score,
  CASE sentiment WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END AS hype_sentiment,
  CASE trend WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 ELSE 0 END AS hype_trend FROM market),
mood AS {_carried('mood0', ['hype_score', 'hype_sentiment', 'hype_trend'])}"""

FEAR_SQL = f"""{INDEX_SQL}, fear0 AS (
 SELECT CAST(date AS DATE) AS date, first(value ORDER BY index_snapshots.date, o_orderkey) AS v
 FROM index_snapshots GROUP BY 1), fear1 AS (
 SELECT date, v AS fear_greed_value, v - lag(v, 7) OVER (ORDER BY date) AS fear_greed_change_7d FROM fear0),
fear AS {_carried('fear1', ['fear_greed_value', 'fear_greed_change_7d'])}"""

SYMBOL_FEATURES_SQL = f"""{SYMBOL_SQL}, scal AS (
 SELECT crypto_symbol, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM symbols GROUP BY 1),
sfill AS (
 SELECT c.crypto_symbol, CAST(d AS DATE) AS date, last_value(current_price IGNORE NULLS) OVER w AS p,
  last_value(ath_change_percentage IGNORE NULLS) OVER w AS ath_pct,
  last_value(total_volume / nullif(market_cap, 0) IGNORE NULLS) OVER w AS volume_rel
 FROM scal c LEFT JOIN symbols s ON s.crypto_symbol = c.crypto_symbol AND s.date = c.d
 WINDOW w AS (PARTITION BY c.crypto_symbol ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
sret AS (
 SELECT *, p / lag(p) OVER w - 1 AS ret_1d, p / lag(p, 7) OVER w - 1 AS ret_7d, p / lag(p, 30) OVER w - 1 AS ret_30d,
  ln(p / lag(p) OVER w) AS lr FROM sfill WINDOW w AS (PARTITION BY crypto_symbol ORDER BY date)),
symfeats AS (
 SELECT crypto_symbol, date, ret_1d, ret_7d, ret_30d,
  CASE WHEN count(lr) OVER w >= 3 THEN stddev_samp(lr) OVER w END AS vol_7d, ath_pct, volume_rel
 FROM sret WINDOW w AS (PARTITION BY crypto_symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""

_MARKET_COLUMNS = """hype_score, CAST(hype_sentiment AS DOUBLE) AS hype_sentiment, CAST(hype_trend AS DOUBLE) AS hype_trend,
  fear_greed_value, fear_greed_change_7d, n.ret_1d AS native_ret_1d, n.ret_7d AS native_ret_7d,
  n.ret_30d AS native_ret_30d, n.vol_7d AS native_vol_7d, n.ath_pct AS native_ath_pct,
  n.volume_rel AS native_volume_rel, b.ret_7d AS btc_ret_7d, b.vol_7d AS btc_vol_7d, b.ath_pct AS btc_ath_pct"""


def with_market_sql(src="feats", name="full_panel"):
    return f"""{name} AS (
 SELECT f.*, {_MARKET_COLUMNS}
 FROM {src} f LEFT JOIN mood ON mood.date = f.date LEFT JOIN fear ON fear.date = f.date
 LEFT JOIN symfeats n ON n.date = f.date AND n.crypto_symbol = CASE lower(f.chain) WHEN 'ethereum' THEN 'ETH'
   WHEN 'base' THEN 'ETH' WHEN 'polygon' THEN 'MATIC' WHEN 'solana' THEN 'SOL' WHEN 'arbitrum' THEN 'ARB'
   WHEN 'optimism' THEN 'OP' WHEN 'bnb' THEN 'BNB' WHEN 'blast' THEN 'BLAST' END
 LEFT JOIN symfeats b ON b.date = f.date AND b.crypto_symbol = 'BTC')"""


ID = ["collection_identifier", "chain", "slug", "date"]
PANEL_COLUMNS = [*ID, "floor_native", "floor_usd", *codes.FEATURES]


def features(spark, sf, key=KEY):
    return FE.entity_features(fx.panel(spark, sf, key, ranked=True), fx.entity_sentiment(spark, sf, key), MIN_DAYS)


def full_panel(spark, sf, key=KEY, prices=None, **kw):
    # All market series come from order dates, and the newest price from ship dates: two one-column scans.
    kw["signal_days"] = calendar_rows(fx.table(spark, sf, "orders"), "o_orderdate") + 1
    if kw.get("lookback_days"):
        kw["newest"] = fx.table(spark, sf, "lineitem").agg(F.to_date(F.max("l_shipdate"))).first()[0]
    # The price rows are stored first: choosing canonical ids, the newest day and the panel each read them.
    prices = prices or stored(fx.panel(spark, sf, key, ranked=True), "prices")
    return FE.feature_panel(prices, fx.market_daily(spark, sf),
                            fx.entity_sentiment(spark, sf, key), fx.index_snapshots(spark, sf),
                            fx.symbol_daily(spark, sf), index_tie=["o_orderkey"], **kw)


def full_panel_sql(key=KEY, min_days=MIN_DAYS):
    return (f"{entity_features_sql(key, min_days)}, {MOOD_SQL}, {FEAR_SQL}, {SYMBOL_FEATURES_SQL}, "
            f"{with_market_sql()}")


@query("feature_panel", f"WITH {full_panel_sql()} {rounded_sql(PANEL_COLUMNS, 'full_panel')}")
def feature_panel(spark, sf):
    return rounded(K.apart(full_panel(spark, sf, min_days=MIN_DAYS)), PANEL_COLUMNS)


# Predict mode: bounded look-back, at least 20 rows, last row per entity, one shared sentiment cut-off.
_PREDICT_HEAD = f"""{panel_sql(KEY)}, {sentiment_sql()}, recent AS (
 SELECT * FROM panel WHERE date >= (SELECT max(date) FROM panel) - 280)"""
_PREDICT_SQL = f"""{entity_features_sql(KEY, 20, "recent", _PREDICT_HEAD)}, newest AS (
 SELECT * EXCLUDE (xsent_score, xsent_engagement, xsent_volume) FROM feats
 QUALIFY row_number() OVER (PARTITION BY collection_identifier, chain ORDER BY day DESC) = 1), cutoff AS (
 SELECT max(date) AS d FROM newest), lastx AS (
 SELECT collection_identifier, chain, CAST(arg_max(sentiment_score, date) AS DOUBLE) AS xsent_score,
  CAST(arg_max(community_engagement, date) AS DOUBLE) AS xsent_engagement,
  CAST(arg_max(volume_activity, date) AS DOUBLE) AS xsent_volume
 FROM sentiment WHERE date <= (SELECT d FROM cutoff) GROUP BY 1, 2), newest_x AS (
 SELECT newest.*, xsent_score, xsent_engagement, xsent_volume FROM newest LEFT JOIN lastx USING (collection_identifier, chain)),
 {MOOD_SQL}, {FEAR_SQL}, {SYMBOL_FEATURES_SQL}, {with_market_sql('newest_x')}"""


@query("feature_panel_predict", f"WITH {_PREDICT_SQL} {rounded_sql(PANEL_COLUMNS, 'full_panel')}")
def feature_panel_predict(spark, sf):
    return rounded(K.apart(full_panel(spark, sf, min_days=20, lookback_days=280)), PANEL_COLUMNS)


def _part(name, columns):
    sql = f"WITH {entity_features_sql()} {rounded_sql([*ID, *columns], 'feats')}"
    query(name, sql)(lambda spark, sf: rounded(features(spark, sf), [*ID, *columns]))


_part("price_returns", ["ret_3d", "ret_7d", "ret_14d", "ret_30d"])
_part("price_volatility", ["vol_7d", "vol_14d", "vol_30d"])
_part("ma_ratios", ["floor_vs_ma20", "floor_vs_ma50", "floor_vs_ma200"])
_part("ma_spreads_slopes", ["spread_20_50", "spread_50_200", "ma20_slope", "ma50_slope"])
_part("listing_pressure", ["listing_ratio", "owner_ratio"])
_part("sales_activity", ["sale_count_ma7", "sale_vol_ma7", "sale_count_momentum"])
_part("intraday_range", ["intraday_range"])
_part("carried_rank_and_name", ["ranking", "chain_enc"])
_part("entity_sentiment_fill45", ["xsent_score", "xsent_engagement", "xsent_volume"])
_part("priced_days_only", ["floor_native", "floor_usd"])


# --- single steps ---------------------------------------------------------------------------

ENT = K.ENTITY
_CAL = f"""{panel_sql(KEY)}, spans AS (
 SELECT collection_identifier, chain, min(day) AS lo, max(day) AS hi FROM panel GROUP BY 1, 2), cal AS (
 SELECT collection_identifier, chain, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS day FROM spans), dense AS (
 SELECT cal.*, floor_native, p.day IS NOT NULL AS observed FROM cal LEFT JOIN panel p
  USING (collection_identifier, chain, day))"""


def _slim(spark, sf):
    return fx.panel(spark, sf, KEY).select(*ENT, "date", "day", "floor_native")


@query("calendar_dense", f"WITH {_CAL} SELECT * FROM dense")
def calendar_dense(spark, sf):
    return C.fill_days(_slim(spark, sf), ENT).select(*ENT, "day", "floor_native", "observed")


_FILLS = (3, 7, 30, 45)


@query("fill_bounded", f"WITH {_CAL} SELECT collection_identifier, chain, day, "
       + ", ".join(f"{_last('floor_native', n)} AS fill_{n}" for n in _FILLS) + " FROM dense")
def fill_bounded(spark, sf):
    # On a dense calendar a limit in rows is one in days; the last known price is found on the observed rows.
    w = K.series_window(ENT)
    rows = K.spread(_slim(spark, sf), ENT).withColumn("_seen", M.last_seen("floor_native", w, "day"))
    d = C.fill_days(rows, ENT, carried=["_seen"])
    return d.select(*ENT, "day", *[M.within(F.col("_seen"), n).alias(f"fill_{n}") for n in _FILLS])


@query("log_returns", f"""WITH {panel_sql(KEY)} SELECT collection_identifier, chain, day,
 {rs('ln(floor_native / lag(floor_native) OVER (' + PART + '))')} AS log_ret FROM panel""")
def log_returns(spark, sf):
    return _slim(spark, sf).select(*ENT, "day", r(M.log_change("floor_native", K.series_window(ENT))).alias("log_ret"))


@query("rolling_stats", f"""WITH {panel_sql(KEY)} SELECT collection_identifier, chain, day,
 {rs(_roll('stddev_samp', 'floor_native', 14, 4))} AS std_14, {rs(_roll('avg', 'floor_native', 20, 10))} AS mean_20 FROM panel""")
def rolling_stats(spark, sf):
    w = K.series_window(ENT)
    return _slim(spark, sf).select(*ENT, "day", r(M.rolling_std("floor_native", w, 14, 4)).alias("std_14"),
                                   r(M.rolling_mean("floor_native", w, 20, 10)).alias("mean_20"))


@query("latest_row", f"""WITH {panel_sql('p_brand')} SELECT collection_identifier, chain, date, floor_native, listed_count
 FROM panel QUALIFY row_number() OVER (PARTITION BY collection_identifier, chain ORDER BY date DESC) = 1""")
def latest_row(spark, sf):
    p = fx.panel(spark, sf, "p_brand").select(*ENT, "date", "floor_native", "listed_count")
    return K.latest_row(p, ENT)


@query("dedupe_days", f"""WITH {RAW_SQL} SELECT collection_identifier, chain, date, count(*) AS n,
 {', '.join(f"first({c} ORDER BY floor_native DESC NULLS LAST, {c} DESC NULLS LAST) FILTER ({c} IS NOT NULL) AS {c}"
            for c in ('slug', 'floor_native', 'floor_usd', 'listed_count', 'ranking'))}
 FROM raw GROUP BY 1, 2, 3""")
def dedupe_days(spark, sf):
    return K.dedupe_days(fx.raw_prices(spark, sf), ENT,
                         columns=["slug", "floor_native", "floor_usd", "listed_count", "ranking"], count_as="n")


@query("latest_known_until", f"""WITH {RAW_SQL} SELECT collection_identifier, chain, max(date) AS date,
 {', '.join(f"first({c} ORDER BY date DESC, {c} DESC) FILTER ({c} IS NOT NULL) AS {c}"
            for c in ('floor_native', 'floor_usd', 'listed_count', 'ranking'))}
 FROM raw WHERE date <= DATE '2000-06-30' GROUP BY 1, 2""")
def latest_known_until(spark, sf):
    return K.latest_known(fx.raw_prices(spark, sf), ENT, ["floor_native", "floor_usd", "listed_count", "ranking"],
                          until=F.to_date(F.lit("2000-06-30")))


_CANON = f"""{RAW_SQL}, counts AS (SELECT slug, collection_identifier, chain, count(*) AS cnt FROM raw GROUP BY 1, 2, 3),
canon AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY slug ORDER BY cnt DESC, collection_identifier) = 1)"""


@query("pair_counts", f"WITH {_CANON} SELECT * FROM counts")
def pair_counts(spark, sf):
    return K.pair_counts(fx.raw_prices(spark, sf))


@query("canonical_ids", f"WITH {_CANON} SELECT * FROM canon")
def canonical_ids(spark, sf):
    return K.canonical_ids(fx.raw_prices(spark, sf))


@query("canonical_prices", f"""WITH {_CANON} SELECT collection_identifier, chain, date, cents FROM raw
 SEMI JOIN canon USING (collection_identifier, chain)""")
def canonical_prices(spark, sf):
    return K.keep_canonical(fx.raw_prices(spark, sf)).select(*ENT, "date", "cents")


@query("entities_with_history", f"""WITH {RAW_SQL} SELECT collection_identifier, chain, date, cents FROM raw
 QUALIFY count(*) OVER (PARTITION BY collection_identifier, chain) >= 30""")
def entities_with_history(spark, sf):
    return K.entities_with_history(fx.raw_prices(spark, sf), 30).select(*ENT, "date", "cents")


@query("market_mood_fill7", f"WITH {MOOD_SQL} SELECT date, hype_score, hype_sentiment, hype_trend FROM mood")
def market_mood_fill7(spark, sf):
    return FE.market_mood(fx.market_daily(spark, sf))


@query("fear_index_fill7", f"WITH {FEAR_SQL} SELECT date, fear_greed_value, fear_greed_change_7d FROM fear")
def fear_index_fill7(spark, sf):
    return FE.fear_index(fx.index_snapshots(spark, sf), ["o_orderkey"])


_SYM = ["crypto_symbol", "date", *FE.SYMBOL_FEATURES]
_SYM_ROUND = ", ".join(c if c in ("crypto_symbol", "date") else f"{rs(c)} AS {c}" for c in _SYM)


@query("symbol_features", f"WITH {SYMBOL_FEATURES_SQL} SELECT {_SYM_ROUND} FROM symfeats")
def symbol_features(spark, sf):
    f = FE.symbol_features(fx.symbol_daily(spark, sf))
    return f.select("crypto_symbol", "date", *[r(c).alias(c) for c in FE.SYMBOL_FEATURES])


_WIDE = ("BTC", "ETH", "SOL")


@query("symbols_wide", f"WITH {SYMBOL_FEATURES_SQL} SELECT date, "
       + ", ".join(f"{rs(f'max({c}) FILTER (crypto_symbol = {chr(39)}{s}{chr(39)})')} AS {s}_{c}"
                   for s in _WIDE for c in FE.SYMBOL_FEATURES) + " FROM symfeats GROUP BY date")
def symbols_wide(spark, sf):
    wide = FE.symbols_wide(FE.symbol_features(fx.symbol_daily(spark, sf)), list(_WIDE))
    return wide.select("date", *[r(c).alias(c) for c in wide.columns if c != "date"])


@query("signal_join", f"""WITH {panel_sql('p_brand')}, {MOOD_SQL}, {FEAR_SQL}, {SYMBOL_FEATURES_SQL}, feats AS (
 SELECT collection_identifier, chain, date FROM panel), {with_market_sql()}
 SELECT collection_identifier, chain, date, hype_score, hype_sentiment, fear_greed_value, {rs('native_ret_7d')} AS native_ret_7d,
  {rs('btc_vol_7d')} AS btc_vol_7d FROM full_panel""")
def signal_join(spark, sf):
    p = fx.panel(spark, sf, "p_brand").select(*ENT, "date")
    hype, idx, sym = fx.market_daily(spark, sf), fx.index_snapshots(spark, sf), fx.symbol_daily(spark, sf)
    days = calendar_rows(fx.table(spark, sf, "orders"), "o_orderdate") + 8
    out = left_join_bounded(p, FE.market_mood(hype), ["date"], days)
    out = left_join_bounded(out, FE.fear_index(idx, ["o_orderkey"]), ["date"], days)
    out = FE.with_symbols(out, FE.symbol_features(sym), 3 * days)
    return out.select(*ENT, "date", "hype_score", F.col("hype_sentiment").cast("double").alias("hype_sentiment"),
                      "fear_greed_value", r("native_ret_7d").alias("native_ret_7d"), r("btc_vol_7d").alias("btc_vol_7d"))


# --- labels ---------------------------------------------------------------------------------

LABEL_SQL = f"""{panel_sql(KEY)}, near AS (
 SELECT p.collection_identifier, p.chain, p.day, p.floor_native,
  coalesce(q0.floor_native, q1.floor_native, q2.floor_native, q3.floor_native, q4.floor_native) AS later
 FROM panel p
 {' '.join(f"LEFT JOIN panel q{i} ON q{i}.collection_identifier = p.collection_identifier AND q{i}.chain = p.chain AND q{i}.day = p.day + {14 + o}"
           for i, o in enumerate((0, 1, -1, 2, -2)))}), fwd AS (
 SELECT *, CASE WHEN floor_native > 0 THEN (later - floor_native) / floor_native END AS forward_ret FROM near), labelled AS (
 SELECT *, CASE WHEN forward_ret >= 0.10 THEN 1 WHEN forward_ret <= -0.10 THEN -1 WHEN forward_ret IS NOT NULL THEN 0 END AS label_3class,
  CASE WHEN forward_ret >= 0.10 THEN 1 WHEN forward_ret IS NOT NULL THEN 0 END AS label_binary FROM fwd)"""


def labelled(spark, sf):
    from seriesloom.operators.labels import add_labels
    return add_labels(_slim(spark, sf))


@query("forward_labels", f"WITH {LABEL_SQL} SELECT collection_identifier, chain, day, forward_ret, label_3class, label_binary FROM labelled")
def forward_labels(spark, sf):
    return labelled(spark, sf).select(*ENT, "day", "forward_ret", "label_3class", "label_binary")


@query("label_shares", f"""WITH {LABEL_SQL} SELECT label_3class, count(*) AS n,
 {rs('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM labelled WHERE label_3class IS NOT NULL GROUP BY 1""")
def label_shares(spark, sf):
    from seriesloom.operators.labels import class_shares
    return class_shares(labelled(spark, sf), "label_3class").withColumn("pct", r("pct"))


@query("class_weights", f"""WITH {LABEL_SQL}, c AS (SELECT label_3class, count(*) AS n FROM labelled
 WHERE label_3class IS NOT NULL GROUP BY 1) SELECT label_3class, n,
 {rs('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * CAST(n AS DOUBLE))')} AS weight FROM c""")
def class_weights(spark, sf):
    from seriesloom.operators.labels import class_weights as weights
    return weights(labelled(spark, sf), "label_3class").withColumn("weight", r("weight"))
