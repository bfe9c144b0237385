"""SQL text of the fixtures, shared by the checks, and rounding on the Spark side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.fixtures import CHAINS


# Prices are short decimals, so their means often end on a 5 just behind the rounding digit, where
# the last bit of a sum decides. Both sides shift by the same small part of that digit first.
_SHIFT = 0.0173


def r(c: str | Column, places: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 turns a negative zero into zero."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x + F.lit(_SHIFT * 10 ** -places), places) + F.lit(0.0)


def nearest(c: str, places: int = 6) -> Column:
    """The same as ``r`` for panels of many columns: a multiple of the last digit, where ``round`` writes each double out as decimal text."""
    scale = F.lit(10.0 ** places)
    return F.rint((F.col(c) + F.lit(_SHIFT * 10 ** -places)) * scale) / scale + F.lit(0.0)


def rs(expr: str, places: int = 6) -> str:
    """The same in SQL."""
    return f"(round({expr} + CAST({_SHIFT * 10 ** -places!r} AS DOUBLE), {places}) + 0.0)"


_CHAIN_LIST = "[" + ", ".join(f"'{c}'" for c in CHAINS) + "]"
_CHAIN_SYMBOL = """CASE lower(chain) WHEN 'ethereum' THEN 'ETH' WHEN 'base' THEN 'ETH' WHEN 'polygon' THEN 'MATIC'
 WHEN 'solana' THEN 'SOL' WHEN 'arbitrum' THEN 'ARB' WHEN 'optimism' THEN 'OP' WHEN 'bnb' THEN 'BNB'
 WHEN 'blast' THEN 'BLAST' END"""

_KEYS = {
    "p_brand": ("p_brand", "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER)"),
    "p_type": ("p_type", "length(p_type)"),
    "l_suppkey": ("'S' || CAST(l_suppkey AS VARCHAR)", "l_suppkey"),
}


def sales_sql(key: str) -> str:
    slug, number = _KEYS[key]
    join = "JOIN part ON l_partkey = p_partkey" if key.startswith("p_") else ""
    return f"""sales AS (
 SELECT *, {slug} AS slug, {_CHAIN_LIST}[CAST({number} % 10 + 1 AS INTEGER)] AS chain,
   CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS unit,
   l_extendedprice * (1 - l_discount) / l_quantity AS unit_usd,
   CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
 FROM lineitem {join})"""


def panel_sql(key: str = "p_brand") -> str:
    """CTEs ``sales`` and ``panel`` (ranked)."""
    return f"""{sales_sql(key)}, daily AS (
 SELECT slug, chain, date, min(unit) AS floor_native, min(unit_usd) AS floor_usd, count(*) AS sale_count_24h,
   CAST(sum(cents) AS DOUBLE) / 100.0 AS sale_volume_native_24h, max(unit) AS highest_sale_native_24h,
   min(unit) AS lowest_sale_native_24h, CAST(sum(l_linenumber) AS BIGINT) AS listed_count,
   count(DISTINCT l_orderkey) AS unique_owners, count(DISTINCT l_partkey) AS total_supply
 FROM sales GROUP BY slug, chain, date), panel AS (
 SELECT *, 'id-' || slug AS collection_identifier, {_CHAIN_SYMBOL} AS chain_currency_symbol,
   CASE WHEN length(slug) % 3 <> 0 THEN md5(slug) END AS contract_address,
   CASE WHEN day(date) % 3 <> 0 THEN 'https://best.example/' || slug END AS best_price_url,
   CAST(date - DATE '1970-01-01' AS INTEGER) AS day,
   dense_rank() OVER (PARTITION BY date ORDER BY sale_volume_native_24h DESC) AS ranking
 FROM daily)"""


RAW_SQL = """raw AS (
 SELECT CAST(p_partkey AS VARCHAR) AS collection_identifier, p_name AS slug, p_brand AS chain,
   CAST(l_shipdate AS DATE) AS date, CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS day,
   CASE WHEN l_linenumber % 4 <> 0 THEN l_extendedprice / l_quantity END AS floor_native,
   CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice * (1 - l_discount) / l_quantity END AS floor_usd,
   CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS BIGINT) END AS listed_count,
   CASE WHEN l_linenumber % 5 <> 0 THEN CAST(p_size AS BIGINT) END AS ranking,
   'SYM' AS chain_currency_symbol, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

COLLECTIONS_SQL = """collections AS (
 SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS collection_identifier, p_name AS slug,
   array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
   p_brand AS chain, lower(p_type) AS categories,
   CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '@' || replace(p_name, ' ', '_') END AS x_page,
   'https://market.example/' || CAST(p_partkey AS VARCHAR) AS marketplace_url
 FROM part)"""

MARKET_SQL = """market0 AS (
 SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c,
   count(*) AS n FROM orders GROUP BY 1), market1 AS (
 SELECT date, n, (2 * c + n * 500000) // (2 * n * 500000) AS hype_score FROM market0), market AS (
 SELECT date, hype_score,
   CASE WHEN hype_score >= 55 THEN 'POSITIVE' WHEN hype_score <= 45 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment,
   CASE WHEN n % 3 = 0 THEN 'UP' WHEN n % 3 = 1 THEN 'DOWN' ELSE 'STABLE' END AS trend
 FROM market1)"""

INDEX_SQL = """index_snapshots AS (
 SELECT o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS date,
   CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 101 AS DOUBLE) AS value, o_orderkey
 FROM orders)"""

SYMBOL_SQL = """symbol0 AS (
 SELECT CASE o_orderstatus WHEN 'F' THEN 'ETH' WHEN 'O' THEN 'SOL' WHEN 'P' THEN 'BTC' END AS crypto_symbol,
   CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c,
   count(*) AS n FROM orders GROUP BY 1, 2), symbols AS (
 SELECT crypto_symbol, date, CAST(c AS DOUBLE) / n / 100.0 AS current_price, CAST(c AS DOUBLE) / 100.0 AS total_volume,
   CAST(sum(c) OVER (PARTITION BY crypto_symbol ORDER BY date) AS DOUBLE) / 100.0 AS market_cap,
   CAST(-(c % 9000) AS DOUBLE) / 100.0 AS ath_change_percentage
 FROM symbol0)"""


def sentiment_sql() -> str:
    """CTE ``sentiment``; needs ``sales``."""
    return """sentiment0 AS (
 SELECT slug, chain, date_trunc('month', date) AS month, max(date) AS date, count(*) AS n,
   CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d, CAST(sum(l_linenumber) AS BIGINT) AS ln
 FROM sales GROUP BY 1, 2, 3), sentiment1 AS (
 SELECT *, (20 * d + n) // (2 * n) AS sentiment_score FROM sentiment0), sentiment AS (
 SELECT 'id-' || slug AS collection_identifier, slug, chain, date, sentiment_score,
   CASE WHEN sentiment_score >= 60 THEN 'EXTREMELY_BULLISH' WHEN sentiment_score >= 52 THEN 'BULLISH'
     WHEN sentiment_score >= 48 THEN 'NEUTRAL' WHEN sentiment_score >= 40 THEN 'BEARISH'
     ELSE 'EXTREMELY_BEARISH' END AS sentiment_category,
   1 + n % 10 AS community_engagement, 1 + ln % 10 AS volume_activity
 FROM sentiment1)"""


def sma_sql(src: str, keys: str, value: str, spans: dict[int, int], prefix: str = "sma") -> str:
    """CTE ``{src}_sma``: calendar averages by running the fill over every day of each frame.

    A statement of its own, not the closed form: each missing day's value is taken from the gap
    it lies in (midpoint rule), days outside the frame's observations copy the nearest one.
    """
    gap = f"""{src}_g AS (
 SELECT *, lag(day) OVER w AS _d0, lag({value}) OVER w AS _v0 FROM {src}
 WINDOW w AS (PARTITION BY {keys} ORDER BY day)), {src}_h AS (
 SELECT *, CASE WHEN day - _d0 > 1 THEN list_sum(list_transform(range(1, day - _d0),
     lambda k: {value} - ({value} - _v0) / power(2.0, k))) ELSE 0.0 END AS _gap FROM {src}_g)"""
    cols = []
    for p, allowed in spans.items():
        f = f"OVER (PARTITION BY {keys} ORDER BY day RANGE BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
        cols.append(f"""CASE WHEN {p} - count({value}) {f} <= {allowed} THEN
   (sum({value} + _gap) {f} - first_value(_gap) {f}
    + (first_value(day) {f} - (day - {p - 1})) * first_value({value}) {f}) / {p} END AS {prefix}{p}""")
    return f"{gap}, {src}_sma AS (SELECT *, {', '.join(cols)} FROM {src}_h)"


def filled_day_by_day_sql(name: str, ends: str, obs: str, keys: list[str], spans: dict[int, int]) -> str:
    """CTEs up to ``{name}{P}`` (keys, end_day, sma{P}): the frame of each end day written out, every missing day filled with the
    running midpoint of its gap inside the frame, the frame's edges with their neighbour."""
    out = []
    for p, allowed in spans.items():
        k = ", ".join(f"e.{x}" for x in keys)
        on = " AND ".join(f"o.{x} = e.{x}" for x in keys)
        part = f"PARTITION BY {', '.join(keys)}, end_day ORDER BY d"
        back, ahead = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
        out.append(f"""{name}f{p} AS (SELECT {k}, e.end_day, e.end_day - i AS d, o.v FROM {ends} e CROSS JOIN range({p}) r(i)
  LEFT JOIN {obs} o ON {on} AND o.day = e.end_day - i),
 {name}g{p} AS (SELECT *, last_value(v IGNORE NULLS) OVER ({part} {back}) AS v0, last_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER ({part} {back}) AS d0,
  first_value(v IGNORE NULLS) OVER ({part} {ahead}) AS v1 FROM {name}f{p}),
 {name}{p} AS (SELECT {', '.join(keys)}, end_day, CASE WHEN count(v) > 0 AND {p} - count(v) <= {allowed} THEN
  avg(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v1 - (v1 - v0) / power(2.0, d - d0) END) END AS sma{p}
  FROM {name}g{p} GROUP BY ALL)""".replace("GROUP BY ALL", f"GROUP BY {', '.join(keys)}, end_day"))
    return ",\n ".join(out)
