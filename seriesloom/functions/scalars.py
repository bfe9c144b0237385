"""Column functions. All stay in the JVM and none depends on the session time zone."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesloom.functions import codes

# First and last second of the years 1 and 9999.
_FIRST_SECOND = -62135596800
_LAST_SECOND = 253402300799


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: str | Column, table: dict, default=None) -> Column:
    """Value of a small fixed table; ``default`` for anything not in it."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[col(c)]
    return found if default is None else F.coalesce(found, F.lit(default))


# --- time -----------------------------------------------------------------------------------

def epoch_seconds(epoch: str | Column) -> Column:
    """Seconds or milliseconds (above 1e12) since 1970 to whole seconds; unusable becomes NULL."""
    e = col(epoch).try_cast("double")
    secs = F.when(e > 1e12, e / 1000).otherwise(e).try_cast("bigint")
    return F.when(secs.between(_FIRST_SECOND, _LAST_SECOND), secs)


def epoch_date(epoch: str | Column) -> Column:
    """UTC calendar date of an epoch value."""
    return F.date_from_unix_date(F.floor(epoch_seconds(epoch) / 86400).cast("int"))


def epoch_clock(epoch: str | Column) -> Column:
    """UTC clock time ``HH:mm`` of an epoch value."""
    minutes = F.floor(F.pmod(epoch_seconds(epoch), F.lit(86400)) / 60)
    hh = F.lpad(F.floor(minutes / 60).cast("string"), 2, "0")
    mm = F.lpad((minutes % 60).cast("string"), 2, "0")
    return F.concat(hh, F.lit(":"), mm)


def offset_local_date(text: str | Column) -> Column:
    """Date as written in ``yyyy-MM-dd HH:mm:ss±zzzz``; the offset is checked, never applied."""
    t = F.trim(col(text))
    valid = F.try_to_timestamp(t, F.lit("y-M-d H:m:s[XXX][XX]")).isNotNull()
    has_offset = t.rlike(r"([+-]\d{2}:?\d{2}|Z)$")
    return F.when(valid & has_offset, F.to_date(F.split(t, " ")[0], "y-M-d"))


def day_number(date: str | Column) -> Column:
    """Days since 1970-01-01, the ordering column of every calendar frame."""
    return F.unix_date(col(date))


def day_text(date: str | Column) -> Column:
    """Date as ``DD-MM-YYYY``."""
    return F.date_format(col(date), "dd-MM-yyyy")


# --- values ---------------------------------------------------------------------------------

def to_number(c: str | Column) -> Column:
    """Number, or NULL when the text is none; NaN is missing too."""
    d = col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def finite(c: str | Column) -> Column:
    """NULL for NaN and for both infinities."""
    d = col(c)
    return F.when(F.abs(d) < float("inf"), d)  # NaN is greater than any number


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double; NULL where b is 0 or missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def empty_to_null(arr: str | Column) -> Column:
    a = col(arr)
    return F.when(F.size(a) > 0, a)


def or_default(c: str | Column, value) -> Column:
    return F.coalesce(col(c), F.lit(value))


def profit_pct(now: str | Column, then: str | Column) -> Column:
    """Gain in percent; NULL where either price is missing or 0."""
    a, b = F.nullif(col(now), F.lit(0.0)), F.nullif(col(then), F.lit(0.0))
    return F.try_divide(a - b, b) * 100


# --- categories -----------------------------------------------------------------------------

def _any_case(c: str | Column, table: dict) -> Column:
    """Lookup by lower-case ASCII key; the case is changed only for values that are not found as they
    are, and by ``translate``, which costs far less per row than the locale-aware ``lower``."""
    small = F.translate(col(c), ascii_uppercase, ascii_lowercase)
    return F.coalesce(lookup(c, table), lookup(small, table))


def chain_code(chain: str | Column) -> Column:
    return F.coalesce(_any_case(chain, codes.CHAIN_CODES), F.lit(codes.UNKNOWN_CHAIN_CODE))


def chain_symbol(chain: str | Column) -> Column:
    return _any_case(chain, codes.CHAIN_SYMBOLS)


def mood_code(c: str | Column) -> Column:
    return lookup(c, codes.MOOD_CODES, 0)


def trend_code(c: str | Column) -> Column:
    return lookup(c, codes.TREND_CODES, 0)


def signal_text(c: str | Column) -> Column:
    return lookup(col(c).cast("int"), codes.SIGNAL_TEXT)


def category_symbol(c: str | Column) -> Column:
    return lookup(c, codes.CATEGORY_SYMBOLS, codes.UNKNOWN_CATEGORY_SYMBOL)


def heat(score: str | Column) -> Column:
    s = col(score)
    return F.when(s >= 75, "hot").when(s >= 50, "warm").when(s.isNotNull(), "cold")


def level_flag(c: str | Column) -> Column:
    """Flag of a 1-10 level: 7 and up is high, 3 and down is low, else empty."""
    return F.when(col(c) >= 7, "high").when(col(c) <= 3, "low").otherwise("")


def three_way(r: str | Column, up: float, down: float) -> Column:
    """1 from ``up``, -1 from ``-down``, 0 between; both limits belong to their class."""
    x = col(r)
    return F.when(x >= up, 1).when(x <= -down, -1).when(x.isNotNull(), 0)


def at_least(r: str | Column, limit: float) -> Column:
    x = col(r)
    return F.when(x >= limit, 1).when(x.isNotNull(), 0)


# --- text -----------------------------------------------------------------------------------

def joined(arr: str | Column) -> Column:
    """Array as ``a, b``; a missing array stays missing."""
    return F.when(col(arr).isNotNull(), F.concat_ws(", ", col(arr)))


def starts_with(c: str | Column, prefix: str, wildcards: bool = False) -> Column:
    """Case-insensitive prefix test; ``%`` and ``_`` are literal unless ``wildcards``."""
    if not wildcards:
        prefix = reduce(lambda p, ch: p.replace(ch, "\\" + ch), "\\%_", prefix)
    return col(c).ilike(prefix + "%")


def same_text(c: str | Column, value: str) -> Column:
    return F.lower(col(c)) == value.lower()


def without_at(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "^@+", "")


def html_escape(c: str | Column) -> Column:
    table = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), table, col(c))


def hash_tag(c: str | Column) -> Column:
    return F.translate(col(c), " -", "")


def fixed(c: str | Column, places: int) -> Column:
    """Number with fixed decimals, ``N/A`` when missing. The pattern form rounds the exact binary
    value, as printf does."""
    text = F.call_function("format_number", col(c).cast("double"), F.lit("0." + "0" * places))
    return F.coalesce(text, F.lit("N/A"))


def shown(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit("N/A"))


def currency_suffix(is_native: str | Column, symbol: str | Column) -> Column:
    return F.when(col(is_native), F.coalesce(col(symbol), F.lit(""))).otherwise("USD")


def alert_text() -> Column:
    """One-line alert of a crossover row enriched with its price row."""
    cur = currency_suffix("is_native", "chain_currency_symbol")
    return F.concat_ws(
        " | ",
        F.concat(shown("slug"), F.lit(" on "), shown("chain"), F.lit(" "), shown("date")),
        F.concat(F.lit("rank "), shown("ranking")),
        F.concat(F.lit("floor "), fixed("floor_native", 4), F.lit(" "),
                 F.coalesce(col("chain_currency_symbol"), F.lit("")), F.lit(" / $"), fixed("floor_usd", 2)),
        F.concat(F.lit("MA"), shown("ma_short_period"), F.lit(" "), fixed("ma_short", 4), F.lit(" > MA"),
                 shown("ma_long_period"), F.lit(" "), fixed("ma_long", 4), F.lit(" "), cur),
        F.concat(F.lit("owners "), shown("unique_owners"), F.lit(", supply "), shown("total_supply"),
                 F.lit(", listed "), shown("listed_count")),
        F.concat(F.lit("contract "), shown("contract_address")),
        F.concat(F.lit("best price "), F.coalesce(col("best_price_url"), F.lit(""))),
    )


def post_text() -> Column:
    """Short post of the same row: display name, handle, hash tag, the crossing, floor prices, counts and the link."""
    cur = currency_suffix("is_native", "chain_currency_symbol")
    name = F.coalesce(col("name"), col("slug"))
    return F.concat(
        name, F.lit(" by "), F.coalesce(col("x_page"), col("slug")), F.lit(" on #"), shown("chain"),
        F.lit(": MA"), shown("ma_short_period"), F.lit(" ("), fixed("ma_short", 4), F.lit(" "), cur,
        F.lit(") > MA"), shown("ma_long_period"), F.lit(" ("), fixed("ma_long", 4), F.lit(" "), cur,
        F.lit("), floor "), fixed("floor_native", 4), F.lit(" "), F.coalesce(col("chain_currency_symbol"), F.lit("")),
        F.lit(" (~$"), fixed("floor_usd", 2), F.lit("), "), shown("total_supply"), F.lit(" supply, "), shown("unique_owners"),
        F.lit(" owners, "), shown("listed_count"), F.lit(" listed #"), hash_tag(name),
        F.coalesce(F.concat(F.lit(" "), col("best_price_url")), F.lit("")),
    )
