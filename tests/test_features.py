"""Feature panel: no look-ahead, drops, carried signals, look-back mode."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import codes
from seriesloom.operators import features as FE

D0 = dt.date(2020, 1, 1)
PRICES = ("collection_identifier string, chain string, date date, slug string, floor_native double, floor_usd double, "
          "sale_count_24h bigint, sale_volume_native_24h double, highest_sale_native_24h double, "
          "lowest_sale_native_24h double, listed_count bigint, unique_owners bigint, total_supply bigint, ranking bigint")


def day(n):
    return D0 + dt.timedelta(days=n)


def prices(spark, days, e="a", seed=1, price=None):
    rnd = random.Random(seed)
    rows = []
    for d in days:
        p = price(d) if price else rnd.uniform(5, 10)
        rows.append((e, "base", day(d), f"slug-{e}", p, None if p is None else p * 2, rnd.randrange(5), rnd.uniform(1, 9), 11.0, 4.0,
                     rnd.randrange(1, 50), rnd.randrange(1, 90), 100, rnd.randrange(1, 20)))
    return spark.createDataFrame(rows, PRICES)


def sources(spark, n=400):
    hype = spark.createDataFrame([(day(d), d % 100, "POSITIVE", "UP") for d in range(0, n, 10)],
                                 "date date, hype_score int, sentiment string, trend string")
    x = spark.createDataFrame([("a", "base", day(d), 50 + d % 7, 5, 6) for d in range(0, n, 60)],
                              "collection_identifier string, chain string, date date, sentiment_score int, community_engagement int, volume_activity int")
    idx = spark.createDataFrame([(dt.datetime(2020, 1, 1) + dt.timedelta(days=d, hours=h), float(d % 90 + h)) for d in range(n) for h in (0, 5)],
                                "date timestamp_ntz, value double")
    sym = spark.createDataFrame([(s, day(d), 100.0 + (d * 7 + k) % 31, 5.0, 1000.0, -3.0) for k, s in enumerate(("ETH", "BTC")) for d in range(n) if d % 9],
                                "crypto_symbol string, date date, current_price double, total_volume double, market_cap double, ath_change_percentage double")
    return hype, x, idx, sym


def test_nothing_comes_from_later_days(spark):
    days = [d for d in range(330) if d % 11 not in (3, 4)]
    cut = 250
    whole = FE.feature_panel(prices(spark, days), *sources(spark), min_days=60)
    early = tuple(s.filter(F.to_date("date") <= F.lit(day(cut))) for s in sources(spark))
    part = FE.feature_panel(prices(spark, days).filter(F.col("date") <= F.lit(day(cut))), *early, min_days=60)
    a = {r.date: r for r in whole.collect() if r.date <= day(cut)}
    b = {r.date: r for r in part.collect()}
    assert set(a) == set(b) and len(a) == cut + 1
    for d in a:
        for c in codes.FEATURES:
            assert a[d][c] == b[d][c] or a[d][c] == pytest.approx(b[d][c], abs=1e-9), (d, c)


def test_long_gaps_are_dropped_and_rows_count(spark):
    days = [*range(0, 40), *range(60, 100)]
    got = FE.entity_features(prices(spark, days), None, 10).orderBy("date").collect()
    kept = [(r.date - D0).days for r in got]
    assert kept == [*range(0, 47), *range(60, 100)]
    by_day = {(r.date - D0).days: r for r in got}
    # three rows back from day 61 lies on the other side of the gap
    assert by_day[61].ret_3d == pytest.approx(by_day[61].floor_native / by_day[45].floor_native - 1)


def test_min_days_counts_price_rows(spark):
    p = prices(spark, range(30)).unionByName(prices(spark, range(29), "b"))
    x = sources(spark)[1].withColumn("collection_identifier", F.lit("b"))
    got = FE.entity_features(p, x, 30).select("collection_identifier").distinct().collect()
    assert [r[0] for r in got] == ["a"]


def test_sentiment_on_a_day_without_price_row(spark):
    days = [d for d in range(60) if d not in (20, 21, 22)]
    x = spark.createDataFrame([("a", "base", day(21), 70, 5, 6), ("a", "base", day(63), 1, 1, 1)],
                              "collection_identifier string, chain string, date date, sentiment_score int, community_engagement int, volume_activity int")
    got = {(r.date - D0).days: r.xsent_score for r in FE.entity_features(prices(spark, days), x, 10).collect()}
    assert sorted(got) == list(range(60))
    assert got[20] is None and got[21] == 70 and got[59] == 70


def test_zero_price_gives_missing_not_infinite(spark):
    got = FE.entity_features(prices(spark, range(40), price=lambda d: 0.0 if d == 10 else 5.0), None, 10).collect()
    by = {(r.date - D0).days: r for r in got}
    assert by[13].ret_3d is None and by[14].ret_3d == 0.0
    assert by[10].intraday_range is None


def test_market_mood_ends_after_seven_days(spark):
    hype = spark.createDataFrame([(day(0), 40, "NEGATIVE", "odd"), (day(20), 60, None, "DOWN")], "date date, hype_score int, sentiment string, trend string")
    got = {(r.date - D0).days: (r.hype_score, r.hype_sentiment, r.hype_trend) for r in FE.market_mood(hype).collect()}
    assert got[7] == (40.0, -1, 0) and 8 not in got and got[20] == (60.0, 0, -1) and got[27] == (60.0, 0, -1) and 28 not in got


def test_lookback_rows_equal_the_last_panel_rows(spark):
    p = prices(spark, range(300)).unionByName(prices(spark, range(100, 290), "b", 3))
    whole = FE.feature_panel(p, *sources(spark), min_days=20)
    last = {}
    for r in whole.collect():
        if r.collection_identifier not in last or r.date > last[r.collection_identifier].date:
            last[r.collection_identifier] = r
    got = {r.collection_identifier: r for r in FE.feature_panel(p, *sources(spark), min_days=20, lookback_days=280).collect()}
    assert set(got) == {"a", "b"}
    own = [c for c in codes.FEATURES if not c.startswith("xsent")]
    for e in got:
        assert got[e].date == last[e].date
        for c in own:
            assert got[e][c] == pytest.approx(last[e][c], abs=1e-9) or (got[e][c] is None and last[e][c] is None), c
    assert got["a"].xsent_score == 50 + 240 % 7 and got["b"].xsent_score is None


def _nodes(plan, name):
    return [line for line in plan.split("\n") if name in line]


def test_panel_plan_has_one_exchange_on_the_entity(spark):
    plan = FE.entity_features(prices(spark, range(80)), sources(spark)[1], 10)._jdf.queryExecution().executedPlan().toString()
    by_entity = [x for x in _nodes(plan, "Exchange hashpartitioning") if "date" not in x]
    assert len(by_entity) == 1
    assert not _nodes(plan, "CartesianProduct") and not _nodes(plan, "BroadcastNestedLoopJoin") and "Python" not in plan


def test_generated_code_of_the_panel_is_small_enough_to_be_compiled(spark, tmp_path):
    """The JVM interprets methods of more than 8,000 bytes, for every row."""
    import re

    from seriesloom import catalog
    catalog.load_all()
    at = dt.datetime(2001, 1, 1)
    spark.createDataFrame([(k, k, 1 + k % 2, 1, 2.0, 10.0 + k, 0.1, at + dt.timedelta(days=k // 2)) for k in range(400)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "FOP"[k % 3], 10.0 + k, at + dt.timedelta(days=k)) for k in range(200)],
                          "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = catalog.QUERIES["feature_panel"](spark, str(tmp_path))
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(sizes) > 5 and max(sizes) < 8000, sizes
    assert df.count() == 400
