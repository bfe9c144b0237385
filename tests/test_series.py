"""Fills, calendars, as-of joins, grids, labels and duplicate handling against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import asof as AS
from seriesloom.operators import calendar as C
from seriesloom.operators import keyed as K
from seriesloom.operators import labels as LB
from seriesloom.operators import lookups as L
from seriesloom.operators import moves as M


def series(spark, rows):
    return spark.createDataFrame(rows, "k string, day int, v double")


def test_bounded_fill_on_rows_and_days(spark):
    rnd = random.Random(5)
    days = sorted(rnd.sample(range(120), 60))
    vals = {d: (rnd.random() if rnd.random() < 0.5 else None) for d in days}
    w = K.series_window(["k"])
    df = series(spark, [("a", d, v) for d, v in vals.items()]).withColumn("pos", F.row_number().over(w))
    for n in (1, 3, 7):
        got = {r.day: (r.rows, r.days) for r in df.select("day", M.filled("v", w, n).alias("rows"), M.filled_days("v", w, n).alias("days")).collect()}
        for i, d in enumerate(days):
            by_row = next((vals[x] for x in reversed(days[max(0, i - n):i + 1]) if vals[x] is not None), None)
            by_day = next((vals[x] for x in range(d, d - n - 1, -1) if vals.get(x) is not None), None)
            assert got[d] == (by_row, by_day)


def test_calendar_fill_and_missing_days(spark):
    df = series(spark, [("a", 1, 1.0), ("a", 4, 2.0), ("a", 13, 3.0), ("b", 7, 4.0)])
    full = C.fill_days(df, ["k"]).collect()
    assert sorted((r.k, r.day) for r in full) == [("a", d) for d in range(1, 14)] + [("b", 7)]
    assert {r.day: r.v for r in full if r.observed and r.k == "a"} == {1: 1.0, 4: 2.0, 13: 3.0}
    near = C.fill_days(df, ["k"], 2).collect()
    assert sorted(r.day for r in near if r.k == "a") == [1, 2, 3, 4, 5, 6, 13]
    gaps = C.missing_days(df, ["k"]).collect()
    assert sorted((r.missing_date - dt.date(1970, 1, 1)).days for r in gaps) == [2, 3, *range(5, 13)]


def test_blocked_sums_equal_long_frames(spark):
    df = series(spark, [("a", d, float(d * d % 97)) for d in range(130)])
    w = K.series_window(["k"])
    df = df.withColumn("s10", F.sum("v").over(w.rowsBetween(-9, 0)))
    rows = df.select("s10", M.blocks("s10", w, 10, 5).alias("s50"), F.sum("v").over(w.rowsBetween(-49, 0)).alias("want")).collect()
    assert all(r.s50 == pytest.approx(r.want) for r in rows)


def test_future_value_takes_offsets_in_order(spark):
    cases = {"0": (14, 0), "+1": (15, 1), "-1": (13, 2), "+2": (16, 3), "-2": (12, 4)}
    rows = []
    for i, (name, (day, _)) in enumerate(cases.items()):
        rows += [(name, 0, 10.0), (name, day, 20.0 + i)]
    rows += [("all", 0, 10.0)] + [("all", d, float(d)) for d in (12, 13, 15, 16)] + [("far", 0, 10.0), ("far", 17, 1.0), ("zero", 0, 0.0), ("zero", 14, 1.0)]
    df = spark.createDataFrame([(k, "base", d, v) for k, d, v in rows], "collection_identifier string, chain string, day int, floor_native double")
    got = {r.collection_identifier: r.forward_ret for r in LB.with_forward_return(df).filter("day = 0").collect()}
    for i, name in enumerate(cases):
        assert got[name] == pytest.approx((20.0 + i - 10) / 10)
    assert got["all"] == pytest.approx(0.5) and got["far"] is None and got["zero"] is None


def test_labels_include_their_limits(spark):
    df = spark.createDataFrame([("a", "c", 0, 8.0), ("a", "c", 14, 10.0), ("b", "c", 0, 8.0), ("b", "c", 14, 6.0), ("d", "c", 0, 8.0), ("d", "c", 14, 9.0)],
                               "collection_identifier string, chain string, day int, floor_native double")
    got = {r.collection_identifier: (r.label_3class, r.label_binary) for r in LB.add_labels(df, 14, 0.25, 0.25).filter("day = 0").collect()}
    assert got == {"a": (1, 1), "b": (-1, 0), "d": (0, 0)}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(None,)], "y int")
    assert {r.y: r.weight for r in LB.class_weights(df, "y").collect()} == {0: 8 / 12, 1: 8 / 4}


@pytest.mark.parametrize("hot", [False, True])
def test_asof_join_with_ties_and_a_hot_key(spark, hot):
    rnd = random.Random(9)
    base = dt.datetime(2024, 1, 1)
    key = (lambda: 0 if rnd.random() < 0.7 else rnd.randrange(5)) if hot else (lambda: rnd.randrange(6))
    left = [(key(), i, base + dt.timedelta(hours=rnd.randrange(500))) for i in range(300)]
    right = [(key(), 1000 + i, base + dt.timedelta(hours=rnd.randrange(500)), rnd.random() if rnd.random() < 0.9 else None) for i in range(200)]
    lf = spark.createDataFrame(left, "u int, id int, ts timestamp_ntz")
    rf = spark.createDataFrame(right, "u int, rid int, ts timestamp_ntz, v double")
    got = {r.id: (r.rid, r.v) for r in AS.asof_join(lf, rf, ["u"], "ts", ["rid", "v"], "rid").collect()}
    assert len(got) == len(left)
    for u, i, ts in left:
        best = max(((t, rid, v) for ru, rid, t, v in right if ru == u and t <= ts), key=lambda x: x[:2], default=None)
        assert got[i] == ((best[1], best[2]) if best else (None, None))


def test_even_grid_is_linear_interpolation(spark):
    rnd = random.Random(2)
    days = sorted(rnd.sample(range(90), 25))
    vals = {d: rnd.uniform(1, 50) for d in days}
    nulls = {days[4]: None, days[9]: None}
    df = series(spark, [("a", d, {**vals, **nulls}[d]) for d in days] + [("b", 3, 1.0), ("b", 5, 3.0)])
    got = AS.even_grid(df.withColumnRenamed("k", "e"), ["e"], "v").collect()
    a = sorted((r.k, r.at_day, r.v) for r in got if r.e == "a")
    grid = np.linspace(days[0], days[-1], 25)
    known = [d for d in days if d not in nulls]
    want = np.interp(grid, known, [vals[d] for d in known])
    assert [x[0] for x in a] == list(range(25))
    assert np.allclose([x[1] for x in a], grid) and np.allclose([x[2] for x in a], want)
    b = sorted((r.k, r.v) for r in got if r.e == "b")
    assert len(b) == 10 and np.allclose([v for _, v in b], np.linspace(1, 3, 10))


def test_duplicates_take_each_columns_first_known_value(spark):
    rows = [("a", 1, 5.0, None, "low"), ("a", 1, 7.0, None, None), ("a", 1, None, 9, "none"), ("a", 1, 6.0, 3, "mid")]
    df = spark.createDataFrame(rows, "k string, date int, floor_native double, listed int, name string")
    r = K.dedupe_days(df, ["k"], count_as="n").first()
    assert (r.floor_native, r.listed, r.name, r.n) == (7.0, 3, "mid", 4)


def test_latest_known_mixes_days(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 10), ("a", 2, None, 20), ("a", 3, 3.0, None)], "k string, date int, x double, y int")
    assert tuple(K.latest_known(df, ["k"], ["x", "y"]).first()) == ("a", 3, 3.0, 20)
    assert tuple(K.latest_known(df, ["k"], ["x", "y"], until=2).first()) == ("a", 2, 1.0, 20)


def test_canonical_ids(spark):
    rows = [("s", "b", "c")] * 3 + [("s", "a", "c")] * 3 + [("s", "z", "c")] * 2 + [("t", "a", "c")] + [(None, "q", "c")] * 2 + [("u", None, "c")]
    df = spark.createDataFrame(rows, "slug string, collection_identifier string, chain string")
    got = {(r.slug, r.collection_identifier) for r in K.canonical_ids(df).collect()}
    assert got == {("s", "a"), ("t", "a"), (None, "q")}
    # one id under two slugs does not double its rows
    assert K.keep_canonical(df).filter("collection_identifier = 'a'").count() == 4


def test_prefix_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("50%_off",), ("50 off",), ("a_b",), ("axb",), ("A_c",)], "slug string")
    assert [r.slug for r in L.names_by_prefix(df, "50%").collect()] == ["50%_off"]
    assert sorted(r.slug for r in L.names_by_prefix(df, "a_").collect()) == ["A_c", "a_b"]


def test_pages(spark):
    assert L.page_count(spark.range(0)).first().pages == 1
    assert L.page_count(spark.range(10)).first().pages == 1
    assert L.page_count(spark.range(11)).first().pages == 2
    assert [r.id for r in L.page(spark.range(25), ["id"], 2).collect()] == [20, 21, 22, 23, 24]


def test_staleness_limits(spark):
    as_of = dt.date(2024, 3, 1)
    rows = spark.createDataFrame([(s, "c") for s in ("d29", "d30", "d31", "never")], "slug string, chain string")
    seen = spark.createDataFrame([(f"d{n}", "c", as_of - dt.timedelta(days=n)) for n in (29, 30, 31)], "slug string, chain string, date date")
    got = {r.slug: r.stale for r in L.with_last_analysis(rows, seen, as_of).collect()}
    assert got == {"d29": False, "d30": True, "d31": True, "never": True}


def test_first_snapshot_of_the_day(spark):
    rows = [("e", dt.datetime(2024, 1, 1, 9), 2.0), ("e", dt.datetime(2024, 1, 1, 3), 1.0), ("e", dt.datetime(2024, 1, 2, 0), 5.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, value double")
    got = {r.date: r.value for r in K.first_of_day(df, ["symbol"], "ts").collect()}
    assert got == {dt.date(2024, 1, 1): 1.0, dt.date(2024, 1, 2): 5.0}


def test_incomplete_days_without_a_full_one(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 1, 3, 3, 4)], "date date")
    got = sorted(r.date.day for r in C.incomplete_days(df, 1, dt.date(2024, 1, 1)).collect())
    assert got == [2]
    assert C.incomplete_days(df, 9, dt.date(2024, 1, 1)).count() == 0


def test_null_keys_and_times_find_nothing_and_text_may_break_ties(spark):
    from seriesloom.operators.asof import asof_join
    at = [dt.datetime(2024, 1, 1, h) for h in range(4)]
    left = spark.createDataFrame([(1, "k", at[2]), (2, None, at[2]), (3, "k", None)], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("k", at[1], 1.0, "a"), ("k", at[1], 2.0, "b"), (None, at[1], 3.0, "c"), ("k", None, 4.0, "d")],
                                  "k string, ts timestamp, v double, t string")
    got = {r.id: r.v for r in asof_join(left, right, ["k"], "ts", ["v"], "t").collect()}
    assert got == {1: 2.0, 2: None, 3: None}
