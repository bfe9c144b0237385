"""Averages and crossovers against a plain day-by-day statement of the rule."""

import datetime as dt
import random

import pytest

from seriesloom.operators import averages as A
from seriesloom.operators import crosses as X

D0 = dt.date(2020, 1, 1)


def frame_average(values, end, span, allowed):
    """Walk the days of the frame; a missing day becomes the midpoint of its left neighbour (filled
    or not) and the next observed day, or a copy of the only side there is."""
    days = [end - i for i in reversed(range(span))]
    line = [values.get(d) for d in days]
    if sum(v is None for v in line) > allowed:
        return None
    for i, d in enumerate(days):
        if values.get(d) is None:
            left = line[i - 1] if i else None
            right = next((values[x] for x in days[i + 1:] if values.get(x) is not None), None)
            if left is None and right is None:
                return None
            line[i] = right if left is None else left if right is None else (left + right) / 2
    return sum(line) / span


def gappy(seed, n=160, p=0.7):
    rnd = random.Random(seed)
    return {d: round(rnd.uniform(1, 100), 2) for d in range(n) if rnd.random() < p}


def frame(spark, series):
    rows = [(k, d, D0 + dt.timedelta(days=d), v) for k, s in series.items() for d, v in s.items()]
    df = spark.createDataFrame(rows, "k string, day int, date date, v double")
    return df.withColumn("day", (df.day + (D0 - dt.date(1970, 1, 1)).days))


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


BASE = (D0 - dt.date(1970, 1, 1)).days


@pytest.mark.parametrize("spans", [{20: 20, 50: 50}, {5: 1, 20: 6}, {7: 0, 30: 10}])
def test_row_averages_match_the_walk(spark, spans):
    series = {f"s{i}": gappy(i, p=0.4 + 0.1 * i) for i in range(6)}
    got = A.gap_filled_sma(frame(spark, series), ["k"], "v", spans).collect()
    for r in got:
        for span, allowed in spans.items():
            assert same(r[f"sma{span}"], frame_average(series[r.k], r.day - BASE, span, allowed))


def test_rows_without_a_value_end_on_a_missing_day(spark):
    series = {"a": gappy(3), "b": gappy(4, p=0.3)}
    with_nulls = {k: {d: s.get(d) for d in range(160) if d in s or d % 3 == 0} for k, s in series.items()}
    got = A.gap_filled_sma(frame(spark, with_nulls), ["k"], "v", {10: 8, 40: 40}, sparse=True).collect()
    for r in got:
        for span, allowed in {10: 8, 40: 40}.items():
            assert same(r[f"sma{span}"], frame_average(series[r.k], r.day - BASE, span, allowed))


def test_averages_as_of_a_date(spark):
    series = {f"s{i}": {d: v for d, v in gappy(i, 150, 0.5).items() if d < 120 + 3 * i} for i in range(8)}
    series["old"] = {1: 5.0, 2: 6.0}
    spans = {20: 18, 50: 50, 100: 60}
    end = 140
    got = {r.k: r for r in A.sma_as_of(frame(spark, series), ["k"], "v", D0 + dt.timedelta(days=end), spans, 100).collect()}
    assert set(got) == set(series)
    for k, s in series.items():
        for span, allowed in spans.items():
            assert same(got[k][f"sma{span}"], frame_average(s, end, span, allowed))
        present = sum(end - 100 < d <= end for d in s)
        assert (got[k].days_present, got[k].days_missing, got[k].records) == (present, 100 - present, len(s))


def test_threshold_is_inclusive(spark):
    full = {d: 1.0 for d in range(20)}
    one_gap = {d: v for d, v in full.items() if d != 7}
    two_gaps = {d: v for d, v in one_gap.items() if d != 9}
    got = A.gap_filled_sma(frame(spark, {"a": one_gap, "b": two_gaps}), ["k"], "v", {20: 1})
    last = {r.k: r.sma20 for r in got.collect() if r.day - BASE == 19}
    assert last == {"a": 1.0, "b": None}


def test_days_present_counts_rows_without_value(spark):
    df = frame(spark, {"a": {0: 1.0, 1: None, 5: 2.0}})
    got = {r.day - BASE: (r.present_3, r.missing_3) for r in A.days_present(df, ["k"], [3]).collect()}
    assert got == {0: (1, 2), 1: (2, 1), 5: (1, 2)}


def test_last_value_means_skip_missing(spark):
    df = frame(spark, {"a": {d: (None if d % 2 else float(d)) for d in range(100)}})
    r = A.last_value_means(df, ["k"], "v").first()
    known = [float(d) for d in range(99, 39, -1) if d % 2 == 0]
    assert r.ma7 == pytest.approx(sum(known[:7]) / 7) and r.ma30 == pytest.approx(sum(known[:30]) / 30)


def panel(spark, series, usd=1.0):
    rows = [(k, "base", D0 + dt.timedelta(days=d), v, None if v is None else v * usd, 1) for k, s in series.items() for d, v in s.items()]
    return spark.createDataFrame(rows, "slug string, chain string, date date, floor_native double, floor_usd double, ranking bigint")


def crossings(s, short, long, sg, lg):
    days = sorted(d for d, v in s.items() if v is not None)
    known = {d: s[d] for d in days}
    out = []
    for i in range(long, len(days)):
        now, before = days[i], days[i - 1]
        vals = [frame_average(known, now, short, sg), frame_average(known, now, long, lg),
                frame_average(known, before, short, sg), frame_average(known, before, long, lg)]
        if None in vals:
            continue
        if vals[2] <= vals[3] + 1e-9 and vals[0] > vals[1] + 1e-9:
            out.append(now)
    return out


def test_crossovers_match_the_walk(spark):
    series = {f"s{i}": gappy(i + 20, 120, 0.8) for i in range(6)}
    got = X.detect_crosses(panel(spark, series), 5, 12, 3, 6).filter("is_native").collect()
    for k, s in series.items():
        assert sorted((r.date - D0).days for r in got if r.slug == k) == crossings(s, 5, 12, 3, 6)


def test_equal_averages_the_day_before_count_as_below(spark):
    s = {d: 0.1 for d in range(40)} | {40: 5.0, 41: 5.0}
    got = X.detect_crosses(panel(spark, {"a": s}), 5, 20, 0, 0).filter("is_native").collect()
    assert [(r.date - D0).days for r in got] == [40]


def test_start_date_only_cuts_the_output(spark):
    p = panel(spark, {f"s{i}": gappy(i + 40, 150, 0.8) for i in range(4)})
    start = D0 + dt.timedelta(days=80)
    whole = [r for r in X.detect_crosses(p, 5, 12, 5, 12).collect() if r.date >= start]
    assert sorted(map(tuple, X.detect_crosses(p, 5, 12, 5, 12, start_date=start).collect())) == sorted(map(tuple, whole))


def test_current_crossovers_are_those_of_the_last_row(spark):
    series = {f"s{i}": gappy(i, 60 + i, 0.8) for i in range(40)}
    p = panel(spark, series, usd=2.0)
    last = {k: D0 + dt.timedelta(days=max(s)) for k, s in series.items()}
    whole = [r for r in X.detect_crosses(p, 5, 12, 5, 12).collect() if r.date == last[r.slug]]
    got = X.detect_current_crosses(p, 5, 12, 5, 12).collect()
    key = lambda r: (r.slug, r.is_native, r.date, round(r.ma_short, 9), round(r.ma_long, 9))
    assert whole and sorted(map(key, got)) == sorted(map(key, whole))


def test_quota_carries_the_rest_over(spark):
    rows = [("s%02d" % i, "base", D0, True, 20, 50, False, i == 0) for i in range(9)]
    df = spark.createDataFrame(rows, "slug string, chain string, date date, is_native boolean, ma_short_period int, ma_long_period int, telegram_sent boolean, x_sent boolean")
    got = {r.slug: (r.post_now, r.carried_over) for r in X.with_post_quota(df, 5).collect()}
    assert [s for s, (now, _) in got.items() if now] and sorted(s for s, (now, _) in got.items() if now) == ["s01", "s02", "s03", "s04", "s05"]
    assert sorted(s for s, (_, later) in got.items() if later) == ["s06", "s07", "s08"]
