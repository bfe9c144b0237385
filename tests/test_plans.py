"""Shape of plans and spread of hot keys: picks, as-of joins, current crossovers."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import asof, crosses, keyed
from seriesloom.functions import scalars as S

LO = dt.datetime(2024, 3, 1)


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def below(plan, node):
    """Text of the plan under each line that holds ``node``."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[\s:+\-|]*", x)[0]) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if node in line:
            j = i + 1
            while j < len(lines) and depth[j] > depth[i]:
                j += 1
            out.append("\n".join(lines[i + 1:j]))
    return out


@pytest.fixture(scope="module")
def prices(spark):
    rnd, rows = random.Random(3), []
    for _ in range(900):
        rows.append((rnd.choice(["i1", "i2", "i3", None]), rnd.choice(["x", "y"]), rnd.choice(["s1", "s2", None]),
                     None if rnd.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 20)),
                     None if rnd.random() < 0.3 else rnd.choice([1.0, 2.0, rnd.random()]), None if rnd.random() < 0.5 else rnd.choice("abc")))
    return spark.createDataFrame(rows, "collection_identifier string, chain string, slug string, date date, floor_native double, tag string").cache()


def test_picks_sort_no_raw_rows(prices):
    picks = [keyed.latest_row(prices, keyed.ENTITY, "date", ["floor_native", "tag"]),
             keyed.latest_known(prices, keyed.ENTITY, ["slug", "floor_native", "tag"]), keyed.canonical_ids(prices),
             keyed.first_of_day(prices.withColumnRenamed("date", "ts"), ["chain"], "ts", ["floor_native", "tag"])]
    for df in picks:
        plan = physical(df)
        assert "HashAggregate" in plan
        assert all("Join" in x for x in below(plan, "SortAggregate")), plan


def test_picks_equal_plain_python(prices):
    rows = prices.collect()

    def order(v):
        return (v is not None, v if v is not None else 0)

    keys = {(r["collection_identifier"], r["chain"]) for r in rows}
    got = {(r["collection_identifier"], r["chain"]): r for r in keyed.latest_row(prices, keyed.ENTITY, "date", ["floor_native", "tag"]).collect()}
    known = {(r["collection_identifier"], r["chain"]): r for r in keyed.latest_known(prices, keyed.ENTITY, ["slug", "floor_native", "tag"]).collect()}
    assert set(got) == set(known) == keys
    for k in keys:
        own = [r for r in rows if (r["collection_identifier"], r["chain"]) == k]
        best = max((order(r["date"]), order(r["floor_native"]), (r["tag"] is not None, r["tag"] or "")) for r in own)
        g = got[k]
        assert (order(g["date"]), order(g["floor_native"]), (g["tag"] is not None, g["tag"] or "")) == best
        assert known[k]["date"] == max(r["date"] for r in own if r["date"])
        for c in ("slug", "floor_native", "tag"):
            some = [(order(r["date"]), r[c]) for r in own if r[c] is not None]
            assert known[k][c] == (max(some)[1] if some else None)
    assert keyed.latest_known(prices.filter("false"), keyed.ENTITY, ["tag"]).count() == 0
    canon = {r["slug"]: r for r in keyed.canonical_ids(prices).collect()}
    for slug in {r["slug"] for r in rows}:
        counts = {}
        for r in rows:
            if r["slug"] == slug and r["collection_identifier"] is not None:
                k = (r["collection_identifier"], r["chain"])
                counts[k] = counts.get(k, 0) + 1
        n, k = min((-n, k) for k, n in counts.items())
        assert (canon[slug]["collection_identifier"], canon[slug]["chain"], canon[slug]["cnt"]) == (*k, -n)


@pytest.mark.parametrize("ntz", [False, True])
def test_a_busy_day_spreads_over_chunks(spark, ntz):
    """A third of the rows on one day of one key, a good part of them at one time."""
    rnd = random.Random(5)

    def row(i, hot):
        if not hot:
            return rnd.choice("bcd"), LO + dt.timedelta(days=rnd.randint(0, 30), seconds=rnd.randint(0, 86_399)), i, rnd.random()
        at = dt.timedelta(seconds=40_000) if rnd.random() < 0.3 else dt.timedelta(microseconds=int(rnd.random() ** 4 * 86_400e6))
        return "a", LO + at, i, rnd.random()

    kind = "timestamp_ntz" if ntz else "timestamp"
    left = spark.createDataFrame([row(i, i % 3 == 0) for i in range(6000)] + [(None, LO, -1, 0.0), ("a", None, -2, 0.0)], f"k string, ts {kind}, i int, x double")
    right = spark.createDataFrame([row(i, i % 3 == 0) for i in range(6000)] + [(None, LO, 1, 0.0)], f"k string, ts {kind}, t int, v double")
    got = {r["i"]: (r["asof_ts"], r["v"]) for r in asof.asof_join(left, right, ["k"], "ts", ["v"], "t", sliced=300).collect()}
    points = sorted((r["k"], r["ts"], r["t"], r["v"]) for r in right.collect() if r["k"] is not None)
    rows = left.collect()
    assert len(got) == len(rows)
    for r in rows:
        own = [p for p in points if p[0] == r["k"] and r["ts"] is not None and p[1] <= r["ts"]]
        assert got[r["i"]] == ((own[-1][1], own[-1][3]) if own else (None, None))
    both = left.select("k", F.col("ts").alias("_ts"), F.lit(1).alias("_side"), "i").unionByName(
        right.select("k", F.col("ts").alias("_ts"), F.lit(0).alias("_side"), F.col("t").alias("i")))
    sizes = asof.time_chunks(both, ["k"], 300).groupBy("k", "_chunk").count().filter("k = 'a'").agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 250 and sizes[1] > 60  # of 4,000 rows of that day
    whole = asof.time_chunks(both, ["k"], 10_000).groupBy("k", "_chunk").count().filter("k = 'a'").count()
    assert whole == 2  # the day, and the row without a time


def panel(spark, seed):
    rnd, rows = random.Random(seed), []
    for slug in ("s", "t", "u"):
        for d in range(0, 400):
            if rnd.random() < 0.8:
                for i in range(rnd.choice([1, 1, 2])):
                    rows.append((f"{slug}{i}", slug, "x", dt.date(1969, 10, 1) + dt.timedelta(days=d if slug != "u" else d // 3), 10 + rnd.random() * 3 + (d % 60) / 10,
                                 None if rnd.random() < 0.4 else rnd.random(), 1))
    return spark.createDataFrame(rows, "collection_identifier string, slug string, chain string, date date, floor_native double, floor_usd double, ranking int")


def test_last_days_are_counted_as_bits(spark):
    df = panel(spark, 1)
    rows = df.withColumn("day", S.day_number("date")).collect()
    got = {(r["slug"], r["is_native"]): (r["n"], r["last"], r["prev"]) for r in crosses.last_days(df).collect()}
    for (slug, native), g in got.items():
        days = sorted({r["day"] for r in rows if r["slug"] == slug and r["floor_native" if native else "floor_usd"] is not None})
        assert g == (len(days), days[-1], days[-2])
    assert len(got) == 6
    one = df.filter("slug = 's'").orderBy("date").limit(1)
    assert [r["prev"] for r in crosses.last_days(one).filter("is_native").collect()] == [None]


@pytest.mark.parametrize("seed", range(3))
def test_current_crossovers_are_the_last_of_all(spark, seed):
    df = panel(spark, seed)
    for short, long in ((3, 10), (5, 40)):
        now = crosses.detect_current_crosses(df, short, long, short, long).collect()
        every = crosses.detect_crosses(df, short, long, short, long)
        last = crosses.last_days(df).select("slug", "chain", "is_native", F.date_from_unix_date("last").alias("date"))
        want = every.join(last, ["slug", "chain", "is_native", "date"]).select(*every.columns).collect()
        assert sorted(map(str, now)) == sorted(map(str, want))


def test_current_crossovers_exchange_only_their_window(spark):
    plan = physical(crosses.detect_current_crosses(panel(spark, 1), 3, 10, 3, 10))
    daily = below(plan, "partial_min(floor_usd")
    assert daily and all("Join" in x and re.search(r"date#\d+ > \d{4}-", x) for x in daily), plan
