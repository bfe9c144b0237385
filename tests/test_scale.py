"""What large tables need: which rows a query's windows read, and how often rows are exchanged."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seriesloom import catalog
from seriesloom import fixtures as fx
from seriesloom.catalog import q_files
from seriesloom.operators import calendar as C
from seriesloom.operators import features as FE
from seriesloom.operators import keyed as K
from seriesloom.operators import moves as M

catalog.load_all()
DAY0 = dt.date(2001, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def above(df, name):
    """The part of a plan above the first node of that name."""
    return df._jdf.queryExecution().optimizedPlan().toString().split(name)[0]


@pytest.fixture()
def lines(spark, tmp_path):
    """Lines of two suppliers; orders and parts repeat on a day, some are null."""
    rows = [(k % 3 or None, k % 4 or None, 1 + k % 2, k, 1.0 + k, 10.0 * (1 + k), 0.1, dt.datetime(2001, 1, 1 + k % 5 * 3)) for k in range(60)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    return rows, str(tmp_path)


def test_distinct_orders_and_parts_need_no_copies_of_the_rows(spark, lines):
    rows, folder = lines
    panel = fx.panel(spark, folder, "l_suppkey")
    assert "Expand" not in panel._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["slug"], r["date"]): (r["sale_count_24h"], r["unique_owners"], r["total_supply"]) for r in panel.collect()}
    want = {}
    for r in rows:
        want.setdefault((f"S{r[2]}", r[7].date()), []).append(r)
    assert got == {k: (len(v), len({r[0] for r in v} - {None}), len({r[1] for r in v} - {None})) for k, v in want.items()}


def test_carried_values_are_found_on_observed_rows(spark):
    prices = spark.createDataFrame([("a", "x", day(0), 0)], "collection_identifier string, chain string, date date, n int")
    prices = prices.select("*", *[F.lit(1.0).alias(c) if c != "slug" else F.lit("s").alias(c) for c in FE.PRICE_COLUMNS])
    signals = prices.select("collection_identifier", "chain", "date", *[F.lit(1).alias(c) for c in FE.SENTIMENT_COLUMNS])
    out = FE.entity_features(prices, signals, 1).select(*K.ENTITY, "date", "listing_ratio", *FE.XSENT)
    assert "Window" not in above(out, "Generate")


def test_fills_by_rows_count_priced_days_only(spark):
    """A price of day 0, none up to day 20: 8 priced days, and the listing of day 0 is 8 priced rows before day 20."""
    rows = [("a", "x", day(n), price, listed) for n, price, listed in [(0, 1.0, 5.0), (15, None, 9.0), (20, 2.0, None), (21, 2.0, None)]]
    prices = spark.createDataFrame(rows, "collection_identifier string, chain string, date date, floor_native double, listed_count double")
    prices = prices.select("*", F.lit("s").alias("slug"), F.lit(10.0).alias("total_supply"),
                           *[F.lit(None).cast("double").alias(c) for c in FE.PRICE_COLUMNS if c not in ("floor_native", "listed_count", "slug", "total_supply")])
    got = {(r["date"] - DAY0).days: r["listing_ratio"] for r in FE.entity_features(prices, None, 1).collect()}
    assert got == {**{n: 0.5 for n in range(8)}, 20: None, 21: None}


def test_fill_bounded_fills_ahead_of_the_calendar(spark, lines):
    out = catalog.QUERIES["fill_bounded"](spark, lines[1])
    assert "Window" not in above(out, "Generate")
    got = [r["fill_3"] for r in out.where("collection_identifier = 'id-S1'").orderBy("day").collect()]
    assert len(got) == 13 and None not in got


def test_added_days_take_carried_columns(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 3, None, None)], "k string, day int, v double, w double")
    seen = rows.withColumn("s", M.last_seen("v", K.series_window(["k"]), "day"))
    got = C.fill_days(seen, ["k"], carried=["s"]).select("day", M.within(F.col("s"), 2).alias("v"), "w").orderBy("day").collect()
    assert [tuple(r) for r in got] == [(0, 1.0, 2.0), (1, 1.0, None), (2, 1.0, None), (3, None, None)]


def test_labelled_rows_are_computed_once(spark, lines):
    out = catalog.QUERIES["training_rows_until"](spark, lines[1])
    assert "l_shipdate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_daily_runs_compute_the_price_rows_once(spark, lines, monkeypatch):
    orders = [(k, "FOP"[k % 3], 10.0 + k, dt.datetime(2001, 1, 1) + dt.timedelta(days=k)) for k in range(20)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{lines[1]}/orders.parquet")
    made, real = [], fx.panel

    def panel(*args, **kw):
        made.append(args)
        return real(*args, **kw)

    def begun(rows, *args, **kw):
        raise InterruptedError

    monkeypatch.setattr(fx, "panel", panel)
    monkeypatch.setattr(q_files.daily, "train_run", begun)
    with pytest.raises(InterruptedError):
        q_files.daily_runs(spark, lines[1])
    assert len(made) == 1


def test_many_snapshot_files_are_written_and_listed_cheaply(spark, tmp_path, monkeypatch):
    # One file a block is what the query counts; a checksum file beside each and a listing task for each folder are not.
    events = spark.range(4_000).select(
        F.col("id").alias("event_id"), (F.col("id") % 30).alias("user_id"), F.lit("view").alias("event_type"), F.lit("{}").alias("props"),
        F.col("id").cast("double").alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    folders, real, group = [], q_files.P.snapshot_items, f"listing-{tmp_path}"

    def items(session, folder):
        at = Path(folder.removeprefix("file:"))
        folders.append(([x for x in at.rglob("*.txt") if not x.name.startswith(".")], list(at.rglob(".*.crc"))))
        session.sparkContext.setJobGroup(group, "listing")
        read = real(session, folder)
        session.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return read

    monkeypatch.setattr(q_files.P, "snapshot_items", items)
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    found = {r["file"]: (r["outcome"], r["n"]) for r in q_files.snapshot_files(spark, str(tmp_path)).collect()}
    assert found == {k: (("item", 100) if k % 5 < 2 else ("empty" if k % 5 == 4 else "rejected", 1)) for k in range(40)}
    (files, checksums), = folders
    assert len(files) == 40 and not checksums
    told = spark.sparkContext.statusTracker()
    tasks = [told.getStageInfo(s).numTasks for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= int(spark.conf.get("spark.sql.shuffle.partitions")) < 40
    assert spark.conf.get(setting) == before
