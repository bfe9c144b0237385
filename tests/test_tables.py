"""Keyed tables and sources: idempotency, conservation, payload shapes, landed files."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from seriesloom import schemas
from seriesloom.operators import crosses as X
from seriesloom.sinks import keyed_tables as KT
from seriesloom.sources import history_csv, tables
from seriesloom.sources import payloads as P
from seriesloom.streaming.landing import ingest_landed

ROWS = "k string, date date, v int"


def rows(spark, *items):
    return spark.createDataFrame([(k, dt.date(2024, m, d), v) for k, m, d, v in items], ROWS)


def content(spark, path):
    return sorted((r.k, r.date, r.v) for r in tables.scan(spark, path).collect())


def test_append_twice_equals_once(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = rows(spark, ("a", 1, 1, 1), ("a", 1, 1, 2), ("b", 2, 3, 3))
    KT.append_new(batch, path, ["k", "date"])
    once = content(spark, path)
    KT.append_new(batch, path, ["k", "date"])
    assert content(spark, path) == once and [r[2] for r in once] == [1, 3]
    KT.append_new(rows(spark, ("a", 1, 1, 9), ("c", 2, 3, 4)), path, ["k", "date"])
    assert [r[2] for r in content(spark, path)] == [1, 3, 4]


def test_null_keys_never_match(spark):
    b = spark.createDataFrame([(None, 1), (None, 1), ("a", 1), ("a", 2)], "k string, v int")
    assert KT.new_rows(b.filter("k IS NULL"), b, ["k"]).count() == 3
    same = b.unionByName(b.filter("v = 2"))
    assert tuple(KT.insert_counts(b.filter("k IS NULL"), same, ["k"]).first()) == (5, 3, 2)
    assert tuple(KT.insert_counts(b, b.limit(0), ["k"]).first()) == (0, 0, 0)


def test_run_report(spark):
    t = spark.createDataFrame([("a", "usable"), ("a", "usable"), ("b", "usable"), ("c", "error"), ("d", "other_date")], "k string, outcome string")
    got = {r.outcome: r.n for r in KT.run_report(t, t.filter("k = 'b'"), ["k"]).collect()}
    assert got == {"inserted": 1, "skipped": 2, "error": 1, "other_date": 1}


def test_upsert_replaces_only_its_months(spark, tmp_path):
    path = str(tmp_path / "t")
    KT.append_new(rows(spark, ("a", 1, 1, 1), ("b", 1, 2, 2), ("c", 3, 1, 3)), path, ["k", "date"])
    before = sorted(str(p) for p in (tmp_path / "t").glob("month=2024-03-01/*.parquet"))
    KT.upsert(rows(spark, ("a", 1, 1, 10), ("d", 1, 5, 4)), path, ["k", "date"], "v")
    assert [(r[0], r[2]) for r in content(spark, path)] == [("a", 10), ("b", 2), ("c", 3), ("d", 4)]
    assert sorted(str(p) for p in (tmp_path / "t").glob("month=2024-03-01/*.parquet")) == before
    KT.upsert(rows(spark, ("a", 1, 1, 10), ("d", 1, 5, 4)), path, ["k", "date"], "v")
    assert len(content(spark, path)) == 4


def test_archive_move_loses_no_row(spark, tmp_path):
    main, archive = str(tmp_path / "main"), str(tmp_path / "archive")
    data = rows(spark, *[(f"k{m}{d}", m, d, m * d) for m in range(1, 7) for d in (1, 15, 28)])
    KT.append_new(data, main, ["k", "date"])
    schema = data.schema
    count, cutoff = KT.archive_move(spark, main, archive, schema, ["k", "date"], dt.date(2024, 4, 20), days=10)
    assert cutoff == dt.date(2024, 4, 10)
    kept, moved = content(spark, main), content(spark, archive)
    assert count == len(moved) == 10 and all(r[1] < cutoff for r in moved) and all(r[1] >= cutoff for r in kept)
    assert sorted(kept + moved) == sorted((r.k, r.date, r.v) for r in data.collect())
    again, _ = KT.archive_move(spark, main, archive, schema, ["k", "date"], dt.date(2024, 4, 20), days=10)
    assert again == 0 and content(spark, main) == kept and content(spark, archive) == moved


def test_declare_and_checks(spark, tmp_path):
    path = str(tmp_path / "signals")
    KT.declare(spark, path, schemas.schema("ml_signals"))
    KT.declare(spark, path, schemas.schema("ml_signals"))
    got = {r.table_name: (r.present, r.n) for r in KT.table_checks(spark, {"a": path, "b": str(tmp_path / "no")}).collect()}
    assert got == {"a": (True, 0), "b": (False, None)}
    for name in schemas.TABLES:
        assert len(schemas.schema(name)) > 3


def test_new_by_all_treats_null_as_equal(spark):
    s = spark.createDataFrame([("a", None)], "id string, name string")
    b = spark.createDataFrame([("a", None), ("a", "x"), ("a", "x"), ("b", None)], "id string, name string")
    assert sorted(tuple(r) for r in KT.new_by_all(s, b, ["id", "name"]).collect()) == [("a", "x"), ("b", None)]


def test_backfill_keeps_known_values(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", None)], "k string, ranking int")
    src = spark.createDataFrame([("a", 7), ("b", 8)], "k string, ranking int")
    assert {r.k: r.ranking for r in KT.backfilled(df, src, ["k"], "ranking").collect()} == {"a": 1, "b": 8, "c": None}
    assert {r.k: r.ranking for r in KT.backfilled(df.drop("ranking"), src, ["k"], "ranking").collect()} == {"a": 7, "b": 8, "c": None}


def test_date_bound_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    KT.write_panel(rows(spark, ("a", 1, 1, 1), ("a", 2, 1, 2), ("a", 3, 5, 3)), path, ["k"])
    df = tables.scan(spark, path, dt.date(2024, 2, 15))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [r.v for r in df.collect()] == [3] and "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(date" in plan


def item(cid, ts, price=1.5, **extra):
    return {"providerCollectionId": cid, "slug": extra.pop("slug", cid), "blockchain": extra.pop("chain", "base"), "nativeCurrency": "",
            "types": extra.pop("types", []), "ranking": 0,
            "stats": {"floorInfo": {"latestFloorTs": ts, "currentFloorNative": price, "tokenInfo": {"contract": ""}}}, **extra}


TS = 1706745600  # 2024-02-01 00:00 UTC


def test_payload_shapes(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.json").write_text(json.dumps([item("a", TS), item("b", TS * 1000 + 3_660_000)], indent=1))
    (d / "b.json").write_text(json.dumps({"data": [item("c", None, types=["art", "game"])]}))
    (d / "c.json").write_text(json.dumps({"error": "no"}))
    items = P.read_items(spark, str(d), schemas.SNAPSHOT_ITEM)
    got = {r.collection_identifier: r for r in P.with_date_outcome(P.price_rows(items), dt.date(2024, 2, 1)).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].date == dt.date(2024, 2, 1) and got["b"].latest_floor_timestamp == "01:01" and got["a"].outcome == "usable"
    assert got["c"].date is None and got["c"].outcome == "other_date"
    assert got["a"].ranking == 0 and got["a"].chain_currency_symbol is None and got["a"].contract_address is None
    assert [r.file.endswith("c.json") for r in P.rejected_files(spark, str(d), schemas.SNAPSHOT_ITEM).collect()] == [True]
    meta = {r.collection_identifier: r.categories for r in P.metadata_rows(items).collect()}
    assert meta == {"a": None, "b": None, "c": "art, game"}


def test_metadata_needs_id_and_chain(spark):
    text = [json.dumps(item("", TS)), json.dumps(item("x", TS, chain="")), json.dumps(item("y", TS))]
    df = spark.createDataFrame([(t,) for t in text], "t string").select(F.from_json("t", schemas.SNAPSHOT_ITEM).alias("item"))
    assert sorted(r.outcome for r in P.metadata_rows(df).collect()) == ["error", "error", "usable"]


def test_history_csv(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    (d / "0xabc.csv").write_text("chain,id,x,ts,price\nbase,c1,u,2024-01-01 23:30:00-0500,1.5\nbase,c1,u,2024-01-02 00:10:00+05:30,n/a\nbase,c1,u,yesterday,2\n")
    got = history_csv.history_rows(history_csv.read_history(spark, str(d))).collect()
    assert sorted((r.date or dt.date(1, 1, 1), r.floor_native, r.outcome) for r in got) == [
        (dt.date(1, 1, 1), 2.0, "error"), (dt.date(2024, 1, 1), 1.5, "usable"), (dt.date(2024, 1, 2), None, "usable")]
    assert {r.contract_address for r in got} == {"0xabc"}


def test_replies(spark):
    texts = [("ok", 'Sure:\n{"hype_score": 80,\n "trend": "UP"}\nbye'), ("none", "nothing"), ("bad", "{oops} {"), ("two", '{"hype_score": 1} and {"x": 2}')]
    df = spark.createDataFrame(texts, "date string, t string")
    got = {r.date: (r.hype_score, r.sentiment, r.trend, r.keywords) for r in P.market_replies(df, "t", "date").collect()}
    assert got == {"ok": (80, "NEUTRAL", "UP", "")}
    one = spark.createDataFrame([("a", '{"sentiment_score": 7}'), ("b", 'so {"sentiment_score": 7}')], "k string, t string")
    r = P.entity_replies(one, "t", ["k"]).collect()
    assert [(x.k, x.sentiment_score, x.community_engagement, x.sentiment_category) for x in r] == [("a", 7, 5, "NEUTRAL")]


def test_index_payload(spark):
    texts = ['{"data":[{"value":"55","value_classification":"Greed","timestamp":"1"},{"value":"1"}]}', '{"data":[]}', '{"data":[{"value":"x","value_classification":"y"}]}', '{}']
    df = spark.createDataFrame([(t, dt.datetime(2024, 1, 1, 5, 40)) for t in texts], "t string, at timestamp").select(
        F.from_json("t", schemas.INDEX_PAYLOAD)["data"].alias("data"), "at")
    got = P.index_rows(df, F.col("at")).collect()
    assert [(r.date.hour, r.date.minute, r.value, r.value_classification) for r in got] == [(5, 0, 55.0, "Greed")]


def test_landed_files_are_ingested_once(spark, tmp_path):
    landing, table, cp = tmp_path / "landing", str(tmp_path / "table"), str(tmp_path / "cp")
    landing.mkdir()
    (landing / "1.json").write_text("\n".join(json.dumps(x) for x in (item("a", TS), item("b", TS), item("old", TS - 86400 * 3))))
    ingest_landed(spark, str(landing), table, cp, dt.date(2024, 2, 1))
    (landing / "2.json").write_text("\n".join(json.dumps(x) for x in (item("a", TS, 9.0), item("c", TS), item("c", TS))))
    ingest_landed(spark, str(landing), table, cp, dt.date(2024, 2, 1))
    ingest_landed(spark, str(landing), table, cp, dt.date(2024, 2, 1))
    got = sorted((r.collection_identifier, r.floor_native) for r in tables.scan(spark, table).collect())
    assert got == [("a", 1.5), ("b", 1.5), ("c", 1.5)]


def test_raw_payload_is_kept_by_date(spark, tmp_path):
    P.keep_raw(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "raw"), dt.date(2024, 1, 2))
    assert spark.read.json(str(tmp_path / "raw")).first().date == dt.date(2024, 1, 2)


def test_delivery_flags(spark):
    day = dt.date(2024, 1, 1)
    c = spark.createDataFrame([("a", "eth", day, True, 20, 50, False, False), ("a", "sol", day, True, 20, 50, False, False),
                               ("a", "eth", day, False, 20, 50, False, False), ("b", "eth", day, True, 20, 50, False, True)],
                              "slug string, chain string, date date, is_native boolean, ma_short_period int, ma_long_period int, "
                              "telegram_sent boolean, x_sent boolean")
    done = c.filter("slug = 'a' AND chain = 'eth' AND is_native")
    got = {(r.slug, r.chain, r.is_native): (r.telegram_sent, r.x_sent) for r in X.mark_delivered(c, done, "x_sent").collect()}
    assert got == {("a", "eth", True): (False, True), ("a", "sol", True): (False, False), ("a", "eth", False): (False, False),
                   ("b", "eth", True): (False, True)}


@pytest.mark.parametrize("value,date,clock", [(TS, "2024-02-01", "00:00"), (TS * 1000 + 60_000, "2024-02-01", "00:01"), (None, None, None),
                                              (-1, "1969-12-31", "23:59"), (999_999_999_999, None, None)])
def test_epochs(spark, value, date, clock):
    from seriesloom.functions import scalars as S
    r = spark.createDataFrame([(value,)], "e bigint").select(S.epoch_date("e").alias("d"), S.epoch_clock("e").alias("c")).first()
    assert (r.d.isoformat() if r.d else None, r.c) == (date, clock)


def test_upsert_keeps_rows_without_a_date(spark, tmp_path):
    path = str(tmp_path / "nodate")
    for k in ("a", "b"):
        KT.upsert(spark.createDataFrame([(k, None, 1)], ROWS), path, ["k", "date"], "v")
    KT.upsert(spark.createDataFrame([("b", None, 5)], ROWS), path, ["k", "date"], "v")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 5)]


def test_archive_leaves_rows_without_a_date_and_no_staged_folder(spark, tmp_path):
    main, archive = str(tmp_path / "m"), str(tmp_path / "a")
    df = rows(spark, ("a", 1, 1, 1), ("b", 4, 15, 2)).union(spark.createDataFrame([("n", None, 3)], ROWS))
    KT.upsert(df, main, ["k", "date"], "v")
    assert KT.archive_move(spark, main, archive, df.schema, ["k", "date"], dt.date(2024, 4, 20), days=10)[0] == 1
    assert sorted(r.k for r in spark.read.parquet(main).collect()) == ["b", "n"]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [f for f in os.listdir(folder) if f.startswith("staged-")]


def test_a_new_panel_replaces_all_months_of_the_old_one(spark, tmp_path):
    path = str(tmp_path / "panel2")
    KT.write_panel(rows(spark, ("a", 1, 1, 1), ("a", 2, 1, 2)), path, ["k"])
    KT.write_panel(rows(spark, ("a", 2, 1, 3)), path, ["k"])
    assert content(spark, path) == [("a", dt.date(2024, 2, 1), 3)]


def test_landed_rows_without_a_whole_key_are_left_out(spark, tmp_path):
    landing, table, cp = tmp_path / "landing2", str(tmp_path / "table2"), str(tmp_path / "cp2")
    landing.mkdir()
    nameless = {**item("x", TS), "collectionIdentifier": None, "collection_identifier": None, "identifier": None, "id": None}
    (landing / "1.json").write_text("\n".join(json.dumps(x) for x in (item("a", TS), nameless)))
    ingest_landed(spark, str(landing), table, cp, None)
    assert all(r.collection_identifier is not None and r.chain is not None for r in spark.read.parquet(table).collect())


def test_rejected_payloads_are_told(spark):
    df = spark.createDataFrame([(1, '{"hype_score": 50}'), (2, "no object")], "k int, t string")
    for got in (P.market_replies(df, "t", "k", outcomes=True), P.entity_replies(df, "t", ["k"], outcomes=True)):
        assert sorted(r.outcome for r in got.collect()) == ["error", "usable"]
    assert P.market_replies(df, "t", "k").count() == 1
