"""Keyed writes on Parquet tables: insert if absent, upsert, archive move, backfill.

Each rule is a function on frames; the write helpers apply it to a table partitioned by month
and touch only the months of the batch. A rewritten month is staged in the shared folder first,
so the table is never read and overwritten by the same job, and a lost executor only repeats tasks.
"""

from __future__ import annotations

import datetime as dt
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.keyed import first_row, last_row
from seriesloom.session import shared_folder

MONTH = "month"


# --- rules ----------------------------------------------------------------------------------

def insert_counts(stored: DataFrame, batch: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """total, inserted and skipped rows of an insert-if-absent, optionally per ``by``, which is part
    of the key. A key with a NULL part never equals another, as in a unique index, so every such row
    is inserted; of any other key the first row is, unless the key is stored."""
    known = stored.select(*keys).distinct().withColumn("_stored", F.lit(True))
    copies = batch.groupBy(*keys).agg(F.count("*").alias("_n")).join(known, keys, "left")
    inserted = F.when(~_whole(keys), F.col("_n")).when(F.col("_stored").isNull(), 1).otherwise(0)
    out = copies.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
                                  F.coalesce(F.sum(inserted), F.lit(0)).alias("inserted"))
    return out.withColumn("skipped", F.col("total") - F.col("inserted"))


def run_report(tagged: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of an ingest run per outcome: inserted, skipped (key known), and the outcomes other than
    usable that the projection gave."""
    usable = tagged.filter(F.col("outcome") == "usable")
    counts = insert_counts(stored, usable, keys)
    done = counts.select(F.explode(F.create_map(F.lit("inserted"), "inserted", F.lit("skipped"), "skipped")).alias("outcome", "n"))
    return done.unionByName(outcome_counts(tagged.filter(F.col("outcome") != "usable")))


def _whole(keys: list[str]) -> Column:
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return whole


def new_rows(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows to append: the first of each key in the batch that is not stored yet."""
    order = order or [c for c in batch.columns if c not in keys]
    whole = _whole(keys)
    fresh = batch.filter(whole).join(stored.select(*keys), keys, "left_anti")  # a NULL part never matches
    return first_row(fresh, keys, order).unionByName(batch.filter(~whole))


def new_by_all(stored: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """Batch rows no stored row equals on ``columns``; NULL equals NULL."""
    s = stored.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return batch.join(s, same, "left_anti").dropDuplicates(columns)


def merged(stored: DataFrame, batch: DataFrame, keys: list[str], order: str, tie: list[str] = ()) -> DataFrame:
    """Insert or replace: the newest row per key of the table and the batch (batch wins ties)."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(batch.withColumn("_side", F.lit(1)))
    return last_row(both, keys, ["_side", order, *tie]).drop("_side")


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def archive_split(main: DataFrame, archive: DataFrame, keys: list[str], run_date: dt.date, days: int = 365,
                  date: str = "date") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that stay, rows to add to the archive, one-row report) for rows older than ``days``."""
    cutoff = run_date - dt.timedelta(days=days)
    old = F.col(date) < F.lit(cutoff)
    moving = main.filter(old)
    report = moving.agg(F.count("*").alias("archived_count")).withColumn("cutoff_date", F.lit(cutoff))
    return main.filter(~old), new_rows(archive, moving, keys), report


def backfilled(df: DataFrame, source: DataFrame, keys: list[str], column: str, pick: Column | None = None) -> DataFrame:
    """Add ``column`` where absent and fill its NULLs from ``source`` by key."""
    if column not in df.columns:
        df = df.withColumn(column, F.lit(None).cast(source.schema[column].dataType))
    values = source.groupBy(*keys).agg((pick if pick is not None else F.max(column)).alias("_value"))
    return df.join(values, keys, "left").withColumn(column, F.coalesce(column, "_value")).drop("_value")


def stamped_signals(signals: DataFrame, run_date: dt.date, horizon: int, threshold: float) -> DataFrame:
    """Signals with the run date and the shared as-of date (the newest of the batch)."""
    return (signals.withColumn("as_of_date", signals.agg(F.max("date")).scalar())
                   .withColumn("run_date", F.lit(run_date)).withColumn("horizon_days", F.lit(horizon))
                   .withColumn("threshold", F.lit(threshold)))


def outcome_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("outcome").agg(F.count("*").alias("n"))


# --- tables ---------------------------------------------------------------------------------

def _path_exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _files(spark, path)
    return fs.exists(jvm_path)


def declare(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Create an empty table unless it is there.

    The empty file is appended, so that an append or another declaration that comes between the check and the write loses nothing.
    """
    if not _path_exists(spark, path):
        spark.createDataFrame([], schema).write.mode("append").parquet(path)


def table_checks(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Existence and row count of each table; the counts read no column, which Parquet answers from its footers."""
    out = None
    for name, path in paths.items():
        there = _path_exists(spark, path)
        rows = spark.read.parquet(path).agg(F.count("*").alias("n")) if there else \
            spark.range(1).select(F.lit(None).cast("bigint").alias("n"))
        part = rows.select(F.lit(name).alias("table_name"), F.lit(there).alias("present"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a folder: (file system, path)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _month_folders(spark: SparkSession, path: str) -> dict[dt.date | None, str]:
    """The months of a table by its partition folders; None holds the rows without a date."""
    fs, jvm_path = _files(spark, path)
    if not fs.exists(jvm_path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(jvm_path) if s.isDirectory()]
    values = {n: n.removeprefix(f"{MONTH}=") for n in names if n.startswith(f"{MONTH}=")}
    return {None if v == "__HIVE_DEFAULT_PARTITION__" else dt.date.fromisoformat(v): f"{path}/{n}" for n, v in values.items()}


def _delete(spark: SparkSession, path: str) -> None:
    fs, jvm_path = _files(spark, path)
    fs.delete(jvm_path, True)


def stored_rows(spark: SparkSession, path: str, schema: T.StructType, months: list[dt.date | None] | None = None) -> DataFrame:
    """Rows of a table, or of some months of it; the month None are the rows without a date."""
    if not _path_exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField(MONTH, T.DateType())])).parquet(path)
    if months is not None:
        wanted = F.col(MONTH).isin([m for m in months if m is not None])
        df = df.filter(wanted | F.col(MONTH).isNull() if None in months else wanted)
    return df.select(*schema.names)


def _by_month(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn(MONTH, F.trunc(date, "month"))


@contextmanager
def _staged(df: DataFrame, date: str):
    """``df`` by month in the shared folder, computed once: (frame, months). Removed at the end."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    try:
        _by_month(df, date).write.partitionBy(MONTH).parquet(folder)
        months = list(_month_folders(spark, folder))
        yield stored_rows(spark, folder, df.schema), months
    finally:
        _delete(spark, folder)


def append_new(batch: DataFrame, path: str, keys: list[str], date: str = "date", order: list[str] | None = None) -> None:
    """Append the rows whose key is not stored; only the batch's months are read."""
    spark = batch.sparkSession
    with _staged(batch, date) as (rows, months):
        if months:
            stored = stored_rows(spark, path, batch.schema, months)
            _by_month(new_rows(stored, rows, keys, order), date).write.mode("append").partitionBy(MONTH).parquet(path)


def _replace_months(rows: DataFrame, path: str, date: str) -> None:
    """Swap in the months of ``rows``, which are staged and do not depend on the table."""
    (_by_month(rows, date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(MONTH).parquet(path))


def upsert(batch: DataFrame, path: str, keys: list[str], order: str, date: str = "date") -> None:
    """Insert or replace by key, rewriting only the months of the batch. ``date`` is part of the key."""
    spark = batch.sparkSession
    with _staged(batch, date) as (rows, months):
        if months:
            stored = stored_rows(spark, path, batch.schema, months)
            with _staged(merged(stored, rows, keys, order), date) as (result, _):
                _replace_months(result, path, date)


def archive_move(spark: SparkSession, main: str, archive: str, schema: T.StructType, keys: list[str],
                 run_date: dt.date, days: int = 365, date: str = "date"):
    """Move old rows; they are in the archive before they leave the main table. Returns (count, cutoff).

    The months come from the table's folders. Rows without a date stay where they are.
    """
    cutoff = run_date - dt.timedelta(days=days)
    folders = {m: f for m, f in _month_folders(spark, main).items() if m is not None and m <= cutoff}
    table = stored_rows(spark, main, schema, list(folders))
    keep, moving, report = archive_split(table, stored_rows(spark, archive, schema), keys, run_date, days, date)
    count = report.first()["archived_count"]
    if count:
        append_new(moving, archive, keys, date)
        with _staged(keep, date) as (kept, left):
            if left:
                _replace_months(kept, main, date)
        for month, folder in folders.items():
            if month not in left:
                _delete(spark, folder)
    return count, cutoff


def write_panel(df: DataFrame, path: str, keys: list[str], date: str = "date") -> None:
    """Store a panel by month in place of the one before, each file sorted by entity and date.

    Rows are dealt by ranges of (month, entity), so a month has few files and a large one several.
    """
    (_by_month(df, date).repartitionByRange(MONTH, *keys).sortWithinPartitions(MONTH, *keys, date)
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(MONTH).parquet(path))
