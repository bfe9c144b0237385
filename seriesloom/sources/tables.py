"""Table scans into a frame, optionally bounded by date."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "month"


def scan(spark: SparkSession, path: str, since: dt.date | None = None, date: str = "date") -> DataFrame:
    """Parquet table; with ``since`` both the month partitions and the date reach the scan."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.filter(F.col(date) >= F.lit(since))
        if MONTH in df.columns:
            df = df.filter(F.col(MONTH) >= F.lit(since.replace(day=1)))
    return df.drop(MONTH)


def scan_proof(df: DataFrame) -> dict[str, list[str]]:
    """What the file scans of a plan skip, one text for each scan: partition_filters, pushed_filters and the columns read."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    marks = {"partition_filters": "PartitionFilters", "pushed_filters": "PushedFilters", "columns": "ReadSchema"}
    return {name: re.findall(rf"^{mark}: (.*)$", plan, re.M) for name, mark in marks.items()}


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, lo: int, hi: int, partitions: int,
              **options: str) -> DataFrame:
    """Table of a live database read in ``partitions`` ranges of a numeric key."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=lo, upperBound=hi, numPartitions=partitions,
        **options).load()
