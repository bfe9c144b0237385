"""Incremental ingest of landed snapshot files, once per key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom import schemas
from seriesloom.sinks.keyed_tables import append_new
from seriesloom.sources.payloads import price_rows, with_date_outcome

PRICE_KEY = ["collection_identifier", "chain", "date"]


def ingest_landed(spark: SparkSession, landing: str, table: str, checkpoint: str, run_date: dt.date | None = None) -> None:
    """Read the files that arrived since the last run (one item a line) and append new keys.

    Rows without a whole key are left out, as nothing could tell a replayed one. The checkpoint remembers the files; the anti-join on the key makes a repeated batch harmless,
    so a restart in between neither loses nor doubles a row.
    """
    item = schemas._struct(schemas.SNAPSHOT_ITEM[len("struct<"):-1])
    lines = spark.readStream.schema(item).json(landing)
    rows = price_rows(lines.select(F.struct(*item.names).alias("item"))).dropna(subset=PRICE_KEY)
    if run_date is not None:
        rows = with_date_outcome(rows, run_date).filter("outcome = 'usable'").drop("outcome")

    def write(batch: DataFrame, _batch_id: int) -> None:
        append_new(batch, table, PRICE_KEY, "date", ["latest_floor_timestamp", "floor_native"])

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
                .trigger(availableNow=True).start()
    query.awaitTermination()
