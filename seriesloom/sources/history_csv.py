"""Price history from a folder of CSV files, one per contract, columns by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom import schemas
from seriesloom.functions import scalars as S


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """All lines with the contract address taken from the file name; header lines are skipped. A line whose number of
    fields differs from the schema's is kept in ``_corrupt_record``, for which all fields have to be parsed."""
    lines = spark.read.schema(f"{schemas.CSV_HISTORY}, _corrupt_record string").option("header", True).option("enforceSchema", True) \
                 .option("columnPruning", False) \
                 .option("pathGlobFilter", "*.csv").csv(folder)
    return lines.withColumn("contract_address", F.regexp_replace("_metadata.file_name", r"\.csv$", ""))


def history_rows(lines: DataFrame) -> DataFrame:
    """Panel rows with ``outcome``: usable, or error where the timestamp cannot be read or the line ends before the price."""
    short = F.col("_corrupt_record").isNotNull() & F.col("floor_native").isNull()
    rows = lines.select("collection_identifier", "contract_address", F.lit(None).cast("string").alias("slug"),
                        S.offset_local_date("ts").alias("date"), S.to_number("floor_native").alias("floor_native"), "chain", short.alias("_short"))
    good = F.col("date").isNotNull() & ~F.col("_short")
    return rows.withColumn("outcome", F.when(good, "usable").otherwise("error")).drop("_short")
