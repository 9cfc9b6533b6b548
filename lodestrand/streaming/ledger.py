"""The ledger as a stream: re-sent rows dropped within a watermark, and windowed counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.sources.scratch import folder


def source(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A file stream over a table's Parquet files; `path` may be one file or a folder of them."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", "*.parquet").parquet(path)


def once(stream: DataFrame, tag: str) -> DataFrame:
    """Runs a stream over all that is there into a table, and reads the table; a restart goes on from its checkpoint."""
    spark = stream.sparkSession
    at = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def distinct_rows(stream: DataFrame, key: list[str], time: str, late: str = "2 days") -> DataFrame:
    """Rows without those whose key came before, as long as the watermark keeps the key."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, time: str, width: str, late: str, by: list[str], value: str) -> DataFrame:
    """(start, by..., n, total) of tumbling windows that the watermark has closed."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("window.start").alias("start"), *by, "n", "total")
