"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and all runs in one process, a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table and reads it back, so that loops don't carry lineage and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Grown:
    """A table in the shared folder that rounds of a loop append to; nothing that is written is written again."""

    def __init__(self, spark: SparkSession, schema: StructType, tag: str) -> None:
        self.spark, self.schema, self.path = spark, schema, f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"

    def add(self, rows: DataFrame) -> DataFrame:
        """Appends rows and gives back just these, read from where they were written."""
        part = f"{self.path}/round={uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(part)
        return self.spark.read.schema(self.schema).parquet(part)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
