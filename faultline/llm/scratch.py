"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

A stage table cuts lineage: a lost executor re-reads Parquet instead of recomputing the
plan. The folder is read from the session; one is set only where none is configured.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import shared_dir


class Scratch:
    """Named tables of one operator call."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        """df, written and read again; rows lie in folders by the columns ``by``."""
        path = f"{self.root}/{name}"
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path) if by else df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads, and let Spark remove the shuffle files behind them.

        Spark does that once the driver has collected the plans that own them; a driver with
        much memory would not get round to it while the files pile up.
        """
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        self.spark._jvm.System.gc()
