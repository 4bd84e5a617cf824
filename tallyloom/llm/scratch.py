"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans.shared import shared_folder


class Scratch:
    """Tables of one run, below the shared folder.

    A written table cuts the lineage: executors that are lost later cost only
    the tasks after it.  `drop` frees a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Lets the session's files of exchanges that nothing refers to any more go now; they go with the driver's garbage."""
        gc.collect()
        self.spark._jvm.System.gc()
