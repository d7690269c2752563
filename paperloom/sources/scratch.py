"""Tables in the shared folder of a session that jobs need only while they run."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_UNSET = "file:///tmp/checkpoints"


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share; it goes when the driver's JVM ends.

    Where the setting is missing SCRATCH_UNSET takes its place, but only where all of Spark is one process; on a
    cluster a folder of one machine would not do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"{(base or SCRATCH_UNSET).rstrip('/')}/{spark.sparkContext.applicationId}"
    files, target = _filesystem(spark, own)
    files.mkdirs(target)
    files.deleteOnExit(target)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Tables in the shared folder that a job needs only while it runs: drop() removes them all."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back.

        It cuts the lineage: a lost executor costs a reread, never a recomputation of what came before.
        """
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            files, target = _filesystem(self.spark, self.paths.pop())
            files.delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A scratch table that stays until the application ends, for what a returned result reads."""
    return Scratch(df.sparkSession).table(df, name)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application. Call it once the results are written, to free the space earlier."""
    files, target = _filesystem(spark, scratch_path(spark, "x").rsplit("/", 1)[0])
    files.delete(target, True)
