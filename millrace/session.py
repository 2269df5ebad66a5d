"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables; Spark resolves the path, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or one of our own where there is but this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="millrace-", dir=os.environ.get("TMPDIR", "/tmp")))
        found = sc.getCheckpointDir()
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Bytes of rows that go to a Python worker at once, where the session does not say so itself.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of about `BATCH_BYTES` for Python workers, from then on in the session, where it does not say so itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def in_batches(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow in batches of about `BATCH_BYTES`, whatever the length of rows; a longer row goes alone.

    The bound holds for the session from then on. Spark's own is 64 MB, which each task holds several times over.
    """
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def remove(spark: SparkSession, place: str) -> None:
    """Delete a folder of our own, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
