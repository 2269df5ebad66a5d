"""Incremental import and resumption: files that arrive, and rows that an earlier run has finished."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.sources import assets

_FILES = T.StructType().add("path", T.StringType()).add("modificationTime", T.TimestampType()).add("length", T.LongType()).add("content", T.BinaryType())


def new_files(spark: SparkSession, folder: str, *, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the files that come to lie in a folder."""
    rows = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select("path", F.col("length").alias("size"), "content")


def import_stream(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append the text and application files that arrive to an asset table; ends when all are in.

    The checkpoint remembers the files: a stream that is started again imports only what is new.
    """
    rows = assets.import_texts(new_files(spark, folder))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def signature(*settings: Column) -> Column:
    """What a result depends on, as a digest; equal settings give equal digests."""
    return F.sha2(F.to_json(F.struct(*settings)), 256)


def pending(items: DataFrame, done: DataFrame, key: str, sign: str = "signature") -> DataFrame:
    """Items that no completed row has with the same signature."""
    return items.join(done.select(key, sign), [key, sign], "left_anti")


def resume_stage(existing: Column, stages: tuple[str, ...]) -> Column:
    """The first stage whose output is not in the list `existing`; null when all are."""
    found = F.lit(None).cast("string")
    for stage in reversed(stages):
        found = F.when(~F.array_contains(existing, stage), stage).otherwise(found)
    return found
