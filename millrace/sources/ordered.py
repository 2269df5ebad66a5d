"""Scans with a row number that is the same on every read, and reads of the ends of files."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import materialize


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset): how many rows lie in the files before each file of a Parquet table, by path; gapless.

    Row counts come from footers, as no column is read. Files are dealt out by ranges of their paths: each range is summed
    up by its own task, and only the totals of ranges, a row each, are summed in one place.
    """
    rows = spark.read.parquet(path)
    counts = rows.groupBy(rows.metadataColumn("_metadata")["file_path"].alias("file")).agg(F.count(F.lit(1)).alias("n"))
    dealt = materialize(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").withColumn("range", F.spark_partition_id()))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    own = dealt.withColumn("inside", F.coalesce(F.sum("n").over(before("range", "file")), F.lit(0)))
    return own.join(F.broadcast(totals), "range").select("file", (F.col("begin") + F.col("inside")).alias("offset"))


#: Files whose offsets are sent to all tasks, of 16 bytes each; of more, rows are shuffled by file.
MOST_BROADCAST = 1_000_000


def scan_in_order(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None, *, into: str = "row_idx") -> DataFrame:
    """Rows of a Parquet table with `into`, their number from 0 in order of files' paths and of rows in them.

    A number belongs to a row whatever filter and columns are asked for: filters still reach the scan, and Spark tells the
    place in the file of each row that passes. No rows are sorted or shuffled; whoever wants them in order sorts by number.
    """
    rows = spark.read.parquet(path)
    meta = rows.metadataColumn("_metadata")
    columns = columns or rows.columns
    offsets = materialize(file_offsets(spark, path).select(F.xxhash64("file").alias("file"), "offset"))
    n, distinct = offsets.agg(F.count(F.lit(1)), F.count_distinct("file")).first()
    if n != distinct:
        raise ValueError("two files' paths have one hash; name the files otherwise")
    picked = (rows if where is None else rows.where(where)).select(*(F.col(f"`{c}`") for c in columns), F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("place"))
    found = picked.join(F.broadcast(offsets) if n <= MOST_BROADCAST else offsets, "file")
    return found.select(*(F.col(f"`{c}`") for c in columns), (F.col("offset") + F.col("place")).alias(into))


#: How many of the newest files are read, and how many bytes from the end of each.
NEWEST, TAIL = 50, 256 * 1024


def tail(spark: SparkSession, path: str, most: int = TAIL) -> bytes:
    """The last `most` bytes of a file, of any Hadoop file system; nothing before them is read."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getFileStatus(where).getLen()
    stream = files.open(where)
    try:
        stream.seek(max(0, size - most))
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, most)))
    finally:
        stream.close()


def object_under(value: object, key: str) -> dict | None:
    """The first object that stands under `key` at any depth: a level's own before its children's, in order."""
    if isinstance(value, dict):
        if isinstance(value.get(key), dict):
            return value[key]
        value = list(value.values())
    if isinstance(value, list):
        return next((found for x in value if (found := object_under(x, key)) is not None), None)
    return None


def newest_files(spark: SparkSession, folders: list[str], pattern: str = "*.jsonl", most: int = NEWEST) -> list[str]:
    """Paths of the newest files of some folders, the newest first. Files are listed, not read."""
    there = [f for f in folders if (p := spark._jvm.org.apache.hadoop.fs.Path(f)) and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    if not there:
        return []
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(there).select("path", "modificationTime").distinct()
    return [r.path for r in listed.orderBy(F.desc("modificationTime"), F.desc("path")).limit(most).collect()]


def latest_object(spark: SparkSession, folders: list[str], key: str, *, files: int = NEWEST, most: int = TAIL) -> tuple[str, dict] | None:
    """(path, object) of the last line, in the newest files of JSON lines, that has an object under `key` at any depth.

    Files are listed first. The newest is read from its end, and the next one only if it has none: `files` * `most` bytes at
    most in all. A line that is cut off by the limit, or is no JSON, is passed over.
    """
    for path in newest_files(spark, folders, most=files):
        for line in reversed(tail(spark, path, most).decode("utf-8", "replace").splitlines()):
            try:
                found = object_under(json.loads(line), key)
            except (json.JSONDecodeError, RecursionError):
                continue
            if found is not None:
                return path, found
    return None


def objects_under(rows: DataFrame, text: str, key: str, into: str = "found") -> DataFrame:
    """Rows with `into`, the object under `key` at any depth of a column of JSON, as JSON with sorted keys; null without one."""
    import pyarrow as pa

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column(text).to_pylist():
                try:
                    own = object_under(json.loads(raw), key) if raw and key in raw else None
                except (json.JSONDecodeError, RecursionError):
                    own = None
                found.append(None if own is None else json.dumps(own, sort_keys=True, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, into])

    return rows.drop(into).mapInArrow(search, rows.drop(into).schema.add(into, "string"))
