"""A versioned dataset on plain Parquet: a folder for each version, small tables of versions and tags.

Each commit writes its data to a folder of its own below `root/data` and then claims the next number: `root/log/<number>.json`
is written under another name, whole, and then put in place, which only one writer can do: by a hard link on this machine's
file systems, elsewhere by a rename that fails where the name is taken. That holds for file systems whose rename is atomic
(HDFS, ABFS, mounted disks), not for object stores without one (S3). `root/tags` has a row for each time a tag was set, so the
last row counts. All paths go through Hadoop.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import remove

PIECE = r"[^0-9A-Za-z._-]+"


class UpdateError(ValueError):
    """An update that does not fit the table; nothing was written."""


def tag_part(value: Column) -> Column:
    """Runs of other characters become _, the ends lose ._-, and what is then empty is `default`."""
    cleaned = F.regexp_replace(F.regexp_replace(value, PIECE, "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("default"))


def version_tag(*parts: Column, at: Column) -> Column:
    """The cleaned parts and a time, joined by dots; null and empty parts are left out."""
    kept = [F.when((p != "") & p.isNotNull(), tag_part(p)) for p in parts]
    return F.concat_ws(".", *kept, F.date_format(at, "yyyyMMdd_HHmmss"))


class Dataset:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _rows(self, name: str, ddl: str) -> DataFrame:
        path = self._path(name)
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}") if self._files(path).exists(path) else self.spark.createDataFrame([], ddl)

    def versions(self) -> DataFrame:
        path = self._path("log")
        ddl = "version long, operation string, folder string"
        return self.spark.read.schema(ddl).json(f"{self.root}/log") if self._files(path).exists(path) else self.spark.createDataFrame([], ddl)

    def latest(self) -> int:
        """The newest version, or 0 of a dataset without any."""
        return self.versions().agg(F.max("version")).first()[0] or 0

    def tags(self) -> DataFrame:
        """(tag, version) as last set."""
        rows = self._rows("tags", "tag string, version long, n long")
        return rows.groupBy("tag").agg(F.max_by("version", "n").alias("version"))

    def tag(self, name: str, version: int | None = None) -> int:
        """Create or move a tag; returns the version that it points at."""
        version = version or self.latest()
        n = self._rows("tags", "tag string, version long, n long").agg(F.max("n")).first()[0] or 0
        self.spark.createDataFrame([(name, version, n + 1)], "tag string, version long, n long").write.mode("append").parquet(f"{self.root}/tags")
        return version

    def resolve(self, version: int | str | None = None) -> int:
        if isinstance(version, str):
            found = self.tags().where(F.col("tag") == version).first()
            if found is None:
                raise KeyError(version)
            return found["version"]
        return version or self.latest()

    def read(self, version: int | str | None = None) -> DataFrame:
        """The newest version, or the one that a number or tag names."""
        number = self.resolve(version)
        found = self.versions().where(F.col("version") == number).first()
        if found is None:
            raise KeyError(number)
        return self.spark.read.parquet(f"{self.root}/data/{found['folder']}")

    def write(self, frame: DataFrame, operation: str = "overwrite", tag: str | None = None, *, after: int | None = None) -> int:
        """Commit `frame` as the next version: the data first, then its number, so a failed write leaves no version.

        after: the version that `frame` was made of. If another writer has committed since, that is an error, and
        so it is for `create`; other writes take the next free number.
        """
        version = self.latest() + 1
        if operation == "create" and version > 1:
            raise FileExistsError(self.root)
        folder = uuid.uuid4().hex
        frame.write.parquet(f"{self.root}/data/{folder}")
        try:
            version = self._claim(version if after is None else after + 1, operation, folder, wait=operation != "create" and after is None)
        except FileExistsError:
            remove(self.spark, f"{self.root}/data/{folder}")
            raise
        if tag:
            self.tag(tag, version)
        return version

    def _claim(self, version: int, operation: str, folder: str, *, wait: bool) -> int:
        while True:
            path = self._path(f"log/{version:012d}.json")
            if self._put_new(path, json.dumps({"version": version, "operation": operation, "folder": folder}).encode()):
                return version
            if not wait:
                raise FileExistsError(f"version {version} of {self.root} was committed by another writer")
            version += 1

    def _put_new(self, path, raw: bytes) -> bool:
        """Put a whole file where none is; False where there is one."""
        jvm, files = self.spark._jvm, self._files(path)
        part = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}.part")
        out = files.create(part, False)
        out.write(bytearray(raw))
        out.close()
        try:
            if files.getScheme() == "file":
                local = lambda p: jvm.java.io.File(files.makeQualified(p).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(path), local(part))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(files.makeQualified(part), files.makeQualified(path), none)
            return True
        except Py4JJavaError:
            if files.exists(path):
                return False
            raise
        finally:
            files.delete(part, False)

    def update(self, updates: DataFrame, key: str, tag: str | None = None) -> int | None:
        """Keyed update, see `updated`; without updates no version is made."""
        if not updates.limit(1).count():
            return None
        base = self.latest()
        return self.write(updated(self.read(base), updates, key), "update", tag, after=base)

    def take(self, column: str, **selector: Sequence) -> DataFrame:
        """(place, column) for the values of exactly one key column, in their order; null where there is none."""
        return taken(self.read(), column, **selector)


def taken(table: DataFrame, column: str, **selector: Sequence) -> DataFrame:
    """(place, column): what `table` holds for each value asked for, at its place; see `Dataset.take`."""
    given = {c: v for c, v in selector.items() if v is not None}
    if len(given) != 1:
        raise ValueError(f"exactly one selector must be given, not {sorted(given)}")
    ((key, values),) = given.items()
    kind = T.StructType([T.StructField("place", T.LongType()), T.StructField("__key", table.schema[key].dataType)])
    asked = table.sparkSession.createDataFrame(list(enumerate(values)), kind)
    held = table.select(F.col(key).alias("__key"), column).join(F.broadcast(asked.select("__key").distinct()), "__key", "left_semi").groupBy("__key").agg(F.first(column, ignorenulls=True).alias(column))
    return asked.join(held, "__key", "left").select("place", column).orderBy("place")


def update_faults(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """(key, fault) for each update key that does not match exactly one row and one update."""
    given = updates.groupBy(key).agg(F.count(F.lit(1)).alias("given"))
    there = table.join(updates.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("there"))
    both = given.join(there, key, "left").withColumn("there", F.coalesce("there", F.lit(0)))
    fault = F.when(F.col(key).isNull(), "null key").when(F.col("given") > 1, "given twice").when(F.col("there") == 0, "missing").when(F.col("there") > 1, "not unique")
    return both.select(key, fault.alias("fault")).where("fault is not null")


def updated(table: DataFrame, updates: DataFrame, key: str, owned: dict[str, str] | None = None) -> DataFrame:
    """`table` with the columns of `updates` replaced in the rows of the same key.

    Each key must match exactly one row, else nothing is done and UpdateError is raised. Updates may be ragged:
    `owned` names for a column the boolean column of `updates` that says whether the row owns it; a null in an
    owned column is a new value. All other columns and rows are carried over.
    """
    owned = owned or {}
    columns = [c for c in updates.columns if c != key and c not in owned.values()]
    if key not in table.columns or key not in updates.columns:
        raise UpdateError(f"no key column {key}")
    if unknown := [c for c in columns if c not in table.columns]:
        raise UpdateError(f"no such columns: {unknown}")
    if faults := update_faults(table, updates, key).limit(10).collect():
        raise UpdateError("; ".join(f"{r[0]}: {r[1]}" for r in faults))
    new = updates.select(F.col(key).alias("__key"), *(F.col(c).cast(table.schema[c].dataType).alias(f"__new_{c}") for c in columns), *(F.col(owned[c]).alias(f"__own_{c}") for c in columns if c in owned), F.lit(True).alias("__hit"))
    joined = table.join(new, table[key] == new["__key"], "left")
    own = lambda c: F.coalesce(F.col("__hit"), F.lit(False)) & (F.coalesce(F.col(f"__own_{c}"), F.lit(False)) if c in owned else F.lit(True))
    return joined.select(*(F.when(own(c), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def newest(frame: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order: last-wins and first-seen dedups."""
    row = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return frame.withColumn("__row", row).where("__row = 1").drop("__row")


def find(spark: SparkSession, folder: str, name: str | None = None) -> Dataset | None:
    """The dataset in a folder: the folder itself, the one called `name`, or its only one; several are an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    is_set = lambda p: files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "log"))
    if is_set(at):
        return Dataset(spark, folder)
    if not files.exists(at):
        raise FileNotFoundError(folder)
    there = {s.getPath().getName(): s.getPath().toString() for s in files.listStatus(at) if s.isDirectory() and is_set(s.getPath())}
    if name in there or len(there) == 1:
        return Dataset(spark, there.get(name) or next(iter(there.values())))
    if there:
        raise ValueError(f"several datasets in {folder}: {sorted(there)}")
    return None


def load_or_create(spark: SparkSession, folder: str, name: str, import_rows: Callable[[], DataFrame], *, tag: str | None = None, force: bool = False) -> tuple[Dataset, bool]:
    """The dataset of a folder, and whether this call made its first version or, with `force`, a new one.

    The folder itself, the dataset called `name` or its only one is taken as it is; several without that name are an error.
    Else, or with `force`, what `import_rows()` gives is committed. Of callers that import at once one makes the first
    version, and the others get that: their own rows are removed.
    """
    if not force and (found := find(spark, folder, name)):
        return found, False
    data = Dataset(spark, f"{folder.rstrip('/')}/{name}")
    if force:
        data.write(import_rows(), "overwrite", tag)
        return data, True
    try:
        data.write(import_rows(), "create", tag)
    except FileExistsError:
        return data, False
    return data, True
