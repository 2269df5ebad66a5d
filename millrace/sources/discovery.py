"""Which files a job takes: discovery by suffix and folder, pairs by name, sources to rebuild a table from, settings."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import schema


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def inputs(paths: DataFrame, suffixes: Sequence[str], *, outside: str | None = None) -> DataFrame:
    """The distinct paths with one of the suffixes that do not lie in the folder `outside`, by path without case."""
    found = paths.where(schema.extension(F.col("path")).isin(*suffixes)).select("path").distinct()
    if outside is not None:
        found = found.where(~F.startswith("path", F.lit(outside.rstrip("/") + "/")))
    return found.orderBy(F.lower("path"), "path")


def same_name(sources: DataFrame, references: DataFrame) -> DataFrame:
    """(path, reference) of the sources that have a reference of their own file name."""
    named = references.select(F.col("path").alias("reference"), file_name(F.col("path")).alias("name"))
    return sources.select("path", file_name(F.col("path")).alias("name")).join(named, "name").select("path", "reference")


def rebuilt_from(scan: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of a folder's scan, or, only if it has none, those of the table."""
    some = F.broadcast(scan.limit(1).select(F.lit(1).alias("__some")))  # one row
    rest = table.withColumn("__some", F.lit(1)).join(some, "__some", "left_anti").drop("__some")
    return scan.unionByName(rest, allowMissingColumns=True)


def bits_per_channel(channels: Column, depth: Column) -> Column:
    return F.when(channels > 0, depth).otherwise(0)


def bit_rate(width: Column, height: Column, channels: Column, depth: Column, duration: Column, rate: Column) -> Column:
    """Bits a second before coding; 0 without a duration. Without a size a frame is a sample."""
    bits = channels.cast("long") * bits_per_channel(channels, depth)
    frame = F.when((width > 0) & (height > 0), bits * width * height).otherwise(bits)
    return F.when(duration > 0, (frame * rate).cast("long")).otherwise(F.lit(0).cast("long"))


def text_class(path: Column) -> Column:
    """"text", "application" for documents other than .psd, else null."""
    suffix = schema.extension(path)
    return F.when(suffix.isin(*schema.TEXT), "text").when(suffix.isin(*schema.APPLICATION) & (suffix != ".psd"), "application")


def needs_pixels(resized: Column, converted: Column, cropped: Column) -> Column:
    """Whether an image must be decoded at all."""
    return F.coalesce(resized, F.lit(False)) | F.coalesce(converted, F.lit(False)) | F.coalesce(cropped, F.lit(False))


def output_state(settings: Column, wanted: Column, files: Column) -> Column:
    """What an output folder is for a run: reusable or mismatch by the settings stored there, else occupied or empty."""
    return F.when(settings.isNotNull(), F.when(settings == wanted, "reusable").otherwise("mismatch")).when(files > 0, "occupied").otherwise("empty")


def output_folder(folders: DataFrame, wanted: Column) -> DataFrame:
    """(base, path, state): the folder that each base's run takes, the base itself or the first usable one derived.

    folders: base, place (0 is the base itself), path, settings, files. A base of other settings takes none.
    """
    state = output_state(F.col("settings"), wanted, F.col("files"))
    judged = folders.withColumn("state", state)
    usable = F.when(F.col("state").isin("reusable", "empty"), F.struct("place", "path", "state"))
    blocked = F.bool_or((F.col("place") == 0) & (F.col("state") == "mismatch"))
    found = judged.groupBy("base").agg(F.min(usable).alias("x"), blocked.alias("blocked"))
    return found.select("base", F.when(~F.col("blocked"), F.col("x.path")).alias("path"), F.when(F.col("blocked"), "mismatch").otherwise(F.coalesce("x.state", F.lit("none"))).alias("state"))


def settings(texts: Sequence[str | None], legacy: Callable[[], str | None] = lambda: None) -> dict:
    """TOML texts merged by their top-level keys, later ones over earlier; without any the legacy text."""
    merged: dict = {}
    some = [t for t in texts if t is not None]
    for t in some or filter(None, [legacy()]):
        merged |= tomllib.loads(t)
    return merged


def limited(paths: DataFrame, most: int) -> DataFrame:
    """The first `most` of `paths` (path) in order; 0 and less stand for all."""
    return paths.orderBy("path").limit(most) if most > 0 else paths
