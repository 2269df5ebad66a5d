"""Assets from folders: the walk, sidecar rules, metadata, and the files that describe tags and devices."""

from __future__ import annotations

import mimetypes
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import schema
from millrace.sources import media_heads

#: Sidecars in the order in which they are looked for.
SIDECARS = (".txt", ".md", ".srt")


def walk(spark: SparkSession, folder: str, *, content: bool = False) -> DataFrame:
    """path, modified, size (and content) of all files under `folder`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), *(["content"] if content else []))


def primary_assets(paths: DataFrame, *, texts_apart: bool = False, include_texts: bool = True) -> DataFrame:
    """The rows of `paths` (path) that are assets and not sidecars of one.

    A text file next to a non-text asset of its folder and stem is that asset's sidecar. With `texts_apart`
    captions come from another tree, so every file is an asset; without `include_texts` no text file is.
    """
    known = paths.withColumn("family", schema.family(F.col("path"))).where("family is not null")
    if texts_apart:
        return known
    known = known.withColumn("folder", schema.parent(F.col("path"))).withColumn("stem", schema.stem(F.col("path")))
    media = known.where("family <> 'text'")
    if not include_texts:
        return media.drop("folder", "stem")
    texts = known.where("family = 'text'").join(media.select("folder", "stem").distinct(), ["folder", "stem"], "left_anti")
    return media.unionByName(texts.select(media.columns)).drop("folder", "stem")


def sidecars(assets: DataFrame, paths: DataFrame) -> DataFrame:
    """`assets` (path) with `sidecar`: the first of SIDECARS in its folder with its stem that is not itself."""
    rank = F.array_position(F.array(*map(F.lit, SIDECARS)), schema.extension(F.col("sidecar")))
    found = paths.select(F.col("path").alias("sidecar")).where(rank > 0)
    found = found.select("sidecar", rank.alias("rank"), schema.parent(F.col("sidecar")).alias("folder"), schema.stem(F.col("sidecar")).alias("stem"))
    own = assets.withColumn("folder", schema.parent(F.col("path"))).withColumn("stem", schema.stem(F.col("path")))
    # By (folder, stem) there are at most as many candidates as SIDECARS and two case spellings; the best goes on.
    pairs = own.select("path", "folder", "stem").join(found, ["folder", "stem"]).where("path <> sidecar").groupBy("path").agg(F.min_by("sidecar", F.struct("rank", "sidecar")).alias("sidecar"))
    return own.drop("folder", "stem").join(pairs, "path", "left")


def sidecar_lines(path: Column, text: Column) -> Column:
    """A .txt sidecar's lines, any other as one caption."""
    lines = F.split(F.regexp_replace(text, r"(\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ])\z", ""), r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]")
    return F.when(schema.extension(path) != ".txt", F.array(text)).when(text == "", F.array().cast("array<string>")).otherwise(lines)


def mime_type(path: Column) -> Column:
    """The MIME type by suffix, else one of the family."""
    known = {s: mimetypes.types_map.get(s) for _, suffixes in schema.IMPORT_ORDER for s in suffixes} | {".md": "text/markdown"}
    table = F.create_map(*(F.lit(x) for s, m in sorted(known.items()) if m for x in (s, m)))
    family = F.create_map(*(F.lit(x) for s, m in schema.MIME_OF.items() for x in (s, m)))
    return F.coalesce(F.try_element_at(table, schema.extension(path)), F.try_element_at(family, schema.family(path)))


def import_texts(files: DataFrame) -> DataFrame:
    """Asset rows of text and application files (path, size, content): JVM only, media sizes are 0."""
    return schema.with_defaults(schema.conform(files.select(F.col("path").alias("uris"), mime_type(F.col("path")).alias("mime"), F.sha2("content", 256).alias("hash"), "size")))


def _probed(batches: Iterator[pd.DataFrame], probe) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [probe(p, bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
        yield pd.DataFrame([(p, *r) for p, r in zip(batch["path"], rows, strict=True) if r is not None], columns=["path", "width", "height", "channels", "depth", "duration", "num_frames", "frame_rate"])


def probe_media(files: DataFrame, probe) -> DataFrame:
    """Metadata by a decoder `probe(path, bytes)` -> (width, height, channels, depth, ms, frames, rate); None drops the file."""
    kind = "path string, width int, height int, channels int, depth int, duration int, num_frames int, frame_rate float"
    return files.select("path", "content").mapInPandas(lambda it: _probed(it, probe), kind)


def import_media(files: DataFrame) -> DataFrame:
    """Asset rows of images, audio and video (path, size, content), by their heads; what cannot be read has none."""
    found = media_heads.probed(files.select("path", "size"))
    rows = files.select("path", "size", F.sha2("content", 256).alias("hash"), mime_type(F.col("path")).alias("mime")).join(found, "path")
    return schema.with_defaults(schema.conform(rows.withColumnRenamed("path", "uris")))


def numbered_extras(paths: DataFrame) -> DataFrame:
    """(path, extra, number): files `stem_<digits>` beside `stem` with its suffix, in numeric order."""
    own = paths.select("path", schema.parent(F.col("path")).alias("folder"), schema.stem(F.col("path")).alias("stem"), schema.extension(F.col("path")).alias("suffix"))
    parts = own.select(F.col("path").alias("extra"), "folder", "suffix", F.regexp_extract("stem", r"^(.*)_\d+$", 1).alias("stem"), F.expr(r"try_cast(regexp_extract(stem, '_(\\d+)$', 1) as int)").alias("number")).where("number is not null")
    return own.join(parts, ["folder", "stem", "suffix"]).select("path", "extra", "number")


def tag_table(spark: SparkSession, path: str) -> DataFrame:
    """idx, name, category from a tag CSV (tag_id, name, category): 9 is a rating, 0 general, 4 a character."""
    rows = spark.read.csv(path, header=True)
    kind = F.when(F.col("category") == "9", "rating").when(F.col("category") == "0", "general").when(F.col("category") == "4", "character").otherwise("unknown")
    order = F.row_number().over(Window.orderBy(F.col("tag_id").cast("long"))) - 1  # a vocabulary file, not data
    return rows.select(order.alias("idx"), "name", kind.alias("category"))


def implications(spark: SparkSession, path: str) -> DataFrame:
    """parent, children from an implication CSV whose third and fourth columns are child and parent."""
    rows = spark.read.csv(path, header=True)
    child, above = rows.columns[2:4]
    return rows.where(F.col(child).isNotNull() & F.col(above).isNotNull()).groupBy(F.col(above).alias("parent")).agg(F.array_sort(F.collect_set(child)).alias("children"))


def devices(lines: DataFrame) -> DataFrame:
    """idx, name, memory from `value` lines of at least three comma-separated fields; bad lines go."""
    f = F.split("value", r"\s*,\s*")
    rows = lines.where(F.size(f) >= 3).select(F.try_element_at(f, F.lit(1)).try_cast("int").alias("idx"), F.trim(F.try_element_at(f, F.lit(2))).alias("name"), F.regexp_extract(F.try_element_at(f, F.lit(3)), r"\d+", 0).try_cast("long").alias("memory"))
    return rows.where("idx is not null and memory is not null").orderBy("idx")
