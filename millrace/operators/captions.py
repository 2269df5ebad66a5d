"""Caption results: parsing, validation, payloads, segments and previous context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (
    ("long", "string"), ("long_description", "string"), ("description", "string"), ("caption", "string"), ("short", "string"), ("short_description", "string"),
    ("transcript", "string"), ("translation_srt", "string"), ("rating", "string"), ("average_score", "double"), ("total_score", "double"), ("caption_extension", "string"))]}
)
NOTHING = "No description available"


def _full(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def payload(text: Column) -> Column:
    """A JSON answer as a struct with all alias keys; text that is no object gives null."""
    return F.when(F.startswith(F.trim(text), F.lit("{")), F.from_json(text, PAYLOAD, {"mode": "PERMISSIVE"}))


def description(p: Column, mode: Column | None = None) -> Column:
    """The text to show: for subtitles the translation or transcript, else the longest form that is there."""
    plain = F.coalesce(*(_full(p[k]) for k in ("long", "long_description", "transcript", "description", "caption", "short", "short_description")), F.lit(NOTHING))
    if mode is None:
        return plain
    return F.when(mode.isin("ast", "srt"), F.coalesce(_full(p["translation_srt"]), _full(p["transcript"]), plain)).otherwise(plain)


def candidates(assets: DataFrame, files: DataFrame, *, overwrite: bool = False, append: bool = False, extension: str = ".txt") -> DataFrame:
    """The images of `assets` (uris, mime, captions) that are to be captioned.

    Those without captions (null or an empty list) that have no caption file beside them among `files` (path,
    size; empty files do not count); with `append` caption files do not matter, with `overwrite` all images go.
    """
    images = assets.where(F.startswith("mime", F.lit("image/")))
    if overwrite:
        return images
    bare = images.where(F.coalesce(F.size("captions"), F.lit(0)) <= 0)
    if append:
        return bare
    full = files.where("size > 0").select(F.col("path").alias("__file")).distinct()
    return bare.join(full, F.regexp_replace("uris", r"\.[^./\\]*$", extension) == F.col("__file"), "left_anti")


def persistable(status: Column, *contents: Column) -> Column:
    """Whether a result is stored: a success with some content that is not blank."""
    some = F.lit(False)
    for c in contents:
        some = some | (F.coalesce(_full(c), F.lit("")) != "")
    return F.coalesce(status == "success", F.lit(False)) & some


def mean_score(average: Column, overall: Column, total: Column, named: Column) -> Column:
    """The average given, else the overall one, the total, or the mean of the named scores (a map)."""
    values = F.filter(F.map_values(named), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))
    return F.coalesce(average, overall, total, mean)


def clamp(x: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def retry_code(text: Column, name: Column, rate: Column, threshold: float, several: Column) -> Column:
    """Why a caption is asked for again: a gateway error, a missing name or section, too few of its tags."""
    limit = F.when(several, threshold / 2).otherwise(threshold)
    return F.when(F.contains(text, F.lit("502")), 502).when((F.coalesce(name, F.lit("")) != "") & ~F.contains(F.lower(text), F.lower(name)), 1).when(~F.contains(text, F.lit("###")), 2).when(rate < limit, 3).otherwise(0)


def retry_wait(status: Column, base: float) -> Column:
    """Seconds to wait before another try, or null for none."""
    return F.when(status == 429, 59.0).when(status == 502, base)


def directory_context(uri: Column, mime: Column) -> Column:
    """The name and series that an image's or video's folder tells, as a prompt's first sentence; else ''."""
    folder = F.try_element_at(F.split(uri, r"[/\\]"), F.lit(-2))
    name, series = F.trim(F.regexp_extract(folder, r"^(.*?)\s*\(([^()]*)\)$", 1)), F.regexp_extract(folder, r"^(.*?)\s*\(([^()]*)\)$", 2)
    text = F.when(name != "", F.concat(F.lit("It shows <"), name, F.lit("> from ("), series, F.lit(")."))).otherwise(F.concat(F.lit("It shows <"), folder, F.lit(">.")))
    return F.when((F.startswith(mime, F.lit("image/")) | F.startswith(mime, F.lit("video/"))) & (F.coalesce(folder, F.lit("")) != ""), text).otherwise("")


def segments(media: DataFrame, seconds: Column) -> DataFrame:
    """(uri, n, begin, end) in ms: parts of equal length, of which the last ends with the medium (uri, duration)."""
    step = seconds * 1000
    n = F.ceil(F.col("duration") / step).cast("int")
    parts = media.where("duration > 0").select("uri", "duration", step.alias("step"), F.explode(F.sequence(F.lit(0), n - 1)).alias("n"))
    return parts.select("uri", "n", (F.col("n") * F.col("step")).cast("long").alias("begin"), F.least((F.col("n") + 1) * F.col("step"), "duration").cast("long").alias("end"))


def skips_segmenting(mime: Column, duration: Column, seconds: Column, direct: Column) -> Column:
    """Whether a medium goes whole: images, no segment time, or short enough for one request."""
    return F.startswith(mime, F.lit("image/")) | seconds.isNull() | (seconds <= 0) | F.coalesce(duration <= direct, duration <= (seconds + 1) * 1000)


def merged_cues(cues: DataFrame, clips: DataFrame, seconds: int) -> DataFrame:
    """Cues of a medium's clips on one time line, numbered anew.

    cues: uri, clip, begin, end, text (ms within the clip); clips: uri, clip, length (ms). Cues that begin after
    the segment's length go; each clip begins where the ones before it end.
    """
    before = F.coalesce(F.sum("length").over(Window.partitionBy("uri").orderBy("clip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = clips.select("uri", "clip", before.alias("offset"))
    moved = cues.where(F.col("begin") <= seconds * 1000).join(at, ["uri", "clip"]).select("uri", (F.col("begin") + F.col("offset")).alias("begin"), (F.col("end") + F.col("offset")).alias("end"), "text")
    return moved.select("uri", F.row_number().over(Window.partitionBy("uri").orderBy("begin", "end", "text")).alias("number"), "begin", "end", "text")


def previous_context(chunks: DataFrame, by: str, order: str, text: str, chars: int) -> DataFrame:
    """`chunks` with `context`: the end of the chunk before."""
    before = F.lag(text).over(Window.partitionBy(by).orderBy(order))
    return chunks.withColumn("context", F.coalesce(F.right(before, F.lit(chars)), F.lit("")))


def joined_segments(parts: DataFrame, by: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """The parts' texts of each medium, in order, without blank ones."""
    rows = parts.where(F.coalesce(_full(F.col(text)), F.lit("")) != "").groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("rows"))
    return rows.select(by, F.array_join(F.transform("rows", lambda r: r[text]), separator).alias(text))


def compact_runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Equal neighbours as `value xN`, in order; of more than 12 runs the first 8, ... and the last 2."""
    own = Window.partitionBy(by).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(own)) | (F.row_number().over(own) == 1)).cast("int")
    runs = rows.withColumn("run", change)
    runs = runs.withColumn("run", F.sum("run").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(by, "run").agg(F.first(value).alias("v"), F.count(F.lit(1)).alias("n"))
    lists = runs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("run", F.when(F.col("n") > 1, F.concat("v", F.lit(" x"), F.col("n").cast("string"))).otherwise(F.col("v")).alias("text")))).alias("runs"))
    texts = F.transform("runs", lambda r: r["text"])
    return lists.select(by, F.when(F.size("runs") > 12, F.concat(F.slice(texts, 1, 8), F.array(F.lit("...")), F.slice(texts, -2, 2))).otherwise(texts).alias("runs"))


def running_segments(rows: DataFrame, by: str, order: str, segment: str) -> DataFrame:
    """Rows whose segment number exceeds all before it: where a new segment begins."""
    before = F.max(segment).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(segment) > F.col("__before"))).drop("__before")


def first_seen(rows: DataFrame, by: str, value: str, place: str) -> DataFrame:
    """(by, value): the distinct values of each group as a list, in the order in which they come first; blank ones go."""
    once = rows.where(_full(F.col(value)).isNotNull()).groupBy(by, value).agg(F.min(place).alias("__first"))
    lists = once.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__first", value))).alias("rows"))
    return lists.select(by, F.transform("rows", lambda r: r[value]).alias(value))
