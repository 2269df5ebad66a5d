"""Model answers as tables: subtitles, page layouts, image names, scores, events, and the routing of providers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as tx
from millrace.operators.responses import last_by_label

_CUE = r"(?s)^\s*(?:\d+\s*\n)?\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})[^\n]*\n?(.*)$"


def _ms(c: Column, first: int) -> Column:
    field = lambda i: F.regexp_extract(c, _CUE, first + i).try_cast("long")
    return ((field(0) * 60 + field(1)) * 60 + field(2)) * 1000 + field(3)


def cues(subtitles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, begin, end, text) of subtitle texts, in ms; blocks that are no cue go."""
    blocks = subtitles.select(key, F.posexplode(F.split(tx.unix_lines(F.col(text)), r"\n\s*\n")).alias("place", "block")).where(F.regexp_like("block", F.lit(_CUE)))
    block = F.col("block")
    rows = blocks.select(key, "place", _ms(block, 1).alias("begin"), _ms(block, 5).alias("end"), tx.strip(F.regexp_extract(block, _CUE, 9)).alias("text"))
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("place")).alias("number"), "begin", "end", "text")


def subtitle_faults(subtitles: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fault): the first thing wrong with each subtitle text, or null."""
    seen = cues(subtitles, key, text).groupBy(key).agg(F.bool_or(F.col("end") <= F.col("begin")).alias("range"), F.bool_or(F.col("text") == "").alias("blank"))
    fault = F.when(F.coalesce(tx.strip(F.col(text)), F.lit("")) == "", "EMPTY_SUBTITLE_OUTPUT").when(F.col("range").isNull(), "EMPTY_SUBTITLE_ITEMS").when(F.col("range"), "INVALID_SUBTITLE_RANGE").when(F.col("blank"), "EMPTY_SUBTITLE_TEXT")
    return subtitles.join(seen, key, "left").select(key, fault.alias("fault"))


def subtitle_text(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): cues (key, number, begin, end, text) as a subtitle file's text."""

    def clock(ms: Column) -> Column:
        return F.concat(tx.clock(ms / 1000), F.lit(","), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))

    line = F.concat(F.col("number").cast("string"), F.lit("\n"), clock(F.col("begin")), F.lit(" --> "), clock(F.col("end")), F.lit("\n"), "text", F.lit("\n"))
    made = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))).alias("rows"))
    return made.select(key, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def event_text(events: Column) -> Column:
    """Events (start, end, text) as `<start - end> text`, a line each, with one decimal."""
    return F.array_join(F.transform(events, lambda e: F.concat(F.lit("<"), F.format_string("%.1f", e["start"]), F.lit(" - "), F.format_string("%.1f", e["end"]), F.lit("> "), e["text"])), "\n")


def layout_markdown(cells: Column, *, with_margins: bool = False, picture=None) -> Column:
    """A page's cells (category, bbox, text), in order, as Markdown: formulas as blocks, other texts as they were recognized.

    Page heads and feet go unless `with_margins`. A picture with four corners becomes what `picture(cell, place)` gives: by
    default a link to `picture_<place>.png`.
    """
    picture = picture or (lambda c, i: F.concat(F.lit("![](picture_"), i.cast("string"), F.lit(".png)")))
    some = cells if with_margins else F.filter(cells, lambda c: ~F.coalesce(c["category"].isin("Page-header", "Page-footer"), F.lit(False)))

    def one(c: Column, i: Column) -> Column:
        return F.when((c["category"] == "Picture") & (F.size(c["bbox"]) == 4), picture(c, i)).when(c["category"] == "Formula", tx.formula(c["text"])).otherwise(tx.recognized_text(c["text"]))

    return F.array_join(F.transform(some, one), "\n\n")


def image_names(images: DataFrame, key: str, place: str, name: str) -> DataFrame:
    """`images` with `own_name`: leaf names, of which those that are taken in their document get the next free _2, _3 ...

    Names that differ but for case are the same. A name depends on all before it, numbered ones included, so a
    document's images are read in order; what is held is the names of one document.
    """
    kind = T.StructType([*images.drop("own_name").schema.fields, T.StructField("own_name", T.StringType())])
    rows = images.withColumn("own_name", tx.leaf_name(F.col(name), "image.png")).select(*(f"`{f.name}`" for f in kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, taken, last = object(), set(), {}
        for batch in batches:
            given = []
            for own, leaf in zip(batch.column(key).to_pylist(), batch.column("own_name").to_pylist(), strict=True):
                if own != document:
                    document, taken, last = own, set(), {}
                stem, dot, suffix = leaf.rpartition(".")
                stem, suffix = (stem, dot + suffix) if stem else (leaf, "")
                made, n = leaf, last.get(leaf.lower(), 1)
                while made.lower() in taken:
                    n += 1
                    made = f"{stem}_{n}{suffix}"
                last[leaf.lower()] = n
                taken.add(made.lower())
                given.append(made)
            yield batch.set_column(batch.num_columns - 1, "own_name", pa.array(given, batch.schema.field("own_name").type))

    return rows.repartition(F.col(f"`{key}`")).sortWithinPartitions(f"`{key}`", f"`{place}`").mapInArrow(run, kind)


def scores(text: Column) -> Column:
    """Labels and numbers of lines such as `1. **Label** 7` or `Label: 7.5/10`, as a map by the label's letters and digits; of one label the last."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:\d+[.)]\s*)?\**([^\n*:\d][^\n*:]*?)\**\s*[: ]\s*\**\s*(\d+(?:\.\d+)?)(?:\s*/\s*10)?\**\s*$"), F.lit(0))
    label = lambda x: tx.score_key(F.regexp_replace(F.regexp_replace(x, r"^\s*\d+[.)]\s*", ""), r"[\d./\s]*\**\s*$", ""))
    value = lambda x: F.regexp_extract(x, r"(\d+(?:\.\d+)?)(?:\s*/\s*10)?\**\s*$", 1).try_cast("double")
    return F.map_from_entries(last_by_label(F.transform(lines, lambda x: F.struct(label(x).alias("label"), value(x).alias("score")))))


#: What words are worth in the name of a stem that may be the vocals (the first found counts), and
#: the words that cost points, once.
VOCAL_WORDS = (("vocals", 5), ("vocal", 4), ("voice", 3), ("lead", 1))
OTHER_WORDS, OTHER_COST = ("instrumental", "karaoke", "other", "bass", "drum", "guitar", "piano", "inst"), 6


def vocal_rank(name: Column) -> Column:
    """How much a stem's name speaks for its being the vocals; only ranks above 0 do."""
    low = F.lower(name)
    worth = F.coalesce(*(F.when(F.contains(low, F.lit(w)), points) for w, points in VOCAL_WORDS), F.lit(0))
    return worth - F.when(F.regexp_like(low, F.lit("|".join(OTHER_WORDS))), OTHER_COST).otherwise(0)


def best_vocals(stems: DataFrame, key: str, name: str, place: str) -> DataFrame:
    """(key, name) of each work's stem of the highest rank, of equals the first; works without vocals have none."""
    return stems.where(vocal_rank(F.col(name)) > 0).groupBy(key).agg(F.max_by(name, F.struct(vocal_rank(F.col(name)).alias("rank"), (-F.col(place)).alias("place"))).alias(name))


def routed(jobs: DataFrame, providers: DataFrame) -> DataFrame:
    """`jobs` (id, mime, route) with the provider that handles each, or null.

    providers: name, aliases, prefix, priority (at most a few hundred rows). A named route must match a name or
    alias; without one the handler of lowest priority number takes the job.
    """
    names = providers.select("name", "prefix", "priority", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    named = jobs.where(F.coalesce("route", F.lit("")) != "").join(names, (F.lower("route") == F.lower("alias")) & F.startswith("mime", F.col("prefix"))).groupBy("id").agg(F.min_by("name", "priority").alias("provider"))
    family = lambda c: F.substring_index(c, "/", 1)
    free = jobs.where(F.coalesce("route", F.lit("")) == "").withColumn("family", family("mime")).join(providers.withColumn("family", family("prefix")), "family").where(F.startswith("mime", F.col("prefix")))
    free = free.groupBy("id").agg(F.min_by("name", F.struct("priority", "name")).alias("provider"))
    return jobs.join(named.unionByName(free), "id", "left")
