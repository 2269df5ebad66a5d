"""Whole workflows over a versioned dataset: normalize, translate with context, merge back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import documents as df
from millrace.functions import text as tx
from millrace.operators import captions
from millrace.sources.versions import Dataset


def normalize(data: Dataset, *, most: int = 2000, tag: str | None = None) -> int:
    """A version in which each text asset has its Markdown as only caption, and the ends of its chunks."""
    ends = df.column(lambda t: df.chunk_offsets(t, most), "array<int>")
    rows = data.read()
    if "chunk_offsets" not in rows.columns:
        rows = rows.withColumn("chunk_offsets", F.lit(None).cast("array<int>"))
    made = tx.finalize(tx.to_markdown(tx.captions_to_text(F.col("captions"))))
    rows = rows.withColumn("__text", made).withColumn("captions", F.array("__text")).withColumn("chunk_offsets", ends("__text")).drop("__text")
    return data.write(rows, "normalize", tag)


def chunks(rows: DataFrame) -> DataFrame:
    """(uris, n, text): the chunks of normalized rows."""
    parts = df.sliced(F.col("captions")[0], "chunk_offsets")
    return rows.select("uris", F.posexplode(parts).alias("n", "text"))


def translate(rows: DataFrame, translator: Callable[[], Callable[[str, str], str]], *, context: int = 200) -> DataFrame:
    """(uris, text): chunks translated with the end of the chunk before, code and urls held, edges kept, joined.

    `translator()` is called once a partition and gives (text, context) -> text.
    """
    parts = captions.previous_context(chunks(rows), "uris", "n", "text", context)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for batch in batches:
            call = call or translator()
            made = []
            for text, before in zip(batch["text"], batch["context"], strict=True):
                held, kept = df.protect(text)
                made.append(df.restore(call(held, before), kept))
            yield pd.DataFrame({"uris": batch["uris"], "n": batch["n"], "text": batch["text"], "made": made})

    done = parts.mapInPandas(run, "uris string, n int, text string, made string")
    whole = done.groupBy("uris").agg(F.array_sort(F.collect_list(F.struct("n", tx.keep_edges(F.col("text"), F.col("made")).alias("text")))).alias("rows"))
    return whole.select("uris", F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("text"))


def merge_translations(data: Dataset, translations: DataFrame, tag: str, *, saved: DataFrame | None = None, most: int = 2000) -> int | None:
    """A keyed update of the captions, and of the ends of their chunks where the dataset has such a column.

    translations: uris, text. An asset whose translation is blank takes the one saved before (uris, text), if any; what is
    blank in both stays untranslated.
    """
    text = F.when(tx.strip(F.coalesce("text", F.lit(""))) != "", F.col("text"))
    rows = translations.select("uris", text.alias("text"))
    if saved is not None:
        old = saved.select("uris", F.col("text").alias("old"))
        rows = rows.join(old, "uris", "full").select("uris", F.coalesce("text", F.when(tx.strip(F.coalesce("old", F.lit(""))) != "", F.col("old"))).alias("text"))
    rows, values = rows.where("text is not null"), [F.array("text").alias("captions")]
    if "chunk_offsets" in data.read().columns:
        values.append(df.column(lambda t: df.chunk_offsets(t, most), "array<int>")("text").alias("chunk_offsets"))
    return data.update(rows.select("uris", *values), "uris", tag)
