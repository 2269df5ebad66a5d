"""Files from rows: captions beside their assets, buckets, pages of documents, notes and events.

Spark's own writers are used where a folder of parts will do. A file for each row is written by `write_files`,
whose writer runs in the tasks: to a temporary name, then renamed, so that a task that is run again does no harm. Its paths
go through pyarrow's file systems (file, hdfs, s3, gs). Files of note events are in `event_files`.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import schema
from millrace.functions import text as tx
from millrace.sources.versions import tag_part


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and its path there."""
    return fs.FileSystem.from_uri(path if re.match(r"\w[\w+.-]*://?", path) else os.path.abspath(path))


def put(path: str, raw: bytes) -> None:
    """Write a file whole or not at all."""
    files, own = located(path)
    files.create_dir(os.path.dirname(own), recursive=True)
    part = f"{own}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as f:
        f.write(raw)
    files.move(part, own)


def exists(path: str) -> bool:
    files, own = located(path)
    return files.get_file_info(own).type != fs.FileType.NotFound


def caption_path(uri: Column, family: Column, suffix: str = "", override: Column | None = None) -> Column:
    """Where an asset's caption goes: its stem, a suffix of the name, and the extension of its family."""
    return F.concat(F.regexp_replace(uri, r"\.[^./\\]*$", ""), F.lit(suffix), tx.caption_suffix(family, override))


def caption_files(assets: DataFrame, families: tuple[str, ...] = ("image", "animation", "video", "audio", "text", "application"), suffix: str = "") -> DataFrame:
    """(path, body) of the captions of assets (uris, captions) that have some and are of an allowed family.

    A JSON object among the captions can name the file's extension (`caption_extension`). Where its description is
    what the file holds, the last such object is a file of its own beside it, ending in .json.
    """
    kind, objects = schema.family(F.col("uris"), schema.EXPORT_ORDER), tx.json_objects(F.col("captions"))
    rows = assets.select("uris", "captions", kind.alias("family"), objects.alias("objects")).where(F.col("family").isin(*families) & F.exists("captions", lambda x: tx.strip(x) != ""))
    asked = F.get_json_object(F.try_element_at("objects", F.lit(1)), "$.caption_extension")
    rows = rows.withColumn("path", caption_path(F.col("uris"), F.col("family"), suffix, asked))
    texts = rows.select("path", tx.caption_body(schema.extension(F.col("path")), F.col("captions")).alias("body"))
    twins = rows.where((F.size("objects") > 0) & ~schema.extension(F.col("path")).isin(".srt", ".md"))
    return texts.unionByName(twins.select(F.regexp_replace("path", r"\.[^./\\]*$", ".json").alias("path"), F.element_at("objects", -1).alias("body")))


def translated_files(assets: DataFrame, language: str, root: str | None = None) -> DataFrame:
    """(path, body) of translated Markdown: beside its asset (uris, text), or at the same place under `root`, named by language.

    Blank translations have no file.
    """
    rows = assets.where(tx.strip(F.coalesce("text", F.lit(""))) != "")
    base = F.col("uris") if root is None else F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("uris", r"^(?:\w[\w+.-]*:)?[/\\]*", ""))
    suffix = F.concat(F.lit("_"), F.replace(tag_part(F.lit(language)), F.lit("-"), F.lit("_")), F.lit(".md"))
    return rows.select(F.concat(F.regexp_replace(base, r"(?<=[^/\\])\.[^./\\]*$", ""), suffix).alias("path"), tx.caption_body(F.lit(".md"), F.array("text")).alias("body"))


def safe_under(base: str, name: Column) -> Column:
    """A child of `base` by the leaf of an untrusted name."""
    return F.concat(F.lit(base.rstrip("/") + "/"), tx.leaf_name(name))


def write_files(files: DataFrame, *, overwrite: bool = True, write: Callable[[str, bytes], None] = put) -> DataFrame:
    """(path, written) of files (path, body or content); without `overwrite` what is there stays."""
    body = "content" if "content" in files.columns else "body"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for path, raw in zip(batch["path"], batch[body], strict=True):
                new = raw is not None and (overwrite or not exists(path))
                if new:
                    write(path, raw.encode() if isinstance(raw, str) else bytes(raw))
                done.append(new)
            yield pd.DataFrame({"path": batch["path"], "written": done})

    return files.select("path", body).mapInPandas(run, "path string, written boolean")


def write_buckets(rows: DataFrame, path: str, bucket: str = "bucket") -> None:
    """A folder for each bucket. Rows are spread over tasks by a hash besides the bucket, so a large one is no single task's."""
    rows.repartition(F.col(bucket), F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.partitionBy(bucket).mode("overwrite").parquet(path)


#: What stands before and after each page of a document that was put together of pages.
PAGE_HEADER = '<header style="background-color: #f5f5f5; padding: 8px; margin-bottom: 20px; text-align: center; border-bottom: 1px solid #ddd;">\n<strong> Page {} </strong>\n</header>\n\n'
PAGE_FOOTER = '<footer style="background-color: #f5f5f5; padding: 8px; margin-top: 20px; text-align: center; border-top: 1px solid #ddd;">\n<strong> Page {} </strong>\n</footer>\n\n'
PAGE_BREAK = '<div style="page-break-after: always;"></div>\n\n'
_HEADER_BEGIN = '<header style="background-color: #f5f5f5;'
_HEADER, _FOOTER, _BREAK = rf"(?s){_HEADER_BEGIN}.*?</header>", r'(?s)<footer\s+style="[^"]*">.*?</footer>', r'(?s)<div style="page-break-after: always;">\s*</div>'
_IMAGE = r"!\[([^\]]*)\]\([^/()]+/([^/()]+)\)"


def own_images(body: Column) -> Column:
    """A page with its images beside it instead of in a folder, each where it first stands only."""
    of = lambda group: F.regexp_extract_all(body, F.lit(_IMAGE), F.lit(group))

    def piece(text: Column, i: Column) -> Column:
        name = F.get(of(2), i)
        return F.concat(text, F.when(F.array_position(of(2), name) == i + 1, F.concat(F.lit("!["), F.get(of(1), i), F.lit("]("), name, F.lit(")"))).otherwise(""))

    return F.array_join(F.transform(F.split(body, _IMAGE, -1), piece), "")


def pages(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, name, body): documents at their page headers, else at their headings, else whole.

    A page begins at its header and ends with the footer of its number, else before the next header; headers,
    footers and page breaks go, and what stands before the first header. A section is named by the first 20
    characters of its heading.
    """
    by_page = F.regexp_like(text, F.lit(rf"{_HEADER_BEGIN}(?s:.*?)<strong> Page \d+ </strong>"))
    by_heading = F.regexp_like(text, F.lit(r"(?m)^#{1,6}\s+\S"))
    cut = F.when(by_page, F.split(text, f"(?={_HEADER_BEGIN})", -1)).when(by_heading, F.split(text, r"(?m)(?=^#{1,6}\s+\S)", -1)).otherwise(F.array(text))
    parts = documents.select(key, F.when(by_page, "page").when(by_heading, "section").otherwise("whole").alias("kind"), F.posexplode(cut).alias("place", "body"))
    number, heading = F.regexp_extract("body", r"(?s)\A.*?<strong> Page (\d+) </strong>", 1), F.regexp_extract("body", r"\A#{1,6}\s+(.*)", 1)
    parts = parts.withColumn("title", F.when(F.col("kind") == "page", number).when(F.col("kind") == "section", heading).otherwise("whole")).where("title <> ''")
    own_footer = F.concat(F.lit(r'(?s)\A(.*?<footer\s+style="[^"]*">\s*<strong>\s*Page\s+'), "title", F.lit(r"\s*</strong>.*?</footer>)"))
    body = F.coalesce(F.try_element_at(F.regexp_extract_all(F.col("body"), own_footer, F.lit(1)), F.lit(1)), "body")
    for gone in (_BREAK, _HEADER, _FOOTER):
        body = F.regexp_replace(body, gone, "")
    body = F.when(F.col("kind") == "page", own_images(F.regexp_replace(body, "\n{3,}", "\n\n"))).otherwise(F.col("body"))
    section = F.regexp_replace(tx.strip(F.left(F.regexp_replace("title", r"(?U)[^\w\s-]", ""), F.lit(20))), r"[-\s]+", "_")
    name = F.when(F.col("kind") == "page", F.concat(F.lit("page_"), "title")).when(F.col("kind") == "section", section).otherwise("whole")
    page = F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1
    return parts.select(key, page.alias("page"), name.alias("name"), tx.strip(body).alias("body"))


def assembled_pages(parts: DataFrame, key: str, page: str, text: str, *, headers: bool = True) -> DataFrame:
    """(key, text): pages in order (0-based), each between its header and footer, which `pages` cuts again; else by line."""
    number = (F.col(page) + 1).cast("string")
    framed = lambda frame: F.concat(*(F.lit(x) if k == 0 else F.concat(number, F.lit(x)) for k, x in enumerate(frame.split("{}"))))
    body = F.concat(framed(PAGE_HEADER), text, F.lit("\n\n"), framed(PAGE_FOOTER), F.lit(PAGE_BREAK)) if headers else F.col(text)
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), body.alias("body")))).alias("rows"))
    return rows.select(key, F.array_join(F.transform("rows", lambda r: r["body"]), "" if headers else "\n").alias(text))


def write_notes(notes: DataFrame, path: str, separator: str = ",") -> None:
    """Notes as CSV or TSV, times with three decimals."""
    three = lambda c: F.format_string("%.3f", F.col(c)).alias(c)
    notes.select(three("onset"), three("offset"), "pitch").write.option("header", True).option("sep", separator).mode("overwrite").csv(path)
