"""Pages of documents as a table function: one document gives many rows, in a lateral join.

A renderer is a plug-in: `renderer(content)` yields a page's body, or (body, page, number of pages). It is made once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def form_feeds(text: str) -> Iterator[str]:
    """Pages of a text that parts them by form feeds; what follows the last one is a page if it holds anything."""
    pages = text.split("\f")
    yield from pages if pages[-1] or len(pages) == 1 else pages[:-1]


def of_lines(lines: int) -> Callable[[], Callable[[str], Iterator[str]]]:
    """A renderer of plain text: so many lines are a page."""

    def render(text: str) -> Iterator[str]:
        rows = text.split("\n")
        for at in range(0, len(rows), lines):
            yield "\n".join(rows[at : at + lines])

    return lambda: render


def page_source(make: Callable[[], Callable[[str], Iterable]], body: str = "string"):
    """A table function (content) -> (page, pages, body), pages from 0. A document without a page is an error; null has none.

    `pages` is what the renderer says, else null: it yields pages one by one and holds none.
    """

    class Pages:
        def __init__(self):
            self.render = make()

        def eval(self, content):
            if content is None:
                return
            count = 0
            for page in self.render(content):
                own, number, of = page if isinstance(page, tuple) else (page, count, None)
                count += 1
                yield number, of, own
            if not count:
                raise ValueError("a document holds no pages")

    return udtf(Pages, returnType=f"page int, pages int, body {body}")


def input_pages(documents: DataFrame, content: str, make: Callable[[], Callable[[str], Iterable]], *, paged: Column | None = None, name: str = "millrace_pages", body: str = "string") -> DataFrame:
    """Documents with `page`, `pages` and `body` in place of `content`; rows that are not `paged` (images) are a page of their own."""
    spark: SparkSession = documents.sparkSession
    spark.udtf.register(name, page_source(make, body))
    rows = documents if paged is None else documents.where(paged)
    kept = ", ".join(f"d.`{c}`" for c in documents.columns if c != content)
    cut = spark.sql(f"SELECT {kept}, p.page, p.pages, p.body FROM {{d}} d, LATERAL {name}(d.`{content}`) p", d=rows)
    if paged is None:
        return cut
    whole = documents.where(~F.coalesce(paged, F.lit(False)) & F.col(f"`{content}`").isNotNull())
    return cut.unionByName(whole.select(*(f"`{c}`" for c in documents.columns if c != content), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("pages"), F.col(f"`{content}`").cast(body).alias("body")))
