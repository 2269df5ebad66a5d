"""Tag operators over long rows (uri, category, idx, tag, confidence), and over one row a uri with an array of such tags.

Where a uri's tags come as one row, as a model's vector does, the functions on arrays need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SINGLE = ("quality", "rating", "model")
RATING_RELATED, CHARACTER_RELATED = ("rating", "quality", "meta", "model"), ("character", "copyright", "artist")


def sigmoid(x: Column, most: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-most)), F.lit(most))))


def scores(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, idx, confidence): one row for each element of a vector of logits."""
    return vectors.select(key, F.posexplode(vector).alias("idx", "x")).select(key, "idx", sigmoid(F.col("x").cast("double")).alias("confidence"))


def _limit(category: Column, thresholds: dict[str, float]) -> Column:
    limit = F.lit(0.5)
    for name, t in thresholds.items():
        limit = F.when(category == name, t).otherwise(limit)
    return limit


def above(tags: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Tags with at least their category's threshold; of single-valued categories the best, of equals the first.

    Both are decided in one aggregation by (uri, category), which combines before the shuffle.
    """
    limit = _limit(F.col("category"), thresholds)
    single = F.col("category").isin(*SINGLE)
    best = tags.where(single).groupBy("uri", "category").agg(F.max(F.struct("confidence", -F.col("idx"), "tag")).alias("b"))
    best = best.select("uri", "category", (-F.col("b.col2")).cast("int").alias("idx"), F.col("b.tag").alias("tag"), F.col("b.confidence").alias("confidence"))
    return tags.where(~single & (F.col("confidence") >= limit)).select(best.columns).unionByName(best)


def scored(vector: Column, category: Callable[[Column], Column], name: Callable[[Column], Column]) -> Column:
    """A vector of logits as an array of tags (category, idx, tag, confidence); category and name by place."""
    tag = lambda x, i: F.struct(category(i).alias("category"), i.alias("idx"), name(i).alias("tag"), sigmoid(x.cast("double")).alias("confidence"))
    return F.transform(vector, tag)


def above_in(tags: str, thresholds: dict[str, float]) -> Column:
    """As `above`, of the array in column `tags`."""
    many = F.filter(tags, lambda t: ~t["category"].isin(*SINGLE) & (t["confidence"] >= _limit(t["category"], thresholds)))
    key = lambda t: F.struct(t["confidence"].alias("confidence"), (-t["idx"]).alias("less"), t.alias("own"))
    best = lambda category: F.array_max(F.transform(F.filter(tags, lambda t: t["category"] == category), key))["own"]
    return F.concat(many, F.array_compact(F.array(*map(best, SINGLE))))


def prepared(name: Column, category: Column, *, undesired: tuple[str, ...] = (), replacements: dict[str, str] | None = None, underscores: bool = False, expand: bool = False) -> Column:
    """A vocabulary name as it is written: unwanted ones are '', then replacements, spaces, and characters without (series)."""
    out = F.when(name.isin(*undesired), "").otherwise(name) if undesired else name
    if replacements:
        known = F.create_map(*(F.lit(x) for pair in sorted(replacements.items()) for x in pair))
        out = F.coalesce(F.try_element_at(known, out), out)
    if not underscores:
        out = F.when(F.length(out) > 3, F.translate(out, "_", " ")).otherwise(out)
    if expand:
        out = F.when((category == "character") & F.endswith(out, F.lit(")")), F.trim(F.regexp_replace(out, r"\([^(]*$", ""))).otherwise(out)
    return out


def without_parents(tags: DataFrame, implications: DataFrame) -> DataFrame:
    """Rows but those whose tag is the parent of another tag of the same uri; implications: parent, child."""
    own = tags.select("uri", F.col("tag").alias("child")).distinct()
    implied = own.join(implications.select("parent", "child"), "child").select("uri", F.col("parent").alias("tag")).distinct()
    return tags.join(implied, ["uri", "tag"], "left_anti")


def without_parents_in(tags: str, implications: dict[str, list[str]]) -> Column:
    """As `without_parents`, of the array in column `tags`; implications: a child's parents, part of the plan.

    For vocabularies of some thousand pairs, whatever the number of rows; larger ones are tables, as for `without_parents`.
    """
    if not implications:
        return F.col(tags)
    parents = F.create_map(*(x for child, of in sorted(implications.items()) for x in (F.lit(child), F.array(*map(F.lit, of)))))
    implied = F.flatten(F.array_compact(F.transform(tags, lambda t: F.try_element_at(parents, t["tag"]))))
    return F.filter(tags, lambda t: ~F.array_contains(implied, t["tag"]))


def order_of(category: Column, *, ratings: str = "first", characters_first: bool = False) -> Column:
    """A category's place in the written list; ratings are first, last or (None) left out before."""
    rank = F.lit(50)
    names = [*(CHARACTER_RELATED if characters_first else ()), "general", *(() if characters_first else CHARACTER_RELATED)]
    for k, c in enumerate(names):
        rank = F.when(category == c, 10 + k).otherwise(rank)
    for k, c in enumerate(RATING_RELATED):
        rank = F.when(category == c, (0 if ratings == "first" else 30) + k).otherwise(rank)
    return rank


def _listed(tag: Callable[[str], Column], pinned: tuple[str, ...], ratings: str, characters_first: bool, by_confidence: bool, with_confidence: bool) -> tuple[Column, Column]:
    """Whether a tag is written, and the struct that orders it and holds its text."""
    keep = ~tag("category").isin("unknown", *(() if ratings else RATING_RELATED)) & (tag("tag") != "")
    pin = F.array_position(F.array(*map(F.lit, pinned)), tag("tag")) if pinned else F.lit(0)
    pin = F.when(pin > 0, pin).otherwise(len(pinned) + 1)
    text = F.concat(tag("tag"), F.lit(":"), F.format_number(tag("confidence"), 2)) if with_confidence else tag("tag")
    first = F.when(F.lit(by_confidence), -tag("confidence")).otherwise(0.0)
    rank = order_of(tag("category"), ratings=ratings or "first", characters_first=characters_first)
    return keep, F.struct(pin.alias("pin"), first.alias("first"), rank.alias("rank"), tag("category").alias("category"), (-tag("confidence")).alias("less"), tag("idx").alias("idx"), text.alias("text"))


def assembled(tags: DataFrame, *, pinned: tuple[str, ...] = (), ratings: str = "first", characters_first: bool = False, by_confidence: bool = False, with_confidence: bool = False) -> DataFrame:
    """(uri, tags): the list as written; of equal confidence the earlier stays earlier, pinned tags lead in their own order."""
    keep, row = _listed(F.col, pinned, ratings, characters_first, by_confidence, with_confidence)
    rows = tags.where(keep).groupBy("uri").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("uri", F.transform("rows", lambda r: r["text"]).alias("tags"))


def assembled_in(tags: str, *, pinned: tuple[str, ...] = (), ratings: str = "first", characters_first: bool = False, by_confidence: bool = False, with_confidence: bool = False) -> Column:
    """As `assembled`, of the array in column `tags`; empty where no tag is written."""
    of = lambda t: _listed(lambda c: t[c], pinned, ratings, characters_first, by_confidence, with_confidence)
    rows = F.array_sort(F.transform(F.filter(tags, lambda t: of(t)[0]), lambda t: of(t)[1]))
    return F.transform(rows, lambda r: r["text"])


def noun_roots(tags: Column) -> Column:
    """A tag list without single words that are the last word of another tag too."""
    root = lambda t: F.element_at(F.split(F.trim(t), r"\s+"), -1)
    roots = F.transform(F.filter(tags, lambda t: F.trim(t) != ""), root)
    return F.filter(tags, lambda t: (F.size(F.split(F.trim(t), r"\s+")) != 1) | (F.size(F.filter(roots, lambda r: r == root(t))) <= 1))


def frequencies(lists: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, n) over all lists, by the text before a colon, most frequent first."""
    return lists.select(F.explode(tags).alias("tag")).groupBy(F.substring_index("tag", ":", 1).alias("tag")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def by_category(tags: DataFrame) -> DataFrame:
    """(uri, tags map category -> list in order)."""
    lists = tags.where("tag <> ''").groupBy("uri", "category").agg(F.array_sort(F.collect_list(F.struct("idx", "tag"))).alias("rows"))
    lists = lists.select("uri", "category", F.transform("rows", lambda r: r["tag"]).alias("list"))
    return lists.groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "list")))).alias("tags"))


#: Colours of rates, from the lowest.
RATE_COLOURS = ("red", "orange", "yellow", "green", "cyan", "blue", "magenta")


def named_tags(text: Column, tags: Column) -> Column:
    """The different tags that a text names as whole words, lower-cased; where several begin, the longest is named."""
    some = F.filter(F.transform(tags, F.trim), lambda t: t != "")
    longest = F.transform(F.array_sort(F.transform(some, lambda t: F.struct((-F.length(t)).alias("less"), t.alias("tag")))), lambda r: r["tag"])
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)(?:"), F.array_join(F.transform(longest, lambda t: F.regexp_replace(t, r"([\\^$.|?*+()\[\]{}])", r"\\$1")), "|"), F.lit(r")(?!\w)"))
    return F.when(F.size(some) > 0, F.array_distinct(F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.lower))).otherwise(F.array().cast("array<string>"))


def highlight_rate(text: Column, tags: Column) -> Column:
    """Percent of the tags that a text names; a <name> and a (series) in it count as one more each; 0 without tags."""
    marks = F.regexp_like(text, F.lit("<[^>]+>")).cast("int") + F.regexp_like(text, F.lit(r"\([^)]+\)")).cast("int")
    n = F.size(F.filter(tags, lambda t: F.trim(t) != ""))
    return F.when(n > 0, 100.0 * (F.size(named_tags(text, tags)) + marks) / n).otherwise(0.0)


def rate_style(rate: Column) -> Column:
    """A rate's colour, bold above 50."""
    n = len(RATE_COLOURS)
    colour = F.element_at(F.array(*map(F.lit, RATE_COLOURS)), F.least(F.floor(rate / (100 / n)), F.lit(n - 1)).cast("int") + 1)
    return F.concat(colour, F.when(rate > 50, " bold").otherwise(""))


def name_series(names: Column, excluded: tuple[str, ...] = ()) -> Column:
    """`name_(series), other` as `<name> from (series), <other>`; excluded series stay part of the name."""

    def one(item: Column) -> Column:
        item = F.regexp_replace(F.translate(F.trim(item), "_", ":"), r" \(cosplay\)$", "")
        name, series = F.trim(F.regexp_extract(item, r"^(.*)\(([^()]*)\)$", 1)), F.trim(F.regexp_extract(item, r"^(.*)\(([^()]*)\)$", 2))
        has = F.regexp_like(item, F.lit(r"^.*\([^()]*\)$"))
        if excluded:
            has = has & ~series.isin(*excluded)
        return F.when(has, F.concat(F.lit("<"), name, F.lit("> from ("), series, F.lit(")"))).otherwise(F.concat(F.lit("<"), item, F.lit(">")))

    return F.array_join(F.transform(F.split(names, ","), one), ", ")


def categorized(tags: DataFrame, vocabulary: DataFrame, default: str = "0") -> DataFrame:
    """`tags` with the category of each tag from a vocabulary (name, category); an unknown one has the default."""
    known = vocabulary.select(F.col("name").alias("tag"), "category")
    return tags.join(known, "tag", "left").withColumn("category", F.coalesce("category", F.lit(default)))


def latest_per(tags: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return tags.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
