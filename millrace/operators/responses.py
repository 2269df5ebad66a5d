"""Whole answers of caption models as columns: JSON objects under several key names, ###-sections, free text with scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as tx

#: The ratings there are (others count as the first), and how many characters a short text takes of a long one.
RATINGS, SHORT = ("general", "sensitive", "questionable", "explicit"), 240

#: Lines of a free answer, in any case: headings, averages and totals, and numbered scores.
SCORE_HEADING = r"(?i)\A\s*(?:\*\*(?:Evaluation\s+)?Scores:\*\*|(?:Evaluation\s+)?Scores:)\s*\z"
TEXT_HEADING = r"(?i)\A(?:\*\*Detailed Visual Description:\*\*|Detailed Visual Description:)[^\S\n]*(?:\n|\z)"
AVERAGE, TOTAL = (rf"(?i){word}\s+score[^0-9]*([0-9]+(?:\.[0-9]+)?)" for word in ("average", "total"))
BOLD_SCORE = r"\A\s*\d+\.\s*\*\*(.+?)\*\*\s*([0-9]+(?:\.[0-9]+)?)\s*\z"
PLAIN_SCORE = r"\A\s*\d+\.\s*(.+?)\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*\z"


def _value(answer: Column, kind: str, *keys: str) -> Column:
    """What the first of some keys that holds a value of a kind holds; empty texts and zeros are no values."""
    none = F.lit("" if kind == "string" else 0).cast(kind)
    return F.coalesce(*(F.nullif(F.try_variant_get(answer, f"$.{k}", kind), none) for k in keys), none)


def parsed(text: Column) -> Column:
    """A text that is a JSON object as a variant, else null."""
    return F.when(tx.is_object(text), F.try_parse_json(tx.strip(text)))


def parts(text: Column, mode: str = "all") -> Column:
    """(tags, short, long, rating, average) of an answer that is a JSON object, has ###-sections, or is plain.

    tags is one text; rating is a text or the JSON of what stands there, or null. A long text that is missing is the
    answer itself (not in mode `short`), a short one the first of several lines of the long one (not in mode `long`).
    """
    text = F.coalesce(text, F.lit(""))
    return tx.let(F.struct(text.alias("text"), parsed(text).alias("answer")), lambda x: _parts(x["text"], x["answer"], mode))


def _parts(text: Column, answer: Column, mode: str) -> Column:
    tags = F.coalesce(F.array_join(F.try_variant_get(answer, "$.tags", "array<string>"), ", "), _value(answer, "string", "tags"))
    full = lambda k: F.when(answer.isNotNull(), F.get_json_object(text, f"$.{k}"))
    rating = F.coalesce(*(F.when(~full(k).isin("", "[]", "{}"), full(k)) for k in ("rating", "scores")))
    short, long = _value(answer, "string", "short_description", "short"), _value(answer, "string", "long_description", "description")
    by_sections = (short == "") & (long == "") & F.contains(text, F.lit("###"))
    short, long = (F.when(by_sections, section).otherwise(own) for section, own in zip(tx.short_and_long(text), (short, long), strict=True))
    average = _value(answer, "double", "average_score", "avg_score")

    def made(x: Column) -> Column:
        short, long = x["short"], x["long"]
        if mode != "long":
            short = F.when((short == "") & F.contains(long, F.lit("\n")), tx.strip(F.substring_index(long, "\n", 1))).otherwise(short)
        return F.struct(tags.alias("tags"), short.alias("short"), long.alias("long"), rating.alias("rating"), average.alias("average"))

    def whole(x: Column) -> Column:
        return F.struct(x["short"].alias("short"), (x["long"] if mode == "short" else F.when(x["long"] == "", tx.strip(text)).otherwise(x["long"])).alias("long"))

    return tx.let(tx.let(F.struct(short.alias("short"), long.alias("long")), whole), made)


def caption(text: Column, overall: str | None = None) -> Column:
    """(short, long, tags, rating, confidence, scores, average) of a JSON answer; null where it holds no caption.

    A short text that is missing is the begin of the long one, a long one the short one. Without an average it is the
    score named `overall`, else the total by the number of scores, else their mean.
    """
    return tx.let(parsed(text), lambda answer: _caption(answer, overall))


def _caption(answer: Column, overall: str | None) -> Column:
    short = tx.strip(_value(answer, "string", "short_description", "short"))
    long = tx.strip(_value(answer, "string", "long_description", "long", "description", "caption"))
    given = F.coalesce(F.try_variant_get(answer, "$.tags", "array<string>"), F.split(_value(answer, "string", "tags"), "[,，]"))
    tags = F.filter(F.transform(given, tx.strip), lambda t: t != "")
    told = lambda rating: F.when(rating.isin(*RATINGS), rating).otherwise(RATINGS[0])
    rating = tx.let(F.lower(tx.strip(_value(answer, "string", "rating"))), told)
    scores = F.coalesce(F.try_variant_get(answer, "$.scores", "map<string,double>"), F.create_map().cast("map<string,double>"))

    def average(scores: Column) -> Column:
        total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
        known = [_value(answer, "double", "average_score", "avg_score"), *([F.try_element_at(scores, F.lit(overall))] if overall else [])]
        mean = F.try_divide(F.coalesce(F.nullif(_value(answer, "double", "total_score"), F.lit(0.0)), total), F.size(scores))
        return F.coalesce(*(F.nullif(x, F.lit(0.0)) for x in known), mean, F.lit(0.0))

    def made(x: Column) -> Column:
        short, long, scores = x["short"], x["long"], x["scores"]
        found = F.struct(
            F.when(short == "", tx.strip(F.left(long, F.lit(SHORT)))).otherwise(short).alias("short"), F.when(long == "", short).otherwise(long).alias("long"), tags.alias("tags"), rating.alias("rating"),
            F.least(F.greatest(_value(answer, "double", "confidence"), F.lit(0.0)), F.lit(1.0)).alias("confidence"), scores.alias("scores"), average(scores).alias("average"),
        )
        return F.when((short != "") | (long != ""), found)

    return tx.let(F.struct(short.alias("short"), long.alias("long"), scores.alias("scores")), made)


def freeform(text: Column) -> Column:
    """(description, scores, average) of a free answer: what stands before the heading of its scores, and numbered scores.

    Of several scores of one label, and of several averages, the last counts.
    """
    return tx.let(F.split(tx.unix_lines(F.coalesce(text, F.lit(""))), "\n"), _freeform)


def _freeform(lines: Column) -> Column:
    heading = F.filter(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.lit(SCORE_HEADING)), i)), lambda i: i.isNotNull())
    body = tx.strip(F.array_join(F.slice(lines, F.lit(1), F.coalesce(F.get(heading, F.lit(0)), F.size(lines))), "\n"))
    description = F.regexp_replace(tx.strip(F.regexp_replace(body, TEXT_HEADING, "")), "\n{3,}", "\n\n")

    def score(x: Column) -> Column:
        bold = F.regexp_like(x, F.lit(BOLD_SCORE))
        field = lambda k: F.when(bold, F.regexp_extract(x, BOLD_SCORE, k)).otherwise(F.regexp_extract(x, PLAIN_SCORE, k))
        label = F.when(bold, tx.strip(F.regexp_replace(tx.strip(field(1)), ":+$", ""))).otherwise(tx.strip(field(1)))
        return F.struct(label.alias("label"), field(2).try_cast("double").alias("score"))

    told = F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(f"{AVERAGE}|(?:{TOTAL})|(?:{SCORE_HEADING})")))
    scores = F.filter(F.transform(told, score), lambda s: (s["label"] != "") & s["score"].isNotNull())
    averages = F.regexp_extract_all(F.array_join(F.transform(lines, lambda x: F.regexp_extract(x, AVERAGE, 0)), "\n"), F.lit(AVERAGE), F.lit(1))
    average = F.coalesce(F.try_element_at(averages, F.lit(-1)).try_cast("double"), F.lit(0.0))
    return F.struct(description.alias("description"), F.map_from_entries(tx.let(scores, last_by_label)).alias("scores"), average.alias("average"))


def last_by_label(scores: Column) -> Column:
    """Of structs (label, score) of one label the last."""
    return F.filter(scores, lambda s, i: ~F.exists(F.slice(scores, i + 2, F.size(scores)), lambda later: later["label"] == s["label"]))
