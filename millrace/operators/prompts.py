"""Prompts of captioning jobs by rules, of which the most particular one wins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers from general to particular, and what a rule of each names besides its field; nothing named is a wildcard.
LAYERS = {"base": (), "family": ("family",), "fallback": ("family", "provider"), "provider": ("family", "provider"), "template": ("template",), "pair": ()}
#: Layers that only images have.
OF_IMAGES = ("template", "pair")
#: Rules that are sent to all tasks; of more, jobs are shuffled by what rules name.
MOST_BROADCAST = 10_000

# Tasks in words, the names of their templates, and where the two things that they name stand.
TASKS = (
    (r"(?i)^\s*change\s+(.+?)\s+to\s+(.+?)\s*$", "change_a_to_b", 1, 2),
    (r"(?i)^\s*(?:transform|convert)\s+style\s+(.+?)\s+to\s+(.+?)\s*$", "transform_style_a_to_b", 1, 2),
    (r"(?i)^\s*combine\s+(.+?)\s+(?:and|with)\s+(.+?)\s*$", "combine_a_and_b", 1, 2),
    (r"(?i)^\s*add\s+(.+?)\s+to\s+(.+?)\s*$", "add_a_to_b", 1, 2),
)


def family_of(mime: Column) -> Column:
    """image, video or audio, else ''."""
    kind = F.substring_index(mime, "/", 1)
    return F.when(kind.isin("image", "video", "audio"), kind).otherwise("")


def _with_words(template: str, a: Column, b: Column) -> Column:
    """The template with the words a and b replaced; what is put in is not searched again."""
    pieces = re.split(r"\b([ab])\b", template)
    return F.concat(*((a if p == "a" else b) if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def task_prompt(task: Column, templates: dict[str, str]) -> Column:
    """The template of a task in words with its two things put in, the template that a task names, else the task itself.

    A template has places {a} and {b}, or <a> and <b>, or else the words a and b.
    """
    found = F.lit(None).cast("string")
    for pattern, name, one, two in reversed(TASKS):
        if template := templates.get(name):
            a, b = (F.trim(F.regexp_extract(task, pattern, k)) for k in (one, two))
            text = F.lit(template)
            if "{a}" in template or "<a>" in template:
                for place, word in (("{a}", a), ("<a>", a), ("{b}", b), ("<b>", b)):
                    text = F.replace(text, F.lit(place), word)
            else:  # words that are put in are not searched again
                text = _with_words(template, a, b)
            found = F.when(F.regexp_like(task, F.lit(pattern)), text).otherwise(found)
    named = F.lit(None).cast("string")
    for name, template in templates.items():
        named = F.when(task == name, F.lit(template)).otherwise(named)
    return F.coalesce(found, named, task)


def resolved(jobs: DataFrame, rules: DataFrame, *, tasks: dict[str, str] | None = None, task_provider: str = "gemini") -> DataFrame:
    """Jobs with `system` and `user`, their prompts.

    jobs: mime, provider, template, pair (boolean), task, character. rules: layer, family, provider, template, field (system
    or user), rank, text; of rules of one layer that name the same, the lowest rank wins. Each layer is one join by equality
    on what its rules name. A known template without a user prompt has an empty one; the template `custom` is none. A
    task replaces the user prompt of an image of `task_provider`; a character's prompt comes before it.
    """
    few = rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows, given = jobs.withColumn("__kind", family_of(F.col("mime"))), {"family": F.col("__kind"), "provider": F.col("provider"), "template": F.nullif(F.col("template"), F.lit("custom"))}
    image = F.col("__kind") == "image"
    for layer, keys in LAYERS.items():
        own = rules.where(F.col("layer") == layer).groupBy(*keys).pivot("field", ["system", "user"]).agg(F.min_by("text", "rank"))
        own = own.select(*(F.col(k).alias(f"__{layer}_{k}") for k in keys), F.col("system").alias(f"__{layer}_system"), F.col("user").alias(f"__{layer}_user"), F.lit(True).alias(f"__{layer}"))
        own = F.broadcast(own) if few else own
        if keys:
            match = None
            for k in keys:
                same = given[k] == F.col(f"__{layer}_{k}")
                match = same if match is None else match & same
            rows = rows.join(own, match, "left")
        else:
            found = own.first()  # one row at most
            for field in ("system", "user"):
                rows = rows.withColumn(f"__{layer}_{field}", F.lit(found[f"__{layer}_{field}"] if found else None).cast("string"))
            rows = rows.withColumn(f"__{layer}", F.lit(True) if found else F.lit(None).cast("boolean"))
    paired = image & F.coalesce("pair", F.lit(False))
    on = {"template": image, "pair": paired}
    for field in ("system", "user"):
        value = F.lit("")
        for layer in LAYERS:
            next_ = F.col(f"__{layer}_{field}")
            if layer == "template" and field == "user":
                next_ = F.when(F.col("__template"), F.coalesce(next_, F.lit("")))
            if layer in ("family", "fallback", "provider"):
                next_ = F.when(F.col("__kind") != "", next_)
            value = F.coalesce(F.when(on[layer], next_) if layer in on else next_, value)
        if field == "user":
            own = image & (F.col("provider") == task_provider) & (F.coalesce("task", F.lit("")) != "")
            value = F.concat(F.coalesce("character", F.lit("")), F.when(own, task_prompt(F.col("task"), tasks or {})).otherwise(value))
        rows = rows.withColumn(field, value)
    return rows.select(*(f"`{c}`" for c in jobs.columns if c not in ("system", "user")), "system", "user")
