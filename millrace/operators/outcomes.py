"""What becomes of model answers: payloads by task, gates, waits before another try, score maps, links of images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx

# Parts of error messages by which errors are told apart, as the reference has them.
FAST_FAIL = ("unauthorized", "forbidden", "invalid parameter", "invalid argument", "invalid_request_error", "bad request", "validation error", "unsupported mime", "unsupported_mime", "malformed request", "missing required")
# The last line of a result without any text.
NOTHING = "No description available"


def _full(c: Column) -> Column:
    return F.when(F.coalesce(tx.strip(c), F.lit("")) != "", c)


def structured_text(task: Column, subtitle_format: Column, extension: Column, **texts: Column) -> Column:
    """The text of a structured result that goes into its file.

    texts: translation_srt, transcript, long_description, description, short_description; those left out are null.
    """
    of = lambda name: texts.get(name, F.lit(None).cast("string"))
    plain = F.coalesce(*(F.nullif(of(n), F.lit("")) for n in ("long_description", "transcript", "description", "short_description")), F.lit(NOTHING))
    tidy = lambda c: F.lower(F.coalesce(tx.strip(c), F.lit("")))
    subtitles = (tidy(task) == "ast") | (tidy(subtitle_format) == "srt") | (tidy(extension).isin(".srt", "srt"))
    return F.when(subtitles, F.coalesce(_full(F.coalesce(F.nullif(of("translation_srt"), F.lit("")), of("transcript"))), plain)).otherwise(plain)


def descriptions(mode: Column, short: Column, short_description: Column, long: Column, long_description: Column, description: Column) -> Column:
    """(short_description, long_description) that a mode leaves; "short" drops the long one, "long" the short one."""
    one = F.when(F.coalesce(mode, F.lit("all")) != "long", F.coalesce(short_description, short))
    two = F.when(F.coalesce(mode, F.lit("all")) != "short", F.coalesce(long_description, long, F.when(F.coalesce(mode, F.lit("all")) != "long", description)))
    return F.struct(one.alias("short_description"), two.alias("long_description"))


def displayed(modality: Column, pixels: Column, paired: Column, structured: Column, description: Column, long_description: Column, average: Column) -> Column:
    """(description, average_score) of a structured result of one image; null for all others and without a description."""
    text = F.coalesce(_full(description), _full(long_description))
    ok = F.coalesce((modality == "image") & pixels & ~paired & structured, F.lit(False)) & text.isNotNull()
    return F.when(ok, F.struct(tx.strip(text).alias("description"), F.coalesce(average.try_cast("double"), F.lit(0.0)).alias("average_score")))


def audio_outcome(answer: Column, mime: Column, task: Column) -> Column:
    """(task_kind, text, caption_extension, subtitle_format) of an audio answer; null for other media and blank answers.

    Translations are subtitles; transcripts are if they hold times.
    """
    text = tx.strip(answer)
    translated = F.lower(tx.strip(task)) == "ast"
    timed = F.coalesce(translated, F.lit(False)) | F.contains(text, F.lit("-->"))
    made = F.struct(F.when(translated, "ast").otherwise("transcribe").alias("task_kind"), text.alias("text"), F.when(timed, ".srt").otherwise(".txt").alias("caption_extension"), F.when(timed, "srt").otherwise("").alias("subtitle_format"))
    return F.when(F.startswith(mime, F.lit("audio")) & (F.coalesce(text, F.lit("")) != ""), made)


def transcript(answer: Column) -> Column:
    """A transcript without reasoning, out of its fence, with one blank line at most; null if nothing is left (another try)."""
    text = tx.strip_reasoning(answer)
    body = tx.strip(F.regexp_extract(text, r"(?s)^.*```[^\n`]*\n(.*?)```", 1))
    text = F.when(F.contains(text, F.lit("```")) & (body != ""), body).otherwise(text)
    return F.nullif(tx.strip(F.regexp_replace(text, r"\n{3,}", "\n\n")), F.lit(""))


def subtitle_answer(answer: Column) -> Column:
    """The subtitles in an answer's last srt fence, green marks as font tags; null if there are none (another try)."""
    text = F.replace(F.replace(answer, F.lit("[green]"), F.lit("<font color='green'>")), F.lit("[/green]"), F.lit("</font>"))
    text = F.when(~F.contains(text, F.lit("```srt")), F.replace(text, F.lit("```markdown"), F.lit("```srt"))).otherwise(text)
    return F.nullif(tx.fenced(text, "srt"), F.lit(""))


def grounded(answer: Column, span: Column) -> Column:
    """(description, span) of a time-grounding answer: span, an array of texts, must be two numbers; a blank answer tells the span."""
    first, last = (F.try_element_at(span, F.lit(i)).try_cast("double") for i in (1, 2))
    times = F.when((F.size(span) == 2) & first.isNotNull() & last.isNotNull(), F.array(first, last))
    text = tx.strip_reasoning(answer)
    told = F.concat(F.lit("From "), F.format_string("%.1f", first), F.lit(" to "), F.format_string("%.1f", last), F.lit("."))
    return F.struct(F.when(text != "", text).when(times.isNotNull(), told).otherwise("").alias("description"), times.alias("span"))


def scene_text(scene: Column, events: Column) -> Column:
    """A scene and its events (start, end, description; texts) by line; times that are no numbers are left out."""

    def one(e: Column) -> Column:
        start, end, text = e["start"].try_cast("double"), e["end"].try_cast("double"), tx.strip(e["description"])
        times = F.concat(F.lit("<"), F.format_string("%.1f", start), F.lit(" - "), F.format_string("%.1f", end), F.lit("> "))
        return F.concat(F.when(start.isNotNull() & end.isNotNull(), times).otherwise(""), text)

    told = F.filter(events, lambda e: F.coalesce(tx.strip(e["description"]), F.lit("")) != "")
    head = F.when(F.coalesce(scene, F.lit("")) != "", F.array(F.concat(F.lit("Scene: "), scene))).otherwise(F.array().cast("array<string>"))
    body = F.when(F.size(events) > 0, F.concat(F.array(F.lit("Events:")), F.transform(told, one))).otherwise(F.array().cast("array<string>"))
    return tx.strip(F.array_join(F.concat(head, body), "\n"))


def error_wait(message: Column, base: float, *, rate_limit: float = 59.0, fast_fail: Sequence[str] = ()) -> Column:
    """Seconds until another try after a remote error, or null where trying again is of no use.

    Rate limits wait long, refusals and wrong requests are not tried again, all else waits `base`.
    """
    low = F.lower(message)
    status = lambda *codes: F.regexp_like(message, F.lit(rf"(?<!\d)(?:{'|'.join(map(str, codes))})(?!\d)"))
    refused = status(400, 401, 403)
    for mark in (*FAST_FAIL, *(m.lower() for m in fast_fail)):
        refused = refused | F.contains(low, F.lit(mark))
    return F.when(status(429) | F.contains(low, F.lit("rate limit")), F.lit(rate_limit)).when(~refused, F.lit(base))


def jittered(wait: Column, *of: Column, share: float = 0.2) -> Column:
    """A wait moved by up to `share` of itself either way; by a hash, so that a task that is run again waits alike."""
    return wait * (1 - share + 2 * share * F.pmod(F.xxhash64(*of), F.lit(10_001)) / 10_000)


def segment_policy(mime: Column, seconds: Column, most: Column, bypass: Column) -> Column:
    """(seconds, direct_ms, bypass): a provider's limit `most` for videos caps segments one second below it."""
    safe = F.greatest(F.lit(1), F.floor(most).cast("int") - 1)
    limited = F.startswith(mime, F.lit("video")) & F.coalesce(most > 0, F.lit(False))
    own = F.when(seconds.isNull() | (seconds <= 0), safe).otherwise(F.least(seconds.cast("int"), safe))
    return F.struct(F.when(limited, own).otherwise(seconds.cast("int")).alias("seconds"), F.when(limited, F.floor(most * 1000).cast("long")).alias("direct_ms"), F.coalesce(F.exists(bypass, lambda p: F.startswith(mime, p)), F.lit(False)).alias("bypass"))


def score_map(raw: Column) -> Column:
    """A map of texts as scores: keys stripped, blank ones gone; what is no number is 0, nothing is below 0."""
    full = F.map_filter(raw, lambda k, v: tx.strip(k) != "")
    return F.transform_values(F.transform_keys(full, lambda k, v: tx.strip(k)), lambda k, v: F.greatest(F.coalesce(v.try_cast("double"), F.lit(0.0)), F.lit(0.0)))


def ordered_scores(scores: Column, order: Sequence[str]) -> Column:
    """A map's entries (key, value): those named in `order` first and in that order, then the others as they come."""
    known = F.array(*map(F.lit, order))
    entries = F.map_entries(scores)
    first = F.filter(F.transform(known, lambda k: F.struct(k.alias("key"), F.try_element_at(scores, k).alias("value"))), lambda e: F.map_contains_key(scores, e["key"]))
    return F.concat(first, F.filter(entries, lambda e: ~F.array_contains(known, e["key"])))


def compact(score: Column) -> Column:
    """A score as text: whole numbers without a point."""
    return F.when(score == F.floor(score), score.cast("long").cast("string")).otherwise(score.cast("string"))


def with_tag_hints(prompts: DataFrame, tags: DataFrame, key: str, prompt: str) -> DataFrame:
    """`prompts` whose texts name the tags that are known for `key`.

    tags: key, tags (a map of lists by category). The join is on the key; rows without tags keep their prompts.
    """
    known = tags.select(key, F.array_join(F.flatten(F.map_values("tags")), ", ").alias("__tags"))
    out = prompts.join(known, key, "left")
    hint = F.when(F.coalesce(F.col("__tags"), F.lit("")) != "", tx.strip(F.concat(F.col(prompt), F.lit("\nExisting tags: "), F.col("__tags")))).otherwise(F.col(prompt))
    return out.withColumn(prompt, hint).select(*(f"`{c}`" for c in prompts.columns))


def recognized(pages: DataFrame, by: str, order: str) -> DataFrame:
    """(by, texts, scores, boxes, content): the lists of a document's pages in a row, and its lines that are not blank."""
    fields = ("texts", "scores", "boxes")
    rows = pages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("rows"))
    joined = lambda f: F.flatten(F.transform("rows", lambda r: F.coalesce(r[f], F.array().cast(pages.schema[f].dataType)))).alias(f)
    lists = [joined(f) for f in fields]
    lines = F.filter(F.transform("texts", tx.strip), lambda x: F.coalesce(x, F.lit("")) != "")
    return rows.select(by, *lists).withColumn("content", F.array_join(lines, "\n"))


def image_links(markdown: Column, folder: str, names: Column) -> Column:
    """Markdown whose images are looked for in `folder`, by a map of their names: as written, then by the leaf name."""
    link = r"!\[(.*?)\]\(([^)]+)\)"

    def one(m: Column) -> Column:
        to = tx.strip(F.regexp_extract(m, link, 2))
        slashed = F.replace(to, F.lit("\\"), F.lit("/"))
        own = F.coalesce(F.try_element_at(names, to), F.try_element_at(names, slashed), F.try_element_at(names, F.substring_index(slashed, "/", -1)))
        return F.when(own.isNull(), m).otherwise(F.concat(F.lit("!["), F.regexp_extract(m, link, 1), F.lit(f"]({folder}/"), own, F.lit(")")))

    found, between = F.transform(F.regexp_extract_all(markdown, F.lit(link), F.lit(0)), one), F.split(markdown, link, -1)
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
