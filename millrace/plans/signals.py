"""Registered queries over waveforms, time lines and scores, with the SQL that gives the same rows.

The supplied tables stand in for media: embeddings for stretches of samples, events for cues, cuts and notes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import alignment, answers, media, prompts, timeline
from millrace.plans.catalog import _BLOCKS_SQL, _CUES_SQL, _cues, query
from millrace.session import materialize, read_table, remove, shared_dir
from millrace.sources import assets, event_files, ordered, pages, sinks

#: At 1000 samples a second: frames of 32 samples every 8; 5 frames are a silence, 12 a part, 3 are kept.
SILENCE = timeline.Silence(rate=1000, threshold=-30.0, min_length=100, min_interval=40, hop=8, max_kept=24)


@query("""WITH RECURSIVE s AS (SELECT vec_id // 50 AS m, vec_id % 50 * 64 + i AS p, v FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE * CASE WHEN label < 6 THEN 0.001 ELSE 1 END AS v FROM embeddings)),
n AS (SELECT m, max(p) + 1 AS n, (max(p) + 1) // 8 + 1 AS frames FROM s GROUP BY m),
c AS (SELECT m, i, sum(x) AS x FROM (SELECT m, unnest(range(greatest(0, (p - 8) // 8), (p + 16) // 8 + 1)) AS i, p, v * v AS x FROM s) WHERE p BETWEEN i * 8 - 16 AND i * 8 + 15 GROUP BY m, i),
f AS (SELECT m, i, sqrt(coalesce(x, 0) / 32) AS r FROM (SELECT m, unnest(range(frames)) AS i FROM n) LEFT JOIN c USING (m, i)),
q AS (SELECT m, i, r, i - row_number() OVER (PARTITION BY m ORDER BY i) AS g FROM f WHERE r < 10 ** -1.5),
r AS (SELECT m, min(i) AS a, max(i) + 1 AS b FROM q GROUP BY m, g),
h AS (SELECT r.m, a, b, arg_min(i, r) FILTER (i <= a + 3) AS low, arg_min(i, r) FILTER (i >= b - 3) AS high FROM r JOIN q ON q.m = r.m AND q.i >= a AND q.i < b GROUP BY r.m, a, b),
k AS (SELECT h.m, a, b, frames, CASE WHEN a = 0 THEN 0 ELSE low END AS left_at, CASE WHEN b - a <= 3 THEN low ELSE high END AS right_at, low, row_number() OVER (PARTITION BY h.m ORDER BY a) AS k FROM h JOIN n USING (m)),
w AS (SELECT m, 0::BIGINT AS k, 0::BIGINT AS clip, NULL::BIGINT AS l, NULL::BIGINT AS h FROM n WHERE (n + 7) // 8 > 12 UNION ALL
  SELECT k.m, k.k, CASE WHEN cut THEN right_at ELSE clip END, CASE WHEN cut THEN left_at WHEN last THEN low END, CASE WHEN cut THEN right_at WHEN last THEN frames + 1 END
  FROM (SELECT k.*, w.clip, b < frames AND (a = 0 AND b > 3 OR b - a >= 5 AND b - w.clip >= 12) AS cut, b >= frames AND frames - a >= 5 AS last FROM w JOIN k ON k.m = w.m AND k.k = w.k + 1) k),
t AS (SELECT m, l, h, lag(h) OVER (PARTITION BY m ORDER BY k) AS before, row_number() OVER (PARTITION BY m ORDER BY k DESC) AS back FROM w WHERE l IS NOT NULL),
o AS (SELECT m, coalesce(before, 0) AS x, l AS y FROM t WHERE before IS NOT NULL OR l > 0 UNION ALL SELECT m, h, frames FROM t JOIN n USING (m) WHERE back = 1 AND h < frames UNION ALL SELECT m, 0, frames FROM n WHERE m NOT IN (SELECT m FROM t))
SELECT m AS medium, (row_number() OVER (PARTITION BY m ORDER BY x) - 1)::INT AS part, x * 8 AS "begin", least(n, y * 8) AS "end" FROM o JOIN n USING (m)""")
def silence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    loudness = F.when(F.col("label") < 6, 0.001).otherwise(1.0)
    rows = read_table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("medium"), (F.col("vec_id") % 50 * 64).alias("start"), F.transform("embedding", lambda v: v.cast("double") * loudness).alias("values"))
    return timeline.silence_slices(rows, "medium", SILENCE)


@query()
def coherent_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event that is no click is a cue of 3 s; clicks are cuts. Held against a plain fold by a test: no SQL goes from row to row."""
    cues, marks = _cues(spark, sf_dir)
    cues = cues.select("user_id", "number", (F.col("end") - 3000).alias("begin"), "end").withColumn("number", F.expr("cast(row_number() over (partition by user_id order by end, number) as long)"))
    return timeline.coherent_cues(cues, media.scene_blocks(marks, "user_id", "mark"), "user_id", segment_seconds=600)


@query("SELECT row_idx, l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity FROM (SELECT *, row_number() OVER () - 1 AS row_idx FROM lineitem) WHERE l_quantity > 45")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter reaches the scan, and rows keep the numbers that they have without it."""
    rows = ordered.scan_in_order(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], F.col("l_quantity") > 45)
    return rows.withColumn("l_quantity", F.col("l_quantity").cast("double"))


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, '{"k": ' || (arg_max(json_extract(props, '$.k'), (ts, event_id)))::VARCHAR || '}' AS found FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY user_id""")
def latest_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties stand three levels deep in a line of its user's log; the last line that has some counts."""
    rows = read_table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").isNotNull())
    line = F.concat(F.lit('{"a": [1, {"b": {"props": '), "props", F.lit('}}], "props": 3}'))
    found = ordered.objects_under(rows.select("user_id", "event_id", "ts", line.alias("line")), "line", "props").where("found is not null")
    return found.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "found")).alias("last")).select("user_id", "last.event_id", "last.found")


@query("""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))
SELECT doc_id, (i // 5)::INT AS page, string_agg(line, chr(10) ORDER BY i) AS body FROM l GROUP BY doc_id, i // 5""")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pages.input_pages(docs, "text", pages.of_lines(5)).select("doc_id", "page", "body")


@query("""SELECT user_id, 2 * count(*) AS events, count(*) AS notes, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS instruments, 2 * count(*) AS lines, 2 * count(*) AS items, count(*) AS midi_notes,
sum(36 + event_id % 48)::BIGINT AS midi_pitches, round(min(event_id % 1000 / 8.0), 3) AS first_onset, round(max(event_id % 1000 / 8.0 + 0.25), 3) AS last_offset FROM events GROUP BY user_id""")
def event_files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a note of a quarter second, its user the medium; the three files of every user are read back."""
    rows, n, at = read_table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_id") % 1000 / 8.0
    start = F.struct(F.lit("start").alias("type"), (36 + n % 48).cast("int").alias("pitch"), at.alias("start_time"), n.alias("index"), F.col("event_type").alias("instrument"), F.lit(None).cast("double").alias("end_time"), F.lit(None).cast("long").alias("start_event_index"), (2 * n + 1).alias("seq"))
    end = F.struct(F.lit("end").alias("type"), F.lit(None).cast("int").alias("pitch"), F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("long").alias("index"), F.lit(None).cast("string").alias("instrument"), (at + 0.25).alias("end_time"), n.alias("start_event_index"), (2 * n).alias("seq"))
    folder = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    told = materialize(event_files.write_events(rows.select("user_id", F.inline(F.array(start, end))), "user_id", folder, folders=256))
    told = told.select("user_id", "events", "notes", F.array_join(F.array_sort("instruments"), ",").alias("instruments"), *(F.concat(F.lit(f"{folder}/"), F.substring_index(kind, "/", -2)).alias(kind) for kind in ("json", "jsonl", "mid")))
    paths = lambda kind: told.select(F.col(kind).alias("path"))
    lines, items = (event_files.read_events(paths(kind)).groupBy(F.col("path").alias(kind)).agg(F.count_if(F.col("type").isNotNull()).alias(name)) for kind, name in (("jsonl", "lines"), ("json", "items")))
    notes = event_files.read_midi(paths("mid")).groupBy(F.col("path").alias("mid")).agg(F.count(F.lit(1)).alias("midi_notes"), F.sum("pitch").alias("midi_pitches"), F.round(F.min("onset"), 3).alias("first_onset"), F.round(F.max("offset"), 3).alias("last_offset"))
    found = told.join(lines, "jsonl").join(items, "json").join(notes, "mid")
    found = materialize(found.select("user_id", "events", "notes", "instruments", "lines", "items", "midi_notes", "midi_pitches", "first_onset", "last_offset"))
    event_files.remove_files(told.select(F.explode(F.array("json", "jsonl", "mid")).alias("path")))
    remove(spark, folder)
    return found


#: The texts that stand around a part's name, by its key modulo their number: delimiters, preambles and plain texts.
AROUND = (("$$ ", " $$"), ("\\[", "\\]"), ("", ""), ("\\frac{", "}{2}"), ("`\\alpha ", "`"), ("\\documentclass{article}\\usepackage[utf8]{inputenc}\\usepackage{amsmath}\\begin{document}", "\\end{document}"), ("so $x = ", "$ holds"), ("see \\[", "\\] there"), ("$$ a $", "$ b $$"), ("\\(", "\\)"), ("  ", " \n"), ("`$", "$`"), ("\\begin{a}\n", "\n\\end{a}"))


def _layout_sql() -> str:
    """The rule of formulas, stated over any text."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    around = "CASE p_partkey % {} {} END".format(len(AROUND), " ".join(f"WHEN {i} THEN {quoted(a)} || p_name || {quoted(b)}" for i, (a, b) in enumerate(AROUND)))
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""WITH t AS (SELECT p_partkey, p_name, {around} AS raw FROM part), s AS (SELECT *, trim(raw, {white}) AS t, trim(substr(trim(raw, {white}), 3, greatest(length(trim(raw, {white})) - 4, 0)), {white}) AS inner_text FROM t),
p AS (SELECT *, CASE WHEN contains(t, 'usepackage') THEN regexp_replace(t, '(?i)\\documentclass\{{[^}}]+\}}|\\usepackage\{{[^}}]+\}}|\\usepackage\[[^\]]*\]\{{[^}}]+\}}|\\begin\{{document\}}|\\end\{{document\}}', '', 'g') ELSE t END AS bare FROM s),
b AS (SELECT *, '$$' || chr(10) || CASE WHEN bare LIKE '`%`' THEN substr(bare, 2, length(bare) - 2) ELSE bare END || chr(10) || '$$' AS whole FROM p),
f AS (SELECT *, CASE WHEN starts_with(t, '$$') AND suffix(t, '$$') THEN CASE WHEN contains(inner_text, '$') THEN t ELSE '$$' || chr(10) || inner_text || chr(10) || '$$' END WHEN starts_with(t, '\[') AND suffix(t, '\]') THEN '$$' || chr(10) || inner_text || chr(10) || '$$'
  WHEN regexp_matches(t, '\\\[.*\\\]') OR regexp_matches(t, '\$[^$]+\$') OR NOT regexp_matches(t, '(?s)\$\$.*?\$\$|\\[a-zA-Z]+|\\\[.*?\\\]|\\\(.*?\\\)') THEN t ELSE whole END AS formula FROM b)
SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || '![](picture_1.png)' || chr(10) || chr(10) || formula || chr(10) || chr(10) || CASE WHEN starts_with(t, '`$') AND suffix(t, '$`') THEN substr(t, 2, length(t) - 2) ELSE t END AS markdown FROM f"""


@query(_layout_sql())
def layout_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: each name is a title, a formula in one of the ways of `AROUND`, and the same as a text."""
    n, cell = F.col("p_partkey"), lambda kind, text, box=None: F.struct(F.lit(kind).alias("category"), (F.array(*map(F.lit, box)) if box else F.lit(None)).cast("array<int>").alias("bbox"), text.alias("text"))
    raw = F.element_at(F.array(*(F.concat(F.lit(a), "p_name", F.lit(b)) for a, b in AROUND)), F.pmod(n, F.lit(len(AROUND))).cast("int") + 1)
    cells = F.array(cell("Page-header", F.lit("head")), cell("Title", F.concat(F.lit("# "), "p_name")), cell("Picture", F.lit(""), (0, 0, 5, 5)), cell("Formula", raw), cell("Text", raw), cell("Page-footer", F.lit("foot")))
    return read_table(spark, sf_dir, "part").select("p_partkey", answers.layout_markdown(cells).alias("markdown"))


#: layer, family, provider, template, field, rank, text; '' where a layer names nothing.
RULES = (
    ("base", "", "", "", "system", 0, "base system"), ("base", "", "", "", "user", 0, "base user"),
    ("family", "image", "", "", "system", 0, "image system"), ("family", "image", "", "", "user", 0, "image user"), ("family", "video", "", "", "user", 0, "video user"), ("family", "audio", "", "", "system", 0, "audio system"), ("family", "text", "", "", "user", 0, "never"),
    ("fallback", "image", "p1", "", "user", 0, "p1 fallback image"), ("fallback", "video", "p1", "", "user", 0, "p1 fallback video"), ("fallback", "audio", "p2", "", "system", 0, "p2 fallback audio"), ("fallback", "audio", "p3", "", "user", 0, "p3 fallback audio"),
    ("provider", "image", "p0", "", "system", 0, "p0 image system"), ("provider", "image", "p0", "", "user", 0, "p0 image"), ("provider", "image", "p1", "", "user", 1, "p1 image by alias"), ("provider", "image", "p1", "", "user", 0, "p1 image"), ("provider", "image", "p2", "", "system", 2, "p2 image by alias"),
    ("provider", "video", "p0", "", "user", 0, "p0 video"), ("provider", "video", "p2", "", "system", 0, "p2 video system"), ("provider", "video", "p3", "", "user", 0, "p3 video"), ("provider", "audio", "p0", "", "user", 0, "p0 audio"), ("provider", "audio", "p2", "", "user", 0, "p2 audio"), ("provider", "audio", "p4", "", "system", 0, "p4 audio system"),
    ("template", "", "", "t1", "system", 0, "t1 system"), ("template", "", "", "t1", "user", 0, "t1 user"), ("template", "", "", "t2", "system", 0, "t2 system"), ("template", "", "", "t3", "user", 0, "t3 user"), ("template", "", "", "custom", "user", 0, "never"), ("template", "", "", "t2", "other", 0, "never"),
    ("pair", "", "", "", "system", 1, "pair system by its other name"), ("pair", "", "", "", "user", 0, "pair user"),
)
TASK_TEMPLATES = {"change_a_to_b": "Turn every {a} into <b>; keep {a}.", "add_a_to_b": "put a onto b, an abacus stays", "sketch": "Sketch it."}


def _prompts_sql() -> str:
    rules = ", ".join("({})".format(", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r)) for r in RULES)
    rule = lambda layer, field, on="true": f"(SELECT arg_min(text, rank) FROM r WHERE layer = '{layer}' AND field = '{field}' AND {on})"
    same = "r.family = j.family AND r.provider = j.provider"
    parts = lambda field: [("true", rule("base", field)), ("j.family <> ''", rule("family", field, "r.family = j.family")), ("j.family <> ''", rule("fallback", field, same)), ("j.family <> ''", rule("provider", field, same)), ("j.family = 'image'", rule("template", field, "r.template = j.template AND j.template <> 'custom'")), ("j.family = 'image' AND pair", rule("pair", field))]
    layers = ", ".join(f"CASE WHEN {on} THEN {what} END AS {field[0]}{i}" for field in ("system", "user") for i, (on, what) in enumerate(parts(field)))
    words = r"regexp_extract(task, '^\s*{0}\s+(.+?)\s+to\s+(.+?)\s*$', {1}, 'i')"
    a, b, c, d = (words.format(verb, k) for verb in ("change", "add") for k in (1, 2))
    return rf"""WITH r AS (SELECT * FROM (VALUES {rules}) v(layer, family, provider, template, field, rank, text)),
j AS (SELECT doc_id, ['image', 'video', 'audio', ''][doc_id % 4 + 1] AS family, 'p' || doc_id % 5 AS provider, ['', 'custom', 't1', 't2', 't3', 'unknown', ''][doc_id % 7 + 1] AS template, doc_id % 3 = 0 AS pair, doc_id % 8 IN (4, 0) AND doc_id % 5 = 4 AS tasked,
  ['change ' || lang || ' To ' || source, 'sketch', 'add ' || lang || ' to ' || source, 'paint ' || lang][doc_id // 4 % 4 + 1] AS task, CASE WHEN doc_id % 11 = 0 THEN '<' || source || '> ' ELSE '' END AS character FROM documents),
l AS (SELECT j.*, {layers}, EXISTS (SELECT 1 FROM r WHERE layer = 'template' AND r.template = j.template AND j.template <> 'custom') AND j.family = 'image' AS templated FROM j)
SELECT doc_id, coalesce(s5, s4, s3, s2, s1, s0, '') AS system, character || CASE WHEN tasked AND task IS NOT NULL THEN CASE WHEN regexp_matches(task, '^\s*change\s+(.+?)\s+to\s+(.+?)\s*$', 'i') THEN 'Turn every ' || {a} || ' into ' || {b} || '; keep ' || {a} || '.' WHEN regexp_matches(task, '^\s*add\s+(.+?)\s+to\s+(.+?)\s*$', 'i') THEN 'put ' || {c} || ' onto ' || {d} || ', an abacus stays'
WHEN task = 'sketch' THEN 'Sketch it.' ELSE task END ELSE coalesce(u5, CASE WHEN templated THEN coalesce(u4, '') END, u3, u2, u1, u0, '') END AS "user" FROM l"""


@query(_prompts_sql())
def resolved_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as jobs of four families and five providers, against 30 rules."""
    n, pick = F.col("doc_id"), lambda by, *values: F.element_at(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (by % len(values)).cast("int") + 1)
    provider = F.concat(F.lit("p"), (n % 5).cast("string"))
    words = lambda verb, between: F.concat(F.lit(verb), "lang", F.lit(between), "source")
    jobs = read_table(spark, sf_dir, "documents").select("doc_id", pick(n, "image/png", "video/mp4", "audio/wav", "text/plain").alias("mime"), provider.alias("provider"), pick(n, "", "custom", "t1", "t2", "t3", "unknown", "").alias("template"), (n % 3 == 0).alias("pair"), pick(F.floor(n / 4), words("change ", " To "), "sketch", words("add ", " to "), F.concat(F.lit("paint "), "lang")).alias("task"), F.coalesce(F.when(n % 11 == 0, F.concat(F.lit("<"), "source", F.lit("> "))).otherwise("")).alias("character"))
    rules = spark.createDataFrame(RULES, "layer string, family string, provider string, template string, field string, rank int, text string")
    return prompts.resolved(jobs, rules, tasks=TASK_TEMPLATES, task_provider="p4").select("doc_id", "system", "user")


@query("""SELECT '/out/' || source || '/' || doc_id || '_zh_CN.md' AS path, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM documents WHERE text IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''""")
def translated_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("file:/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("uris"), "text")
    return sinks.translated_files(docs, "zh-CN", "/out/")


@query("""WITH p AS (SELECT l_suppkey % 20 AS pair, count(*) AS points, count(*) FILTER (l_linenumber < 6) AS inliers FROM lineitem GROUP BY 1)
SELECT pair, 'affine_partial' AS model, round(1 + pair / 10.0, 5)::DOUBLE AS a, round(pair / 50.0, 5)::DOUBLE AS b, (10.0 * pair)::DOUBLE AS x, (-3.0 * pair)::DOUBLE AS y, inliers, points FROM p""")
def image_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as matched points of 20 pairs of images: prices and quantities turned, scaled and moved; those of lines 6 and 7 are false."""
    pair, x, y = F.col("l_suppkey") % 20, F.col("l_extendedprice").cast("double") / 50, F.col("l_quantity").cast("double") * 20
    a, b, false = 1 + pair / 10.0, pair / 50.0, F.col("l_linenumber") >= 6
    u, v = a * x - b * y + 10.0 * pair + F.when(false, 4000 + 3 * y).otherwise(0), b * x + a * y - 3.0 * pair - F.when(false, 5000 + 2 * x).otherwise(0)
    found = alignment.aligned(read_table(spark, sf_dir, "lineitem").select(pair.alias("pair"), x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v")), "pair")
    at = lambda i: F.round(F.col("matrix")[i], 5) + 0.0  # noqa: E731  (no negative zero)
    return found.select("pair", "model", at(0).alias("a"), at(3).alias("b"), at(2).alias("x"), at(5).alias("y"), "inliers", "points")


def _waves(batches):
    """Rows (path, rate, values) as 16-bit WAVE files."""
    import struct

    import pandas as pd

    for batch in batches:
        raw = []
        for rate, values in zip(batch["rate"], batch["values"], strict=True):
            data = struct.pack(f"<{len(values)}h", *(int(32767 * max(-1.0, min(1.0, x))) for x in values))
            raw.append(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data)
        yield pd.DataFrame({"path": batch["path"], "content": raw})


@query("SELECT vec_id, 'audio/x-wav' AS mime, 0 AS width, 1 AS channels, 16 AS depth, (44 + 2 * len(embedding))::BIGINT AS size, floor(1000.0 * len(embedding) / (100 + coalesce(label, 0)))::DOUBLE AS duration, len(embedding)::INT AS num_frames, (100 + coalesce(label, 0))::DOUBLE AS frame_rate FROM embeddings")
def imported_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is written as a WAVE file whose rate is 100 and its label, and imported as an asset."""
    folder = f"{shared_dir(spark)}/waves-{uuid.uuid4().hex}"
    rows = read_table(spark, sf_dir, "embeddings").select(F.concat(F.lit(f"{folder}/"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), (100 + F.coalesce("label", F.lit(0))).alias("rate"), F.col("embedding").alias("values"))
    sinks.write_files(rows.mapInPandas(_waves, "path string, content binary")).write.format("noop").mode("overwrite").save()
    found = assets.import_media(assets.walk(spark, folder, content=True))
    found = materialize(found.select(F.regexp_extract("uris", r"(\d+)\.wav$", 1).cast("long").alias("vec_id"), "mime", "width", "channels", "depth", "size", F.col("duration").cast("double").alias("duration"), "num_frames", F.col("frame_rate").cast("double").alias("frame_rate")))
    remove(spark, folder)
    return found
