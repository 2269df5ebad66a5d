"""The registered queries of this subpackage: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import re
import string
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, hard_negatives, licenses, line_dedup, line_quality, near_dedup, packing, pii, token_counts, toxicity, url_rules, vector_codes, warc
from millrace.session import materialize, read_table, remove, shared_dir


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.attribute(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES))
    return url_rules.judge(read_table(spark, sf_dir, "pages"), spark.range(1).select(F.inline(rules)))


OP3_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}) AS t(h, p, v))
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY row, page_id, host, path
"""


def pii_key(spark: SparkSession) -> str:
    """The secret of the surrogates; the default is for tests."""
    return spark.conf.get("spark.millrace.pii.key", "not a secret")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii_key(spark))
    return found.select("doc_id", "text", *(F.col(f"pii_found.{k}").alias(f"n_{k}") for k in pii.PATTERNS))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(read_table(spark, sf_dir, "documents"), width=4)


_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
OP6_SQL = rf"""
WITH i AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM i)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS t FROM (SELECT d.doc_id, d.ws, l.n, unnest(range(1, len(d.ws) - l.n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM v) l)),
m AS (SELECT g.doc_id, g.k, g.n, v.item_id FROM g JOIN v USING (n, t)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM m) GROUP BY doc_id),
e AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM e GROUP BY doc_id),
dp AS (SELECT doc_id, len(ws) AS n_words, unnest(range(len(ws))) AS place, unnest(ws) AS word FROM d),
f AS (SELECT word, count(*) AS times FROM dp GROUP BY word),
wt AS (SELECT n, t, unnest(range(n)) AS j, unnest(string_split(t, ' ')) AS word FROM (SELECT DISTINCT n, t FROM v)),
wr AS (SELECT wt.*, row_number() OVER (PARTITION BY n, t ORDER BY coalesce(times, 0), j) AS rarity FROM wt LEFT JOIN f USING (word)),
c AS (SELECT DISTINCT doc_id, n, t, place - j + shift AS start FROM dp JOIN wr USING (word), (SELECT unnest(range(-3, 4)) AS shift) WHERE rarity <= n // 5 + 1 AND place - j + shift BETWEEN 0 AND n_words - n),
r AS (SELECT c.doc_id, c.n, c.t, c.start FROM c JOIN wt USING (n, t) JOIN dp ON dp.doc_id = c.doc_id AND dp.word = wt.word AND dp.place BETWEEN c.start + wt.j - 3 AND c.start + wt.j + 3 GROUP BY ALL HAVING count(DISTINCT wt.j) >= c.n - c.n // 5),
x AS (SELECT doc_id, count(*) AS n_near_items FROM (SELECT DISTINCT r.doc_id, v.item_id::VARCHAR AS item FROM r JOIN v USING (n, t) ANTI JOIN e ON e.doc_id = r.doc_id AND e.item = v.item_id::VARCHAR) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, place = read_table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(pages, place)
    back = warc.read(spark, place, with_payload=False)
    kind = pages.schema["page_id"].dataType
    found = back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
    found = materialize(found)
    remove(spark, place)
    return found


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents")).drop("spans")


def _op9_sql() -> str:
    """The rule of the scan in SQL: words and places, not hashes."""
    rows, needs = [], []
    for k, (text, label) in enumerate(licenses.PHRASES):
        rows += [(k, label, "true", len(text.split()), i, w, "false") for i, w in enumerate(text.split())]
    for k, ((text, label), tells) in enumerate(zip(licenses.TEMPLATES, licenses.telling(licenses.TEMPLATES), strict=True), len(licenses.PHRASES)):
        words = re.findall("[0-9a-z]+", text.lower())
        rows += [(k, label, "false", len(words), i, w, str(w in tells).lower()) for i, w in enumerate(words)]
        needs += [str(k)] * bool(tells)
    values = ", ".join(f"({k}, '{label}', {base}, {n}, {i}, '{w}', {tells})" for k, label, base, n, i, w, tells in rows)
    return rf"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT row, k - 1 AS place, ws[k] AS a, ws[k + 1] AS b FROM (SELECT row, ws, unnest(range(1, len(ws))) AS k FROM w)),
e AS (SELECT * FROM (VALUES {values}) AS v(template, label, base, words, i, word, tells)),
t AS (SELECT x.template, x.label, x.base, x.words, x.i, x.word AS a, y.word AS b, x.tells OR y.tells AS tells FROM e x JOIN e y ON x.template = y.template AND y.i = x.i + 1),
v AS (SELECT row, template, label, base, words, tells, place, i, place - i AS diagonal, count(*) OVER (PARTITION BY row, template, place - i) AS votes FROM p JOIN t USING (a, b)),
d AS (SELECT DISTINCT row, template, diagonal FROM v WHERE CASE WHEN base THEN votes = words - 1 ELSE votes >= least(2, words - 1) END),
g AS (SELECT *, lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) AS before FROM d),
n AS (SELECT *, sum(CASE WHEN diagonal - before <= {licenses.NEIGHBOURS} THEN 0 ELSE 1 END) OVER (PARTITION BY row, template ORDER BY diagonal) AS island FROM g),
s AS (SELECT row, template, label, base, words, CASE WHEN base THEN diagonal ELSE island END AS span, min(place) AS first, max(place) + 2 AS until, count(DISTINCT i) AS pairs, bool_or(tells) AS tells, list_distinct(list_concat(list(i), list(i + 1))) AS held FROM v JOIN n USING (row, template, diagonal) GROUP BY ALL),
o AS (SELECT row, template, label, words, first, until, len(held) / greatest(words, until - first) AS share, pairs / (words - 1) AS close FROM s WHERE NOT base AND pairs >= {licenses.MIN_PAIRS} * (words - 1) AND len(held) >= {licenses.MIN_WORDS} * greatest(words, until - first) AND (tells OR template NOT IN ({", ".join(needs)}))),
k AS (SELECT row, label, share FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.row = x.row AND y.label <> x.label AND y.first < x.until AND x.first < y.until AND (y.close > x.close OR y.close = x.close AND (y.words > x.words OR y.words = x.words AND y.template < x.template)))),
b AS (SELECT row, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, list_distinct(list(label)) AS base_labels FROM s WHERE base GROUP BY row),
l AS (SELECT row, list_distinct(list(label)) AS labels, max(share) AS score FROM (SELECT row, label, share FROM k UNION ALL SELECT row, label, 1.0 FROM s WHERE base) GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base_labels, [])), ',') AS base_labels, array_to_string(list_sort(coalesce(labels, [])), ',') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN b USING (row) LEFT JOIN l USING (row)
"""


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(read_table(spark, sf_dir, "documents"), with_text=False)


def _op10_sql() -> str:
    space = r"[\x09-\x0D\x1C-\x1F\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    word = rf"[^{space[1:]}+"
    line = line_quality
    quoted = lambda pattern: pattern.replace("'", "''")
    ended = quoted(rf"[{line.STOPS}][{re.escape(line.CLOSERS)}]*{space}*$")
    cased = "2 * len(list_filter(regexp_extract_all(line, '\\pL'), lambda x: lower(x) <> upper(x))) > len(regexp_extract_all(line, '\\pL'))"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM t),
g AS (SELECT row, unnest(range(1, len(ws) - 1)) AS k, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) AS gram FROM w),
r AS (SELECT row, count(DISTINCT place) AS n_repeat_words FROM (SELECT row, unnest([k, k + 1, k + 2]) AS place FROM (SELECT row, k FROM g QUALIFY count(*) OVER (PARTITION BY row, gram) > 1)) GROUP BY row),
l AS (SELECT row, unnest(range(len(x))) AS place, unnest(x) AS line FROM (SELECT row, string_split(text, chr(10)) AS x FROM t)),
b AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
m AS (SELECT *, lower(line) AS low, regexp_extract_all(line, '{word}') AS words, regexp_replace(regexp_replace(line, '^{space}+', ''), '{space}+$', '') AS bare, len(regexp_extract_all(line, '[|»›•·]')) AS bars, len(regexp_extract_all(line, '[#*$%&|<>{{}}=~^\\]')) AS symbols FROM l),
j AS (SELECT *, len(words) AS n, row_number() OVER (PARTITION BY row, bare ORDER BY place) > 1 AS again, ' ' || trim(regexp_replace(low, '[^\pL\pN_]+', '  ', 'g')) || ' ' AS plain FROM m),
q AS (SELECT row, line, n > 0 AND (again OR NOT regexp_matches(line, '\pL') OR bars > 2 AND 5 * bars > n
  OR n <= {line.NAVIGATION_WORDS} AND regexp_matches(plain, '^{line.phrases(line.NAVIGATION)}') AND NOT regexp_matches(line, '{ended}')
  OR n > 2 AND 5 * symbols > 2 * n
  OR n <= {line.BOILERPLATE_WORDS} AND coalesce(list_sum(list_transform(regexp_extract_all(plain, '{line.phrases(line.BOILERPLATE)}'), lambda x: len(string_split(trim(x), '  ')))), 0) >= greatest(1, {line.BOILERPLATE_SHARE} * n)
  OR n >= 5 AND line = upper(line) AND {cased} OR n >= 12 AND NOT regexp_matches(line, '[{line.STOPS}]') AND (NOT regexp_matches(line, '[{line.UNMARKED}]') OR {cased})
  OR n >= 20 AND 10 * len(list_distinct(list_transform(words, lambda x: lower(x)))) < 3 * n) AS fails FROM j),
k AS (SELECT row, count(*) FILTER (fails) AS lines_removed, greatest(coalesce(sum(length(line) + 1) FILTER (NOT fails), 0) - 1, 0) AS n_left FROM q GROUP BY row),
o AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed, lines_removed, 2 * n_left >= length(text) AS enough FROM t JOIN w USING (row) JOIN k USING (row) LEFT JOIN r USING (row) LEFT JOIN b USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines_removed, NOT base_failed AND enough AS kept FROM o
"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    found = line_dedup.clean(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, keep_first=False, folder=folder)
    found = materialize(found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")))
    remove(spark, folder)
    return found


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
s AS (SELECT row, pos, line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key)),
g AS (SELECT row, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM s GROUP BY row)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN g USING (row)
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    coded, books = vector_codes.encode(read_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096, folder=folder)
    found = materialize(vector_codes.digest(coded, books))
    remove(spark, folder)
    return found


def _op12_sql(rounds: int = 6) -> str:
    """Lloyd's rounds one after the other, without bounds."""
    codes = lambda k: f"""
a{k} AS MATERIALIZED (SELECT row, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
  SELECT x.row, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{k} c USING (part, pos) GROUP BY x.row, x.part, c.entry) GROUP BY row, part)"""  # noqa: E731
    books = lambda k: f"""
c{k} AS MATERIALIZED (SELECT o.part, o.entry, o.pos, coalesce(m.v, o.v) AS v FROM c{k - 1} o LEFT JOIN (
  SELECT part, entry, pos, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM x JOIN a{k - 1} USING (row, part) GROUP BY part, entry, pos) m USING (part, entry, pos))"""  # noqa: E731
    steps = [codes(0), *(f"{books(k)},{codes(k)}" for k in range(1, rounds + 1))]
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row, i * 8 // n AS part, i % (n // 8) AS pos, floor(4096 * v::DOUBLE)::BIGINT AS v FROM (SELECT row, len(e) AS n, unnest(range(len(e))) AS i, unnest(e) AS v FROM k)),
c0 AS MATERIALIZED (SELECT part, row AS entry, pos, v FROM x WHERE row < 16),{",".join(steps)},
r AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM k JOIN r USING (row) GROUP BY label),
b AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM k JOIN r USING (row) JOIN l ON k.label IS NOT DISTINCT FROM l.label CROSS JOIN b
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = materialize(hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label, folder=folder))
    remove(spark, folder)
    return found


OP13_SQL = """
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.row AS a, a.vec_id AS anchor_id, b.row AS b, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM k a JOIN k b ON a.vec_id % 50 = 0 AND a.row <> b.row),
p AS (SELECT a, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.a, p.place ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3)
SELECT * FROM n
"""


QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_url_rules": op3_url_rules,
    "op4_pii": op4_pii,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_licenses": op9_licenses,
    "op10_line_quality": op10_line_quality,
    "op11_line_dedup": op11_line_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op3_url_rules": OP3_SQL, "op5_near_duplicates": OP5_SQL, "op6_decontamination": OP6_SQL, "op8_warc": OP8_SQL, "op9_licenses": _op9_sql(), "op10_line_quality": _op10_sql(), "op11_line_dedup": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_hard_negatives": OP13_SQL}
