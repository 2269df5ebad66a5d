"""What only larger tables hold or show: one small test for each finding of the third review."""

import pytest

pytest.importorskip("pyspark")

from pyspark.sql import functions as F  # noqa: E402

from millrace.functions import documents as df  # noqa: E402
from millrace.functions import text as tx  # noqa: E402


def test_references_without_a_semicolon():
    page = '<title>a &amp;&amp; b&amp</title><style>p{}</style>&ampx &copy; &#65; &#65 &quot<br>&'
    assert df.html_to_markdown(page, closed=True) == "a && b&ampp{}&ampx © A &#65 &quot\n&"
    assert df.html_to_markdown(page) == 'a && b&p{}&x © A A "\n&'
    assert df.html_to_markdown('<script>x("&amp") && y</script>', closed=True) == 'x("&amp") && y'


def test_years_of_five_digits(spark):
    told = ("253402300799", "253402300800", "2507383500000", "soon")
    row = spark.range(1).select(*(tx.epoch_text(F.lit(x)).alias(f"t{i}") for i, x in enumerate(told))).first()
    assert tuple(row) == ("9999-12-31 23:59:59", "10000-01-01 00:00:00", "81425-10-27 08:40:00", "")


def test_reset_times_of_large_keys(spark, tmp_path):
    import duckdb

    from millrace.plans import catalog, outputs

    keys = [0, 1, 2_900_001, 6_667_253, 6_667_254, 6_667_257, 8_999_999, 36_000_001]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    with duckdb.connect() as own:
        own.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        want = sorted(own.sql(catalog.ORACLES["reset_times"]).fetchall())
    assert sorted(map(tuple, outputs.reset_times(spark, str(tmp_path)).collect())) == want


def test_blocks_of_near_copies(spark):
    """A class is in each of its blocks once and, among those of its block's pairs, reported once; pairs of small classes meet once."""
    near_dedup = pytest.importorskip("millrace.llm.near_dedup")
    pa, np = pytest.importorskip("pyarrow"), pytest.importorskip("numpy")
    from millrace.llm._text import row_type

    n, bands = 6, near_dedup.BANDS
    rows = [(0, 7, bytes([k]), bytes([k]), b"most", 1, 1, 100, bytes(2 * near_dedup.PERMUTATIONS), [9] * bands) for k in range(n)]
    rows += [(0, 7, bytes([n + k]), b"most", b"most", 1, 1, 100, bytes(2 * near_dedup.PERMUTATIONS), [9] * bands) for k in range(3)]
    live = spark.createDataFrame(rows, "band int, hash long, key binary, component binary, most binary, outer_blocks int, inner_blocks int, n long, sig binary, all_bands array<long>")
    cells = near_dedup._cells(live)
    assert cells.count() == n + 3 and "Union" not in cells._jdf.queryExecution().toString()
    schema = row_type("band int, hash long, outer_block int, inner_block int, key binary, component binary, partners array<binary>")[1]
    found = [r for b in near_dedup._candidates(iter(cells.toArrow().to_batches()), schema) for r in b.to_pylist()]
    assert sorted(r["key"] for r in found) == [bytes([k]) for k in range(n + 3)]
    pairs = {(r["key"], p) for r in found for p in r["partners"] or ()}
    assert pairs == {(bytes([a]), bytes([b])) for a in range(n) for b in range(a + 1, n + 3)}
    many = near_dedup._cells(live.withColumn("outer_blocks", F.lit(2)).withColumn("inner_blocks", F.lit(3))).collect()
    met = {(bytes(x["key"]), bytes(y["key"])) for x in many if x["outer"] for y in many if y["inner"] and (x["outer_block"], x["inner_block"]) == (y["outer_block"], y["inner_block"])}
    assert met == {(bytes([a]), bytes([b])) for a in range(n) for b in range(n + 3)}
    assert np.unique([(r["outer_block"], r["inner_block"], r["key"][0]) for r in many], axis=0).shape[0] == len(many) and pa is not None


def test_cues_and_blocks_are_not_broadcast(spark, small):
    from millrace.plans import catalog, signals

    for query in (signals.coherent_subtitles, catalog.cue_scene_overlap):
        assert "BroadcastExchange" not in query(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_answers_are_parsed_once(spark):
    """Each value that a rule names again is made once: plans that hold it many times over take that much longer a row."""
    from millrace.operators import responses

    text = F.concat(F.lit("{"), F.col("id").cast("string"), F.lit("}"))
    plan = lambda c: spark.range(1).select(c.alias("a")).select("a.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan(responses.freeform(text)).count("split(") == 1
    assert all(plan(f(text)).count("try_parse_json") <= 2 or plan(f(text)).lower().count("parsejson") <= 2 for f in (responses.caption, responses.parts))
    assert all(len(plan(f(text))) < 12_000 for f in (responses.freeform, responses.caption, responses.parts))


@pytest.mark.parametrize("query", ["text_tails", "text_placeholders"])
def test_texts_go_to_python_in_small_batches(spark, small, query):
    import pandas as pd

    from millrace.plans import catalog

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    catalog.QUERIES[query](spark, small)
    try:
        size = F.pandas_udf(lambda x: pd.Series([int(x.str.len().sum())] * len(x)), "long")
        rows = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), F.lit(50_000)).alias("t"))
        assert rows.select(size("t").alias("n")).agg(F.max("n")).first()[0] <= 5 << 20
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_files_of_many_media_are_not_listed(spark, small, tmp_path):
    """Each task opens the paths it holds; of a table's folder the driver lists what stands in it, not a file for each medium."""
    from millrace.plans import signals

    found = spark._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    spark.read.parquet(f"{small}/events.parquet").where("user_id < 40").write.parquet(f"{tmp_path}/events.parquet")
    before = found.getCount()
    rows = signals.event_files_read_back(spark, str(tmp_path)).collect()
    assert found.getCount() - before < len(rows)


def test_events_are_read_in_parts(spark, tmp_path, monkeypatch):
    import io
    import json

    from millrace.sources import event_files

    events = [("start", 36 + k % 48, k / 8, k, ["Ünison", "a\"b\\", None][k % 3], 0.0, 0) if k % 2 else ("end", 0, 0.0, 0, None, k / 8, k - 1) for k in range(1, 60)]
    plain = [{"type": "start", "pitch": e[1], "start_time": e[2], "index": e[3], "instrument": e[4] or ""} if e[0] == "start" else {"type": "end", "end_time": e[5], "start_event_index": e[6]} for e in events]
    raw = {}
    for name, bound in (("whole", None), ("parts", 7)):
        if bound:
            monkeypatch.setattr(event_files, "AT_ONCE", bound)
            monkeypatch.setattr(event_files, "IN_MEMORY", bound)
        files, base = event_files.fs.FileSystem.from_uri(f"file://{tmp_path}/{name}")
        files.create_dir(base)
        own = event_files._Files(name, files, base, {})
        for e in events:
            own.add(*e)
        told = own.commit()
        assert told[1:4] == (59, 30, ["a\"b\\", "Ünison"])
        raw[name] = [open(p, "rb").read() for p in told[4:]]
    assert raw["whole"] == raw["parts"]
    array, lines, _ = raw["parts"]
    assert array.decode() == json.dumps(plain, ensure_ascii=False, indent=2) + "\n"
    read = lambda f, x: [json.loads(t) for part in f(io.BytesIO(x)) for t in part]
    assert read(event_files.item_texts, array) == read(event_files.line_texts, lines) == read(event_files.line_texts, lines.rstrip()) == plain
    assert read(event_files.item_texts, b'[{"a": 1}, {"b": [{}]}, 5, {"c": 1}]') == [{"a": 1}, {"b": [{}]}] and read(event_files.item_texts, b"") == read(event_files.item_texts, b"[]\n") == []

    (tmp_path / "odd.jsonl").write_bytes(b'{"type":"start","pitch":1}\n\nno\n{"type":"end","end_time":"x"}')
    paths = spark.createDataFrame([(f"file://{tmp_path}/whole/whole.json",), (f"{tmp_path}/whole/whole.jsonl",), (f"{tmp_path}/odd.jsonl",)], "path string")
    counts = {r.path[-10:]: (r.n, r.s) for r in event_files.read_events(paths).groupBy("path").agg(F.count("type").alias("n"), F.sum("index").alias("s")).collect()}
    total = sum(e["index"] for e in plain if e["type"] == "start")
    assert counts["whole.json"] == (59, total) and counts["hole.jsonl"] == (59, total) and counts["/odd.jsonl"][0] in (1, 2)
    event_files.remove_files(paths)
    assert [p.name for p in (tmp_path / "whole").iterdir()] == ["whole.mid"]


def test_media_are_dealt_to_folders(spark, tmp_path):
    from millrace.sources import event_files

    rows = [(k, 1, "start", 60, 0.5, 1, "x", None, None) for k in range(40)]
    told = event_files.write_events(spark.createDataFrame(rows, f"k long, seq long, {event_files.EVENT}"), "k", f"file://{tmp_path}/out", folders=4).localCheckpoint()
    assert len(list((tmp_path / "out").iterdir())) == 4 and len(list((tmp_path / "out").glob("*/*"))) == 120
    assert event_files.read_midi(told.select(F.col("mid").alias("path"))).where("pitch = 60 and onset = 0.5").count() == 40
