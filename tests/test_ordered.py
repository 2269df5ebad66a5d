"""Row numbers, ends of files and page functions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.sources import ordered, pages


def test_row_numbers_over_many_files(spark, tmp_path):
    """Gapless over files and row groups, the same with a filter, with fewer columns and on each read."""
    place = f"file://{tmp_path}/t"
    rows = spark.range(5000).withColumn("v", F.col("id") % 7).withColumn("row idx", F.lit("x"))
    rows.repartitionByRange(6, "id").write.option("parquet.block.size", "4096").parquet(place)
    rows.limit(0).write.mode("append").parquet(place)  # a file without rows
    whole = {r.id: r.row_idx for r in ordered.scan_in_order(spark, place).collect()}
    assert sorted(whole.values()) == list(range(5000))
    files = [r.file for r in ordered.file_offsets(spark, place).orderBy("offset").collect()]
    assert files == sorted(files) and len(files) >= 6
    found = ordered.scan_in_order(spark, place, ["id"], (F.col("v") == 3) & (F.col("id") > 2500), into="n")
    assert {r.id: r.n for r in found.collect()} == {i: n for i, n in whole.items() if i % 7 == 3 and i > 2500}
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "GreaterThan(id,2500)" in plan and "row idx" not in plan and "Exchange hashpartitioning" not in plan
    assert ordered.scan_in_order(spark, place, where=F.col("id") < 0).count() == 0


def test_ends_of_files(spark, tmp_path, monkeypatch):
    log, other = tmp_path / "sessions" / "2026", tmp_path / "archived"
    log.mkdir(parents=True), other.mkdir()

    def put(path, lines, at):
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (at, at))

    deep = {"x": [1, {"y": {"limits": {"left": 7}}}], "limits": 5}
    put(log / "a.jsonl", [json.dumps({"limits": {"left": 1}}), "not json", json.dumps(deep), "{broken", json.dumps({"limits": "text"}), ""], 100)
    put(other / "b.jsonl", [json.dumps({"limits": {"left": 2}})] + ["x" * 1000] * 400, 200)  # too far from its end
    put(log / "c.jsonl", ["nothing here"], 300)
    put(log / "d.txt", [json.dumps({"limits": {"left": 9}})], 400)
    folders = [f"file://{tmp_path}/{x}" for x in ("sessions", "archived", "none")]
    assert [p.rsplit("/", 1)[1] for p in ordered.newest_files(spark, folders)] == ["c.jsonl", "b.jsonl", "a.jsonl"]
    read, own = [], ordered.tail

    def counted(*args):
        read.append(len(raw := own(*args)))
        return raw

    monkeypatch.setattr(ordered, "tail", counted)
    path, found = ordered.latest_object(spark, folders, "limits")
    assert path.endswith("a.jsonl") and found == {"left": 7}
    assert len(read) == 3 and max(read) == ordered.TAIL < 400_000 and sum(read) < 3 * ordered.TAIL
    assert ordered.latest_object(spark, folders, "limits", files=2) is None and ordered.latest_object(spark, folders[2:], "limits") is None
    assert ordered.latest_object(spark, folders, "limits", most=1 << 20)[1] == {"left": 2}


def test_objects_at_any_depth(spark):
    rows = [(1, '{"a": [[], {"k": {"b": 1, "a": 2}}]}'), (2, '{"k": [1]}'), (3, "{"), (4, None), (5, ""), (6, "[" * 5000), (7, '{"q": {"k": {"deep": 1}}, "k": {"top": 1}}')]
    got = {r.n: r.found for r in ordered.objects_under(spark.createDataFrame(rows, "n int, t string"), "t", "k").collect()}
    assert got == {1: '{"a": 2, "b": 1}', 2: None, 3: None, 4: None, 5: None, 6: None, 7: '{"top": 1}'}


def test_pages_of_a_plugin(spark):
    docs = spark.createDataFrame([(1, "one\ftwo\f", "pdf"), (2, "only", "pdf"), (3, None, "pdf"), (4, "a\fb", "png")], "id int, raw string, page string")
    got = pages.input_pages(docs.withColumnRenamed("page", "kind"), "raw", lambda: pages.form_feeds, paged=F.col("kind") == "pdf", name="pages_a").collect()
    assert sorted((r.id, r.kind, r.page, r.body) for r in got if r.page is not None) == [(1, "pdf", 0, "one"), (1, "pdf", 1, "two"), (2, "pdf", 0, "only")]
    assert [(r.id, r.page, r.body) for r in got if r.page is None] == [(4, None, "a\fb")]

    def numbered():  # says pages and their number itself, in another type
        def render(text):
            found = text.split("\f")
            for i, t in reversed(list(enumerate(found))):
                yield t.encode(), i, len(found)

        return render

    got = pages.input_pages(docs.select("id", "raw"), "raw", numbered, name="pages_b", body="binary").where("id = 4").collect()
    assert [(r.page, r.pages, bytes(r.body)) for r in got] == [(1, 2, b"b"), (0, 2, b"a")]
    with pytest.raises(Exception, match="holds no pages"):
        pages.input_pages(docs.select("id", "raw"), "raw", lambda: lambda text: iter(()), name="pages_c").collect()
