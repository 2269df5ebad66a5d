"""Versions, keyed updates, sources, sinks, streams and workflows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace import schema
from millrace.functions import documents as df
from millrace.functions import text as tx
from millrace.operators import captions, media, tags
from millrace.plans import workflows
from millrace.sources import assets, sinks, versions
from millrace.streaming import incremental


def values(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.fixture
def data(spark, tmp_path):
    made = versions.Dataset(spark, f"file://{tmp_path}/set")
    made.write(spark.createDataFrame([("a", "image/png", bytearray(b"1"), ["x"], 1), ("b", "image/png", bytearray(b"2"), None, 2)], "uris string, mime string, blob binary, captions array<string>, count long"), "create", tag="raw")
    return made


def test_keyed_update(spark, data):
    assert data.update(spark.createDataFrame([("a", ["new"]), ("b", ["two"])], "uris string, captions array<string>"), "uris", tag="up") == 2
    got = {r["uris"]: r for r in data.read("up").collect()}
    assert got["a"]["captions"] == ["new"] and bytes(got["b"]["blob"]) == b"2" and got["b"]["count"] == 2
    assert {r["uris"]: r["captions"] for r in data.read("raw").collect()} == {"a": ["x"], "b": None}
    assert data.update(spark.createDataFrame([], "uris string, captions array<string>"), "uris") is None and data.latest() == 2


@pytest.mark.parametrize("rows, ddl", [
    ([("a", ["1"]), ("a", ["2"])], "uris string, captions array<string>"), ([("z", ["1"])], "uris string, captions array<string>"),
    ([("a", 1)], "uris string, other int"), ([("a", ["1"])], "key string, captions array<string>"), ([(None, ["1"])], "uris string, captions array<string>"),
])
def test_invalid_updates_leave_the_version(spark, data, rows, ddl):
    with pytest.raises(versions.UpdateError):
        data.update(spark.createDataFrame(rows, ddl), "uris")
    assert data.latest() == 1


def test_update_of_a_key_that_is_not_unique(spark, data):
    data.write(data.read().unionByName(data.read().where("uris = 'a'")))
    with pytest.raises(versions.UpdateError, match="not unique"):
        data.update(spark.createDataFrame([("a", 5)], "uris string, count long"), "uris")


def test_ragged_update(spark, data):
    given = spark.createDataFrame([("a", None, 9, True, False), ("b", ["y"], 9, False, True)], "uris string, captions array<string>, count long, has_c boolean, has_n boolean")
    got = {r["uris"]: (r["captions"], r["count"]) for r in versions.updated(data.read(), given, "uris", {"captions": "has_c", "count": "has_n"}).collect()}
    assert got == {"a": (None, 1), "b": (None, 9)}


def test_tags_move(spark, data):
    data.write(data.read().limit(1))
    assert data.tag("raw") == 2 and data.read("raw").count() == 1 and data.resolve("raw") == 2
    with pytest.raises(KeyError):
        data.read("none")
    with pytest.raises(FileExistsError):
        data.write(data.read(), "create")


def test_tag_parts(spark):
    assert [values(spark, versions.tag_part(F.lit(x))) for x in ("a b//c", "..x_-", "  ", "")] == ["a_b_c", "x", "default", "default"]


def test_folder_import(spark, tmp_path):
    for name, text in (("d/clip.mp4", "m"), ("d/clip.txt", "one\ntwo\n"), ("d/notes.txt", "n"), ("d/doc.pdf", "p"), ("d/doc.md", "a\nb"), ("e/clip.txt", "t"), ("e/x.unknown", "u")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = assets.walk(spark, f"file://{tmp_path}", content=True)
    leaf = lambda rows: sorted("/".join(r["path"].split("/")[-2:]) for r in rows)
    own = assets.primary_assets(files.select("path"))
    assert leaf(own.collect()) == ["d/clip.mp4", "d/doc.pdf", "d/notes.txt", "e/clip.txt"]
    assert leaf(assets.primary_assets(files.select("path"), include_texts=False).collect()) == ["d/clip.mp4", "d/doc.pdf"]
    assert len(assets.primary_assets(files.select("path"), texts_apart=True).collect()) == 6
    side = {"/".join(r["path"].split("/")[-2:]): r["sidecar"] and r["sidecar"].split("/")[-1] for r in assets.sidecars(own.select("path"), files.select("path")).collect()}
    assert side == {"d/clip.mp4": "clip.txt", "d/doc.pdf": "doc.md", "d/notes.txt": None, "e/clip.txt": None}
    lines = files.where("path like '%.txt' or path like '%.md'").select("path", assets.sidecar_lines(F.col("path"), F.decode("content", "utf-8")).alias("x"))
    assert {"/".join(r["path"].split("/")[-2:]): r["x"] for r in lines.collect()}["d/clip.txt"] == ["one", "two"]
    made = assets.import_texts(files.where("path like '%notes.txt'")).first()
    assert made["mime"] == "text/plain" and made["size"] == 1 and made["width"] == 0 and len(made["hash"]) == 64 and made["captions"] is None
    table, check = f"file://{tmp_path}/../table-{tmp_path.name}", f"file://{tmp_path}/../check-{tmp_path.name}"
    for n in (7, 8):
        incremental.import_stream(spark, f"file://{tmp_path}", table, check).awaitTermination()
        assert spark.read.parquet(table).count() == n
        (tmp_path / "e/later.txt").write_text("later")


def test_media_probe(spark, tmp_path):
    import struct
    import wave

    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", 640, 480, 8, 6) + b"\0" * 10)
    (tmp_path / "b.png").write_bytes(b"broken")
    with wave.open(str(tmp_path / "c.wav"), "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes(b"\0" * 4 * 12_000)
    files = assets.walk(spark, f"file://{tmp_path}", content=True)
    rows = {r["uris"].rsplit("/", 1)[1]: r for r in assets.import_media(files).collect()}
    assert set(rows) == {"a.png", "c.wav"}
    png, wav = rows["a.png"], rows["c.wav"]
    assert (png["width"], png["height"], png["channels"], png["depth"], png["mime"], png["has_audio"]) == (640, 480, 4, 8, "image/png", False)
    assert (wav["duration"], wav["channels"], wav["num_frames"], wav["frame_rate"], wav["has_audio"], wav["size"]) == (1500, 2, 12_000, 8000.0, True, 48_044)
    assert wav["hash"] == hashlib.sha256((tmp_path / "c.wav").read_bytes()).hexdigest()
    plugin = lambda path, raw: (len(raw), 1, 1, 8, 0, 1, 0.0) if path.endswith("b.png") else None
    (own,) = assets.probe_media(files, plugin).collect()
    assert own["width"] == 6


def test_vocabularies(spark, tmp_path):
    (tmp_path / "tags.csv").write_text("tag_id,name,category\n2,b,4\n1,a,0\n3,c,9\n")
    assert [tuple(r) for r in assets.tag_table(spark, str(tmp_path / "tags.csv")).orderBy("idx").collect()] == [(0, "a", "general"), (1, "b", "character"), (2, "c", "rating")]
    (tmp_path / "imp.csv").write_text("id,x,child,parent\n1,,c1,p\n2,,c2,p\n3,,c1,p\n4,,,q\n")
    assert [tuple(r) for r in assets.implications(spark, str(tmp_path / "imp.csv")).collect()] == [("p", ["c1", "c2"])]
    lines = spark.createDataFrame([("1, B , 24 MiB",), ("0,A,16",), ("x,C,1",), ("short",)], "value string")
    assert [tuple(r) for r in assets.devices(lines).collect()] == [(0, "A", 16), (1, "B", 24)]
    paths = spark.createDataFrame([("d/a.png",), ("d/a_10.png",), ("d/a_2.png",), ("d/a_x.png",), ("d/a_1.jpg",)], "path string")
    assert [tuple(r) for r in assets.numbered_extras(paths).orderBy("number").collect()] == [("d/a.png", "d/a_2.png", 2), ("d/a.png", "d/a_10.png", 10)]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/a.mp4", ["1", "2"]), (f"{tmp_path}/b.gif", ['<font color="green">x</font>', "y"]), (f"{tmp_path}/c.pdf", ["p", "q"]), (f"{tmp_path}/d.png", []), (f"{tmp_path}/e.png", None)], "uris string, captions array<string>")
    sinks.write_files(sinks.caption_files(rows)).collect()
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a.srt": "1\n2", "b.txt": "x\ny\n", "c.md": "pq"}
    again = sinks.write_files(sinks.caption_files(rows), overwrite=False).collect()
    assert not any(r["written"] for r in again)
    assert values(spark, sinks.safe_under("/base", F.lit("../../etc/passwd"))) == "/base/passwd" and values(spark, sinks.safe_under("/base/", F.lit(".."))) == "/base/file"
    parts = spark.createDataFrame([(1, 1, "second"), (1, 0, "first"), (2, 0, "# A\nx\n## B\ny"), (3, 0, "plain")], "doc int, page int, text string")
    whole = sinks.assembled_pages(parts.where("doc = 1"), "doc", "page", "text").unionByName(parts.where("doc > 1").select("doc", "text"))
    assert [tuple(r) for r in sinks.pages(whole, "doc", "text").orderBy("doc", "page").collect()] == [(1, 0, "page_1", "first"), (1, 1, "page_2", "second"), (2, 0, "A", "# A\nx"), (2, 1, "B", "## B\ny"), (3, 0, "whole", "plain")]
    sinks.write_buckets(spark.createDataFrame([(1, 5.0), (2, 7.5)], "id int, bucket double"), f"file://{tmp_path}/buckets")
    assert {r["id"]: r["bucket"] for r in spark.read.parquet(f"file://{tmp_path}/buckets").collect()} == {1: 5.0, 2: 7.5}


def test_resumption(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, signature string")
    assert sorted(r["id"] for r in incremental.pending(items, spark.createDataFrame([(1, "a"), (2, "old")], "id int, signature string"), "id").collect()) == [2, 3]
    stage = incremental.resume_stage(F.array(F.lit("one"), F.lit("three")), ("one", "two", "three"))
    assert values(spark, stage) == "two"


def test_translation_workflow(spark, tmp_path):
    data = versions.Dataset(spark, f"file://{tmp_path}/set")
    text = "hello world.\r\n\r\nnext `code` line."
    data.write(spark.createDataFrame([("story.txt", [text], bytearray(b"raw"))], "uris string, captions array<string>, blob binary"), "create", tag="raw.import")
    workflows.normalize(data, most=20, tag="norm")
    row = data.read("norm").first()
    assert row["captions"] == ["hello world.\n\nnext `code` line.\n"] and row["chunk_offsets"][-1] == len(row["captions"][0])
    seen = workflows.translate(data.read("norm"), lambda: lambda text, context: text.upper())
    workflows.merge_translations(data, seen, "tr.upper")
    done = data.read("tr.upper").first()
    assert done["captions"] == ["HELLO WORLD.\n\nNEXT `code` LINE.\n"] and bytes(done["blob"]) == b"raw" and data.read("raw.import").first()["captions"] == [text]


def test_chunks_join_to_the_text():
    rng = random.Random(4)
    pieces = ["# Head\n", "para one. Two!\n", "- item\n", "  more\n", "> quote\n", "| a | b |\n", "|---|---|\n", "```py\n", "x = 1\n", "```\n", "\n", "word " * 30, "http://a.b/c.d? e. ", "\n\n", "~~~\n"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        for most in (7, 40, 2000):
            ends = df.chunk_offsets(text, most)
            assert "".join(df.slices(text, ends)) == text and ends == sorted(set(ends))
    with pytest.raises(ValueError):
        df.chunk_offsets("x", 0)


def test_code_and_tables_are_not_split():
    text = "```\n" + "line of code\n" * 20 + "```\n\n| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 20
    assert [len(x) for x in df.slices(text, df.chunk_offsets(text, 50))] == [text.index("| a"), len(text) - text.index("| a")] or df.chunk_offsets(text, 50)[-1] == len(text)


def test_documents():
    assert df.restore(*df.protect("a `b` http://x.y/z ./p/q ```c\nd```")) == "a `b` http://x.y/z ./p/q ```c\nd```"
    assert df.collapse_tail("start " + "ab " * 4000) == "start ab " and df.collapse_tail("x" * 50) == "x" * 50
    assert df.collapse_tail("text\n" + "1\n" * 6000) == "text"
    assert df.html_to_markdown('<p>a &amp; b</p><img src="x"><div class="code">x = 1</div><br>end') == "a & b\n\n```code\nx = 1\n```\n\nend"
    assert [df.decode(x) for x in (b"\xef\xbb\xbfa", "漢".encode("gb18030"), None)] == ["a", "漢", ""]


def test_repeated_tails_of_a_plain_version():
    rng = random.Random(8)

    def plain(text, least, longest, chars, times):
        if len(text) < max(least, 2):
            return None
        for p in range(1, min(longest, len(text) - 1) + 1):
            n = p
            while n < len(text) and text[len(text) - 1 - n] == text[len(text) - 1 - n + p]:
                n += 1
            if n > p and n >= chars and n // p >= times:
                return p, n
        return None

    for _ in range(400):
        unit = "".join(rng.choice("ab \n") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) + unit * rng.randint(0, 12) + unit[: rng.randint(0, len(unit))]
        limits = {"least": rng.choice([0, 30]), "longest": rng.choice([3, 20]), "chars": rng.choice([1, 25]), "times": rng.choice([2, 5])}
        assert df.repeated_tail(text, **limits) == plain(text, **limits), (text, limits)


def test_html_blocks():
    cases = {
        "a\r\nb": "a\nb", "x < y": "x < y", "<b>x</b> &lt;i&gt; &amp;nbsp;&nbsp;y": "x <i> &nbsp; y", "a<br/>b<br>c": "a\nb\nc", "<p>a</p><p>b</p>": "a\n\nb",
        '<div class="pseudocode">if x\n```y</div>': "```\nif x\ny\n```", '<div class="big chart">graph\n%% note\nA-->B</div>': "```mermaid\ngraph\n\nA-->B\n```",
        '<div class="chart">mermaid\nA</div>': "```mermaid\nA\n```", '<div class="music">X:1\nZ: who\n\nabc </div>': "```abc\nX:1\nabc\n```", '<div class="code"></div>z': "z",
        '<div class="table"><div>in</div>side</div>out': "in\nside\n\nout", '<div class="code">open': "```code\nopen\n```", "</div></p>x": "x", '<div class="code">a &lt;b&gt;</div>': "```code\na <b>\n```",
    }
    assert {k: df.html_to_markdown(k) for k in cases} == cases and df.html_to_markdown(None) == ""


def test_chunks_of_every_kind_of_block():
    text = "# Title\n\n> quoted\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = 1\n```\n\nLast words.\n"
    parts = df.slices(text, df.chunk_offsets(text, 30))
    assert "".join(parts) == text and [p.strip() for p in parts] == ["# Title\n\n> quoted", "- one\n- two", "| a | b |\n|---|---|\n| 1 | 2 |", "```py\nx = 1\n```\n\nLast words."]
    long = "One two three. " * 3 + "See http://a.b/c.d?e. f or C:\\a. b\\c! Next\nline of words without any mark at all goes on and on"
    assert df.slices(long, df.chunk_offsets(long, 40)) == ["One two three. ", "One two three. ", "One two three. ", "See http://a.b/c.d?e. f or C:\\a. b\\c! ", "Next\nline of words without any mark at ", "all goes on and on"]
    held = ("`a`", "`b`", "~~~d\n`e~~~", "./x/y", "\\\\srv\\z", "C:\\q/")
    assert df.protect("`a``b` ``` c ~~~d\n`e~~~ (see ./x/y) \\\\srv\\z] C:\\q/ end") == ("__QLP_0____QLP_1__ ``` c __QLP_2__ (see __QLP_3__) __QLP_4__] __QLP_5__ end", [*held])


def test_versions_are_claimed_once(spark, data):
    other = versions.Dataset(spark, data.root)
    base, frame = data.latest(), data.read()
    assert other.write(frame.limit(1)) == base + 1
    with pytest.raises(FileExistsError, match="another writer"):
        data.write(frame, "update", after=base)
    assert data.latest() == base + 1 and data.read().count() == 1
    assert data.write(frame.limit(0)) == base + 2
    with pytest.raises(ValueError, match="exactly one"):
        data.take("uris")
    with pytest.raises(ValueError, match="exactly one"):
        versions.taken(frame, "blob", uris=["a"], count=[1])
    assert [r["blob"] and bytes(r["blob"]) for r in versions.taken(frame, "blob", uris=["b", "zz", "a", "b"]).collect()] == [b"2", None, b"1", b"2"]


def test_text_functions(spark):
    v = lambda c: values(spark, c)
    assert v(tx.finalize(F.lit(" a\r\nb\0 "))) == "a\nb\n" and v(tx.finalize(F.lit(" "))) == ""
    assert v(tx.json_fence(F.lit("```json\n{}\n```"))) == "{}" and v(tx.markdown_fence(F.lit("```md\n# A\n```"))) == "# A"
    assert v(tx.timestamps(F.lit("1:02,003 01:02.003 01:02:03.004 100:02:03:004 01:02,03,004"))) == "00:01:02,003 00:01:02,003 01:02:03,004 100:02:03,004 00:02:03,004"
    assert [v(tx.clock(F.lit(x))) for x in (-1.5, 59.9, 3661.0)] == ["00:00:00", "00:00:59", "01:01:01"]
    assert v(tx.duration(F.lit(61_999))) == "1:01" and v(tx.stem_family(F.lit("Lead Vocals.wav"))) == "vocals"
    assert v(tx.note_name(F.lit(60.0))) == "C4" and v(tx.note_name(F.lit(59.88))) == "C4-12"
    assert v(tx.translation_prompt(F.lit("hi"), "en", "de", context=F.lit(" "))).endswith("[Text]\nhi")
    assert v(tx.caption_suffix(F.lit("image"), F.lit("SRT"))) == ".srt" and v(tx.leaf_name(F.lit("a/b\\c.txt"))) == "c.txt"


def test_media_functions(spark):
    v = lambda c: values(spark, c)
    assert tuple(v(media.fit(F.lit(2000), F.lit(1000), long_edge=1024))) == (1024, 512) and tuple(v(media.fit(F.lit(100), F.lit(40)))) == (96, 32)
    assert tuple(v(media.smart_resize(F.lit(1000), F.lit(500)))) == (1008, 504)
    with pytest.raises(Exception, match="200"):
        v(media.smart_resize(F.lit(10_000), F.lit(10)))
    assert tuple(v(media.tile_grid(F.lit(1000), F.lit(500)))) == (2, 1) and tuple(v(media.tile_grid(F.lit(4000), F.lit(2000)))) == (4, 2)
    assert v(media.normalized(F.array(F.lit(2.0), F.lit(-4.0)))) == [0.5, -1.0]
    notes = spark.createDataFrame([(1, 0.0, 2.0, 60.0), (1, 1.0, 3.0, 62.0), (1, 1.0, 1.0, 50.0), (1, 5.0, 6.0, 64.0)], "k int, onset double, offset double, pitch double")
    assert [tuple(r)[1:] for r in media.monotone_notes(notes, "k").orderBy("onset").collect()] == [(0.0, 1.0, 60.0), (1.0, 3.0, 62.0), (5.0, 6.0, 64.0)]


def test_captions_and_tags(spark):
    v = lambda c: values(spark, c)
    assert [v(captions.retry_code(F.lit(t), F.lit("Ann"), F.lit(r), 40.0, F.lit(s))) for t, r, s in (("502 bad", 90.0, False), ("### x", 90.0, False), ("Ann", 90.0, False), ("ann ###", 30.0, False), ("ann ###", 30.0, True))] == [502, 1, 2, 3, 0]
    p = captions.payload(F.lit('{"short_description": "s", "transcript": " "}'))
    assert v(captions.description(p)) == "s" and v(captions.description(captions.payload(F.lit('{"rating": "x"}')))) == captions.NOTHING
    assert v(tags.highlight_rate(F.lit("A red Cat"), F.array(F.lit("cat"), F.lit("dog")))) == 50.0
    assert v(captions.skips_segmenting(F.lit("video/mp4"), F.lit(5000), F.lit(10), F.lit(None).cast("int"))) and not v(captions.skips_segmenting(F.lit("video/mp4"), F.lit(5000), F.lit(10), F.lit(100)))
    rows = spark.createDataFrame([("u", "rating", 0, "a", 0.4), ("u", "rating", 1, "b", 0.4), ("u", "general", 5, "c", 0.5), ("u", "general", 6, "d", 0.4)], "uri string, category string, idx int, tag string, confidence double")
    assert sorted(r["tag"] for r in tags.above(rows, {"general": 0.5}).collect()) == ["a", "c"]
    assert tags.assembled(tags.above(rows, {}), with_confidence=True).first()["tags"] == ["a:0.40", "c:0.50"]
    implied = spark.createDataFrame([("d", "c"), ("a", "a")], "parent string, child string")
    lists = rows.groupBy("uri").agg(F.collect_list(F.struct("category", "idx", "tag", "confidence")).alias("tags"))
    kept = lists.select("uri", tags.above_in("tags", {"general": 0.3}).alias("tags"))
    long = tags.above(rows, {"general": 0.3})
    assert sorted(kept.select(F.inline("tags")).select("tag").collect()) == sorted(long.select("tag").collect()) == [("a",), ("c",), ("d",)]
    assert sorted(r["tag"] for r in kept.select(F.inline(tags.without_parents_in("tags", {"c": ["d"], "a": ["a"]}))).collect()) == sorted(r["tag"] for r in tags.without_parents(long, implied).collect()) == ["c"]
    assert kept.select(tags.without_parents_in("tags", {})).first()[0] == kept.first()["tags"]
    for options in ({}, {"by_confidence": True, "with_confidence": True}, {"pinned": ("d", "c"), "ratings": None}):
        assert kept.select(tags.assembled_in("tags", **options).alias("tags")).first()["tags"] == tags.assembled(long, **options).first()["tags"]
    empty = spark.createDataFrame([("u", [])], "uri string, tags array<struct<category:string,idx:int,tag:string,confidence:double>>")
    assert empty.select(tags.above_in("tags", {}).alias("tags")).select(tags.assembled_in("tags")).first()[0] == []
    assert v(schema.family(F.lit("X.GIF"))) == "animation" and v(schema.family(F.lit("X.GIF"), schema.EXPORT_ORDER)) == "image"
    assert v(schema.stem(F.lit("d/.hidden"))) == ".hidden" and v(schema.extension(F.lit("a.b/c"))) == ""


def test_dataset_search(spark, tmp_path):
    assert versions.find(spark, f"file://{tmp_path}") is None
    for name in ("one", "two"):
        versions.Dataset(spark, f"file://{tmp_path}/{name}").write(spark.range(1 if name == "one" else 2))
        if name == "one":
            assert versions.find(spark, f"file://{tmp_path}").read().count() == 1
    assert versions.find(spark, f"file://{tmp_path}", "two").read().count() == 2 and versions.find(spark, f"file://{tmp_path}/one").latest() == 1
    with pytest.raises(ValueError):
        versions.find(spark, f"file://{tmp_path}")
    with pytest.raises(FileNotFoundError):
        versions.find(spark, f"file://{tmp_path}/none")


def test_layers_and_times(spark):
    assert values(spark, media.sample_times(F.lit(0.5), F.lit(2))) == [0.5, 0.75]
    ddl = "name string, saturation double, alpha double, entropy double, bbox double, offset double, z int, total int"
    rows = [("x", 0.05, 1.0, 9.0, 1.0, 0.0, 0, 10), ("x", 0.5, 1.0, 1.0, 0.99, 0.9, 0, 10), ("x", 0.5, 1.0, 4.0, 0.5, 0.1, 5, 10), ("flat color", 0.5, 1.0, 2.5, 0.5, 0.3, 5, 10), ("x", 0.2, 1.0, 2.5, 0.5, 0.9, 9, 10), ("glow", 0.2, 1.0, 1.0, 0.8, 0.9, 5, 10), ("sky", 0.2, 1.0, 2.5, 0.8, 0.9, 5, 10)]
    layers = spark.createDataFrame(rows, ddl)
    assert [r[0] for r in layers.select(media.layer_class(F.struct(*layers.columns))).collect()] == ["lineart", "background", "subject", "coloring", "foreground", "effects", "background"]
