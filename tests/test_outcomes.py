"""Outcomes and discovery: nulls, empty values, ties and repeated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import answers, captions, media, outcomes, responses
from millrace.sources import discovery


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_settings_merge_by_top_level_keys():
    assert discovery.settings(["a = 1\n[b]\nx = 1\ny = 2", None, "[b]\nx = 3"]) == {"a": 1, "b": {"x": 3}}
    assert discovery.settings([None], lambda: "old = true") == {"old": True}
    assert discovery.settings([]) == {}


def test_answers_without_content(spark):
    null = F.lit(None).cast("string")
    assert one(spark, outcomes.transcript(null), outcomes.transcript(F.lit("<think>x</think>")), outcomes.subtitle_answer(null), outcomes.subtitle_answer(F.lit("no fence"))) == (None, None, None, None)
    assert one(spark, outcomes.audio_outcome(F.lit(" \n"), F.lit("audio/wav"), F.lit("ast")), outcomes.audio_outcome(F.lit("x"), F.lit("video/mp4"), F.lit("ast"))) == (None, None)
    assert one(spark, outcomes.structured_text(null, null, null))[0] == outcomes.NOTHING
    assert one(spark, outcomes.structured_text(F.lit("ast"), null, null, translation_srt=F.lit(" "), description=F.lit("d")))[0] == "d"


def test_waits(spark):
    wait = lambda m: one(spark, outcomes.error_wait(F.lit(m), 1.5))[0]
    assert [wait(m) for m in ("Rate Limit reached", "status=429", "code 4290", "403 Forbidden", "unsupported mime type", "502", "anything")] == [59.0, 59.0, 1.5, None, None, 1.5, 1.5]


def test_scores(spark):
    raw = F.create_map(F.lit("b"), F.lit("x"), F.lit(" a "), F.lit("2.0"))
    assert [tuple(e) for e in one(spark, outcomes.ordered_scores(outcomes.score_map(raw), ("a", "c")))[0]] == [("a", 2.0), ("b", 0.0)]
    assert one(spark, outcomes.compact(F.lit(2.0)), outcomes.compact(F.lit(2.5))) == ("2", "2.5")


def test_links_without_images(spark):
    names = F.create_map(F.lit("a.png"), F.lit("1.png"))
    assert one(spark, outcomes.image_links(F.lit(""), "img", names), outcomes.image_links(F.lit("![x](q/a.png)"), "img", names)) == ("", "![x](img/1.png)")


def test_inputs_are_distinct_and_outside(spark):
    paths = spark.createDataFrame([("/in/b.WAV",), ("/in/A.wav",), ("/in/A.wav",), ("/in/out/c.wav",), ("/in/outer.wav",), ("/in/x.txt",)], "path string")
    assert [r[0] for r in discovery.inputs(paths, (".wav",), outside="/in/out/").collect()] == ["/in/A.wav", "/in/b.WAV", "/in/outer.wav"]


def test_folders(spark):
    rows = [("a", 0, "a", None, 3), ("a", 1, "a/o", "own", 3), ("a", 2, "a/o-2", None, 0), ("b", 0, "b", "other", 1), ("b", 1, "b/o", None, 0), ("c", 0, "c", None, 1)]
    found = discovery.output_folder(spark.createDataFrame(rows, "base string, place int, path string, settings string, files int"), F.lit("own"))
    assert {tuple(r) for r in found.collect()} == {("a", "a/o", "reusable"), ("b", None, "mismatch"), ("c", None, "none")}


def test_layers_that_show_nothing(spark):
    pixels = spark.createDataFrame([("clear", 9, 9, 9, 10), ("black", 0, 0, 0, 255), ("two", 0, 0, 0, 255), ("two", 255, 0, 0, 255)], "layer string, r int, g int, b int, a int")
    assert {tuple(r) for r in media.layer_features(pixels, "layer").collect()} == {("clear", 0.0, 0.0, 0.0), ("black", 1.0, 0.0, 0.0), ("two", 1.0, 0.5, 1.0)}


def test_segments_of_no_length(spark):
    seconds = lambda mime, n: one(spark, outcomes.segment_policy(F.lit(mime), F.lit(n), F.lit(60.0), F.array(F.lit("image/")))["seconds"])[0]
    assert [seconds("video/mp4", n) for n in (0, -1, 1, 90)] == [59, 59, 1, 59] and seconds("audio/wav", 0) == 0


def test_answers_that_hold_little(spark):
    null = F.lit(None).cast("string")
    assert tuple(one(spark, responses.parts(null))[0]) == ("", "", "", None, 0.0) and one(spark, responses.caption(null), responses.caption(F.lit("{}"))) == (None, None)
    assert tuple(one(spark, responses.freeform(null))[0]) == ("", {}, 0.0)
    assert one(spark, responses.parts(F.lit("a\nb"), "short")["long"], responses.parts(F.lit("a\nb"), "long")["short"]) == ("", "")
    assert one(spark, responses.caption(F.lit('{"short": "s", "scores": {"all": 3, "x": 9}}'), "all")["average"])[0] == 3.0


def test_last_score_of_a_label(spark):
    assert one(spark, answers.scores(F.lit("Light: 7\nDepth: 1\nlight: 8")))[0] == {"light": 8.0, "depth": 1.0}
    assert one(spark, responses.freeform(F.lit("x\n1. A: 1\n2. **A:** 2"))["scores"])[0] == {"A": 2.0}


def test_values_and_times_in_order(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "b", 1), (1, " ", 0), (2, None, 1)], "k int, v string, n int")
    assert [tuple(r) for r in captions.first_seen(rows, "k", "v", "n").collect()] == [(1, ["b", "a"])]
    assert one(spark, *(tx.epoch_text(F.lit(x)) for x in ("0", "-1", "86461.9", "soon")), tx.epoch_text(F.lit(None).cast("string"))) == ("1970-01-01 00:00:00", "1969-12-31 23:59:59", "1970-01-02 00:01:01", "", "")


def test_folds_over_several_batches(spark):
    """Notes of several media against a plain fold, in batches of two rows."""
    notes = [(k, float((7 * i * i + k) % 11), float((7 * i * i + k) % 11 + (i * k) % 4), float(60 + i % 3)) for k in range(4) for i in range(9)] + [(None, 1.0, 2.0, 60.0), (1, None, 2.0, 60.0)]
    want = []
    for k in (*range(4), None):
        kept = []
        for onset, offset, pitch in sorted(n[1:] for n in notes if n[0] == k and n[1] is not None):
            if kept:
                kept[-1][2] = min(kept[-1][2], onset)
            kept.append([k, onset, offset, pitch])
        want += [tuple(n) for n in kept if n[1] < n[2]]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        got = media.monotone_notes(spark.createDataFrame(notes, "k int, onset double, offset double, pitch double").repartition(5), "k").collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
