"""Files of note events: exact bytes, what is left out, and whole results read back."""

import json
import os
import random

from pyspark.sql import functions as F

from millrace.sources import event_files, sinks


def test_midi_bytes(tmp_path):
    assert [event_files.variable_length(n).hex() for n in (0, 0x7F, 0x80, 0x2000, 0x3FFF, 0x0FFFFFFF)] == ["00", "7f", "8100", "c000", "ff7f", "ffffff7f"]
    midi = event_files.Midi({"flute": 73})
    midi.start(1, 0.0, 60, "flute")
    midi.start(2, 0.5, 38, "drums")
    midi.end(1, 0.5)
    midi.end(9, 0.6)
    midi.start(3, 0.5, 128, "flute")  # no key
    with open(tmp_path / "x.mid", "wb") as f:
        midi.write(f)
    raw = (tmp_path / "x.mid").read_bytes()
    head = "4d546864 00000006 0001 0003 01e0" + "4d54726b 0000000b 00ff5103 07a120 00ff2f00"
    flute = "00ff0305" + b"flute".hex() + "00c049" + "00903c64" + "8360803c00" + "00ff2f00"
    drums = "00ff0305" + b"drums".hex() + "00c900" + "83609926 64".replace(" ", "") + "60892600" + "00ff2f00"
    want = bytes.fromhex((head + "4d54726b").replace(" ", "")) + (len(flute) // 2).to_bytes(4, "big") + bytes.fromhex(flute) + b"MTrk" + (len(drums) // 2).to_bytes(4, "big") + bytes.fromhex(drums)
    assert raw == want
    assert event_files.midi_notes(raw) == [("flute", 0.0, 0.5, 60), ("drums", 0.5, 0.6, 38)]
    assert event_files.midi_notes(raw.replace(b"\x00\xff\x51\x03\x07\xa1\x20", b"\x00\xff\x51\x03\x0f\x42\x40")) == [("flute", 0.0, 1.0, 60), ("drums", 1.0, 1.2, 38)]


def test_files_of_events(spark, tmp_path):
    r, rows, want = random.Random(1), [], {}
    for k in ("a", "b/../c", "b_.._c", None):
        own, seq = [], 0
        for i in range(50):
            at = round(r.uniform(0, 30), 3)
            own.append((at, 2 * i, ("start", r.randrange(20, 100), at, i, r.choice(["piano", "Ünison", ""]), None, None)))
            if i % 7:
                own.append((at + 0.5, 2 * i + 1, ("end", None, None, None, None, at + 0.5, i)))
        want[k] = [e for _, _, e in sorted(own)]
        rows += [(k, s, *e) for _, s, e in own]
    rows += [("a", 900, "start", 60, None, 1, "x", None, None), ("a", 901, "other", 60, 1.0, 1, "x", None, None), ("only", 1, "end", None, None, None, None, 1.0, None)]
    r.shuffle(rows)
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, "7")
    try:
        told = {x["k"]: x for x in event_files.write_events(spark.createDataFrame(rows, f"k string, seq long, {event_files.EVENT}").repartition(3), "k", f"file://{tmp_path}/out").collect()}
    finally:
        spark.conf.set(name, before)
    assert set(told) == set(want) and not [f for f in os.listdir(tmp_path / "out") if f.endswith(".part")] and len(os.listdir(tmp_path / "out")) == 12
    for k, events in want.items():
        plain = [{"type": "start", "pitch": e[1], "start_time": e[2], "index": e[3], "instrument": e[4]} if e[0] == "start" else {"type": "end", "end_time": e[5], "start_event_index": e[6]} for e in events]
        with open(told[k]["json"]) as f:
            assert f.read() == json.dumps(plain, ensure_ascii=False, indent=2) + "\n"
        with open(told[k]["jsonl"]) as f:
            assert [json.loads(x) for x in f] == plain
        assert (told[k]["events"], told[k]["notes"]) == (len(plain), 50) and set(told[k]["instruments"]) == {"piano", "Ünison"}
        with open(told[k]["mid"], "rb") as f:
            notes = event_files.midi_notes(f.read())
        last = max(e[5] or e[2] for e in events)
        due = sorted((e[4], e[2], e[2] + 0.5 if e[3] % 7 else last, e[1]) for e in events if e[0] == "start")
        assert len(notes) == 50 and all(a[0] == b[0] and a[3] == b[3] and abs(a[1] - b[1]) < 0.001 for a, b in zip(sorted(notes, key=lambda n: (n[0], round(n[1], 3), n[3])), sorted(due, key=lambda n: (n[0], round(n[1], 3), n[3])), strict=True))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/out").where("path like '%.mid' or path like '%.json'")
    assert event_files.read_midi(files).groupBy("path").count().where("count = 50").count() == 4


def test_sinks_over_file_systems(spark, tmp_path):
    rows = [(f"file://{tmp_path}/a/x.txt", "one"), (f"{tmp_path}/a/y.txt", "two"), (f"{tmp_path}/a/z.txt", None)]
    done = {r.path: r.written for r in sinks.write_files(spark.createDataFrame(rows, "path string, body string")).collect()}
    assert list(done.values()).count(True) == 2 and (tmp_path / "a" / "x.txt").read_text() == "one" and (tmp_path / "a" / "y.txt").read_text() == "two"
    again = sinks.write_files(spark.createDataFrame([(p, "new") for p, _ in rows], "path string, body string"), overwrite=False).where(F.col("written")).collect()
    assert [r.path for r in again] == [rows[2][0]] and (tmp_path / "a" / "x.txt").read_text() == "one"
