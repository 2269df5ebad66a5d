"""Note events as files: for each medium a JSON array, JSON lines and a MIDI file, from one pass; and MIDI files as notes.

A medium's events stream through its task in order of time. Each file is written under a name of its own and renamed when
it is whole, so that a task that runs again does no harm. Paths go through pyarrow's file systems (file, hdfs, s3, gs).
Files are read, and deleted, by the tasks that hold their paths: no folder of many files is listed on the driver.

Events have the columns of `EVENT`: starts (type, pitch, start_time, index, instrument) and ends (type, end_time,
start_event_index), of which one belongs to each start by its index within a medium.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.sinks import located

EVENT = "type string, pitch int, start_time double, index long, instrument string, end_time double, start_event_index long"
_NAMES = ("type", "pitch", "start_time", "index", "instrument", "end_time", "start_event_index")

# Fixed values of MIDI files: ticks of a quarter note, and microseconds of it (120 a minute).
TICKS, TEMPO = 480, 500_000
#: Tracks keep this much in memory; beyond it they go to the task's own disk. Texts are read and written in parts of it.
IN_MEMORY = 1 << 20
#: Events of a medium that are written at once, and notes that are read at once.
AT_ONCE = 8192
DRUMS = 9


def variable_length(n: int) -> bytes:
    """A number in seven bits a byte, the highest bit set on all but the last."""
    if n < 0x80:
        return bytes((n,))
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def ticks(seconds: float) -> int:
    return max(0, round(seconds * 1e6 / TEMPO * TICKS))


class _Track:
    def __init__(self, channel: int):
        self.channel, self.last, self.data, self.file = channel, 0, bytearray(), None

    def add(self, raw: bytes) -> None:
        self.data += raw
        if len(self.data) > IN_MEMORY:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
            self.file.write(self.data)
            self.data.clear()

    def write(self, out) -> None:
        before = self.file.tell() if self.file else 0
        out.write(b"MTrk" + struct.pack(">I", before + len(self.data)))
        if self.file:
            self.file.seek(0)
            while part := self.file.read(IN_MEMORY):
                out.write(part)
            self.file.close()
        out.write(bytes(self.data))


class Midi:
    """A standard MIDI file of format 1: a track of the tempo, then one for each instrument in order of appearance."""

    def __init__(self, programs: dict[str, int]):
        self.programs, self.tracks, self.open, self.now = programs, {}, {}, 0

    def _put(self, instrument: str, at: int, kind: int, pitch: int, velocity: int) -> None:
        if instrument not in self.tracks:
            channel = DRUMS if instrument.lower() in ("drums", "percussion") else [c for c in range(16) if c != DRUMS][len(self.tracks) % 15]
            own, name = _Track(channel), instrument.encode()
            own.add(b"\x00\xff\x03" + variable_length(len(name)) + name + bytes((0, 0xC0 | channel, self.programs.get(instrument, 0) & 0x7F)))
            self.tracks[instrument] = own
        own = self.tracks[instrument]
        own.add(variable_length(at - own.last) + bytes((kind | own.channel, pitch, velocity)))
        own.last = at

    def start(self, index: int, time: float, pitch: int, instrument: str) -> None:
        self.now = at = max(self.now, ticks(time))
        if 0 <= pitch <= 127:
            self.open[index] = (pitch, instrument)
            self._put(instrument, at, 0x90, pitch, 100)

    def end(self, index: int, time: float) -> None:
        self.now = at = max(self.now, ticks(time))
        if note := self.open.pop(index, None):
            self._put(note[1], at, 0x80, note[0], 0)

    def write(self, out) -> None:
        for index in list(self.open):  # notes without an end
            self.end(index, 0)
        tempo = b"\x00\xff\x51\x03" + TEMPO.to_bytes(3, "big") + b"\x00\xff\x2f\x00"
        out.write(b"MThd" + struct.pack(">IHHH", 6, 1, 1 + len(self.tracks), TICKS) + b"MTrk" + struct.pack(">I", len(tempo)) + tempo)
        for own in self.tracks.values():
            own.add(b"\x00\xff\x2f\x00")
            own.write(out)


@functools.lru_cache(maxsize=4096)
def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def file_stem(key: object) -> str:
    """A file name for a key; keys that would share one get a hash."""
    name = re.sub(r"[^\w.-]+", "_", str(key)).strip("._")[:100]
    return name if name and name == str(key) else f"{name}-{hashlib.sha256(str(key).encode()).hexdigest()[:12]}"


class _Files:
    """The three files of one medium, open for writing."""

    def __init__(self, key: object, files: fs.FileSystem, base: str, programs: dict[str, int]):
        self.key, self.midi, self.events, self.notes, self.instruments = key, Midi(programs), 0, 0, {}
        self.files, self.lines, self.items = files, [], []
        self.paths = {k: f"{base}/{file_stem(key)}.{k}" for k in ("json", "jsonl", "mid")}
        self.parts = {k: f"{p}.{uuid.uuid4().hex}.part" for k, p in self.paths.items()}
        self.out = {k: self.files.open_output_stream(p) for k, p in self.parts.items()}

    def add(self, kind: str, pitch: int, start_time: float, index: int, instrument: str | None, end_time: float, start_event_index: int) -> None:
        if kind == "start":
            name = instrument or ""
            quoted = _quoted(name)
            self.lines.append(f'{{"type":"start","pitch":{pitch},"start_time":{start_time!r},"index":{index},"instrument":{quoted}}}\n')
            self.items.append(f'  {{\n    "type": "start",\n    "pitch": {pitch},\n    "start_time": {start_time!r},\n    "index": {index},\n    "instrument": {quoted}\n  }}')
            self.notes += 1
            if name := name.strip():
                self.instruments.setdefault(name)
            self.midi.start(index, start_time, pitch, instrument or "")
        else:
            self.lines.append(f'{{"type":"end","end_time":{end_time!r},"start_event_index":{start_event_index}}}\n')
            self.items.append(f'  {{\n    "type": "end",\n    "end_time": {end_time!r},\n    "start_event_index": {start_event_index}\n  }}')
            self.midi.end(start_event_index, end_time)
        if len(self.items) == AT_ONCE:
            self.flush()

    def flush(self) -> None:
        if self.items:
            self.out["jsonl"].write("".join(self.lines).encode())
            self.out["json"].write(((",\n" if self.events else "[\n") + ",\n".join(self.items)).encode())
        self.events += len(self.items)
        self.lines, self.items = [], []

    def commit(self) -> tuple:
        self.flush()
        self.out["json"].write(b"\n]\n" if self.events else b"[]\n")
        self.midi.write(self.out["mid"])
        for k, out in self.out.items():
            out.close()
            self.files.move(self.parts[k], self.paths[k])
        return self.key, self.events, self.notes, list(self.instruments), self.paths["json"], self.paths["jsonl"], self.paths["mid"]


def _values(column: pa.Array) -> list:
    """A column's values; numbers that are null are 0, which no event of its type reads."""
    return (column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.fill_null(column, 0)).to_numpy(zero_copy_only=False).tolist()


def write_events(events: DataFrame, by: str, folder: str, *, seq: str = "seq", programs: dict[str, int] | None = None, folders: int = 0) -> DataFrame:
    """(by, events, notes, instruments, json, jsonl, mid) of the files written for each medium, once the result is read.

    events: by, seq, and EVENT. Events go in order of time, then of seq. Events of another type, or without their time or
    index, go nowhere. In MIDI, an end without a start is left out, a note without an end ends with the last event, and
    pitches outside 0 to 127 have no note.

    folders: deal the media to as many folders inside `folder`, by their keys. Tasks that rename files in one folder wait for
    each other, which many media feel.
    """
    kind = T.StructType([T.StructField(by, events.schema[by].dataType), *T.StructType.fromDDL("events long, notes long, instruments array<string>, json string, jsonl string, mid string").fields])
    time = F.when(F.col("type") == "start", F.col("start_time")).when(F.col("type") == "end", F.col("end_time"))
    index = F.when(F.col("type") == "start", F.when(F.col("pitch").isNotNull(), F.col("index"))).otherwise(F.col("start_event_index"))
    rows = events.withColumn("time", time).where(F.col("time").isNotNull() & index.isNotNull())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key_type = None, None
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        there = set()

        def place(key: object) -> str:
            if not folders:
                return base
            own = f"{base}/{zlib.crc32(str(key).encode()) % folders:04d}"
            if own not in there:
                files.create_dir(own, recursive=True)
                there.add(own)
            return own

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (key_type, pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=kind.names)

        for batch in batches:
            key_type, done = batch.schema.field(by).type, []
            for key, event in zip(batch.column(by).to_pylist(), zip(*(_values(batch.column(n)) for n in _NAMES), strict=True), strict=True):
                if own is None or own.key != key:
                    if own is not None:
                        done.append(own.commit())
                    own = _Files(key, files, place(key), programs or {})
                own.add(*event)
            yield made(done)
        if own is not None:
            yield made([own.commit()])

    return rows.repartition(by).sortWithinPartitions(by, "time", seq).select(by, *_NAMES).mapInArrow(write, kind)


def midi_notes(raw: bytes) -> list[tuple[str, float, float, int]]:
    """(track, onset, offset, pitch) of a MIDI file's notes, in seconds; tempo changes count for all tracks."""

    def number(at: int) -> tuple[int, int]:
        n = 0
        while True:
            n, at = n << 7 | raw[at] & 0x7F, at + 1
            if not raw[at - 1] & 0x80:
                return n, at

    if raw[:4] != b"MThd":
        raise ValueError("no MIDI file")
    tracks, division = struct.unpack(">HH", raw[10:14])
    at, tempos, notes = 8 + struct.unpack(">I", raw[4:8])[0], [(0, 500_000)], []
    for _ in range(tracks):
        end, name, now, status, on = at + 8 + struct.unpack(">I", raw[at + 4 : at + 8])[0], "", 0, 0, {}
        at += 8
        while at < end:
            delta, at = number(at)
            now += delta
            if raw[at] & 0x80:
                status, at = raw[at], at + 1
            if status == 0xFF:
                kind = raw[at]
                n, at = number(at + 1)
                if kind == 0x03:
                    name = raw[at : at + n].decode("utf-8", "replace")
                elif kind == 0x51:
                    tempos.append((now, int.from_bytes(raw[at : at + n], "big")))
                at += n
            elif status >= 0xF0:
                n, at = number(at)
                at += n
            else:
                first, high = raw[at], status & 0xF0
                second = 0 if high in (0xC0, 0xD0) else raw[at + 1]
                at += 1 if high in (0xC0, 0xD0) else 2
                if high == 0x90 and second:
                    on.setdefault((status & 15, first), []).append(now)
                elif high in (0x80, 0x90) and on.get((status & 15, first)):
                    notes.append((name, on[status & 15, first].pop(0), now, first))
        at = end
    tempos.sort(key=lambda t: t[0])

    def seconds(tick: int) -> float:
        total, before, rate = 0.0, 0, 500_000
        for when, tempo in tempos:
            if when > tick:
                break
            total, before, rate = total + (when - before) * rate, when, tempo
        return (total + (tick - before) * rate) / 1e6 / division

    return [(name, seconds(a), seconds(b), pitch) for name, a, b, pitch in notes]


def _together(rows: Iterable[tuple[int, list[tuple]]], bound: int, kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of many files or parts of files, each of which comes with its size; a batch holds about `bound`."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True) if held else [[]] * len(kind), kind.types, strict=True)], schema=kind)

    for n, some in rows:
        held += some
        size += n
        if size >= bound:
            yield made()
            held, size = [], 0
    yield made()


def line_texts(stream) -> Iterator[list[str]]:
    """The lines of a stream of bytes, in parts."""
    rest = b""
    while raw := stream.read(IN_MEMORY):
        *lines, rest = (rest + raw).split(b"\n")
        yield [x.decode("utf-8", "replace") for x in lines if x.strip()]
    if rest.strip():
        yield [rest.decode("utf-8", "replace")]


def item_texts(stream) -> Iterator[list[str]]:
    """The texts of the objects of a JSON array, in parts; what follows its end, or anything else, is left out."""
    decoder, characters, between, text = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8")("replace"), re.compile(r"[\s,\[]*"), ""
    while raw := stream.read(IN_MEMORY):
        text, at, found = text + characters.decode(raw), 0, []
        while text.startswith("{", at := between.match(text, at).end()):
            try:
                end = decoder.raw_decode(text, at)[1]
            except ValueError:  # the rest of it is in the next part
                break
            found.append(text[at:end])
            at = end
        yield found
        text = text[at:]
        if text and text[0] != "{":
            break


def read_events(files: DataFrame) -> DataFrame:
    """(path, EVENT) of the events of files (path): of JSON arrays where the path ends in .json, else of JSON lines.

    Each file is read in parts by the task that holds its path. What is no event has no type.
    """
    kind = pa.schema([("path", pa.string()), ("value", pa.string())])

    def texts(path: str) -> Iterator[tuple[int, list[tuple]]]:
        system, own = located(path)
        with system.open_input_stream(own) as stream:
            for part in (item_texts if path.endswith(".json") else line_texts)(stream):
                yield sum(map(len, part)), [(path, x) for x in part]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _together((some for batch in batches for path in batch.column("path").to_pylist() for some in texts(path)), IN_MEMORY, kind)

    found = files.select("path").mapInArrow(read, "path string, value string")
    return found.select("path", F.from_json("value", EVENT).alias("event")).select("path", "event.*")


def remove_files(files: DataFrame) -> None:
    """Delete the files of (path), each by the task that holds its path."""

    def drop(rows: Iterable) -> None:
        for row in rows:
            system, own = located(row.path)
            system.delete_file(own)

    files.select("path").foreachPartition(drop)


def read_midi(files: DataFrame) -> DataFrame:
    """(path, track, onset, offset, pitch) of the notes of MIDI files; files that are none give no notes.

    files: path, content; or path alone, and each file is opened by the task that holds its path.
    """
    kind = pa.schema([("path", pa.string()), ("track", pa.string()), ("onset", pa.float64()), ("offset", pa.float64()), ("pitch", pa.int32())])

    def content(path: str) -> bytes:
        system, own = located(path)
        with system.open_input_stream(own) as stream:
            return stream.read()

    def notes(path: str, raw: bytes) -> tuple[int, list[tuple]]:
        try:
            found = [(path, *n) for n in midi_notes(raw)]
        except (ValueError, IndexError, struct.error):
            found = []
        return len(found), found

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            whole = batch.column("content").to_pylist() if "content" in batch.schema.names else map(content, paths)
            yield from _together((notes(path, raw) for path, raw in zip(paths, whole, strict=True)), AT_ONCE, kind)

    return files.select("path", *(c for c in ("content",) if c in files.columns)).mapInArrow(read, "path string, track string, onset double, offset double, pitch int")
