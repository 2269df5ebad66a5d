"""Long waveforms cut at silences, and subtitles kept in step with scenes.

What is sequential by nature is reduced first, by grouped work that splits a medium, and then folded in order: a state of
a few numbers goes from row to row, so a medium streams through its task and is never held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import media

#: Frames of a waveform that are searched for silence together.
SEGMENT = 4096


@dataclass(frozen=True)
class Silence:
    """What counts as a silence: a level in decibels and lengths in milliseconds, as frames of a rate of samples."""

    rate: int
    threshold: float = -40.0
    min_length: int = 1000
    min_interval: int = 200
    hop: int = 20
    max_kept: int = 100

    def __post_init__(self):
        if not self.min_length >= self.min_interval >= self.hop or self.max_kept < self.hop:
            raise ValueError("min_length >= min_interval >= hop and max_kept >= hop must hold")

    @property
    def level(self) -> float:
        return 10 ** (self.threshold / 20)

    @property
    def step(self) -> int:
        """Samples from a frame to the next."""
        return round(self.rate * self.hop / 1000)

    @property
    def window(self) -> int:
        """Samples of a frame, which lie around its place."""
        return min(round(self.rate * self.min_interval / 1000), 4 * self.step)

    @property
    def least(self) -> int:
        return round(self.rate * self.min_length / 1000 / self.step)

    @property
    def interval(self) -> int:
        return round(self.rate * self.min_interval / 1000 / self.step)

    @property
    def kept(self) -> int:
        return round(self.rate * self.max_kept / 1000 / self.step)

    def frames(self, samples: int) -> int:
        return (samples + 2 * (self.window // 2) - self.window) // self.step + 1


def _partial_frames(of: Silence, by: str):
    """Rows of samples to what they add to the sum of squares of each frame that reaches them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = of.window // 2
        for batch in batches:
            keys, frames, sums = [], [], []
            for k, (start, values) in enumerate(zip(batch.column("start").to_pylist(), batch.column("values"), strict=True)):
                x = np.nan_to_num(values.values.to_numpy(zero_copy_only=False).astype(np.float64)) if values.is_valid else np.zeros(0)
                if not len(x):
                    continue
                padded = np.pad(x * x, of.window)
                first, last = max(0, -(-(start + half - of.window + 1) // of.step)), (start + len(x) - 1 + half) // of.step
                own = np.arange(first, last + 1)
                at = own * of.step - half - start + of.window
                for lo in range(0, len(own), 1 << 14):  # a view of windows, summed in pieces
                    part = np.lib.stride_tricks.sliding_window_view(padded, of.window)[at[lo : lo + (1 << 14)]]
                    sums.append(part.sum(1))
                keys += [k] * len(own)
                frames.append(own)
            made = [pa.array(np.concatenate(x) if x else [], t) for x, t in ((frames, pa.int64()), (sums, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array(keys, pa.int64())), *made], [by, "frame", "total"])

    return add


def frame_levels(samples: DataFrame, by: str, of: Silence) -> DataFrame:
    """(by, segment, frame, level): the root mean square of each frame, zeros around the waveform; frames cross rows.

    samples: (by, start, values), the place of a row's first sample and its samples. Rows may come in any order and leave
    places out, which are silent; frames that no row reaches are left out.
    """
    kind = f"{by} {samples.schema[by].dataType.simpleString()}, frame long, total double"
    sums = samples.select(by, F.col("start").cast("long").alias("start"), F.col("values").cast("array<double>").alias("values")).mapInArrow(_partial_frames(of, by), kind)
    sums = sums.withColumn("segment", F.floor(F.col("frame") / SEGMENT)).repartition(by, "segment")  # so that a long medium is many tasks' work
    return sums.groupBy(by, "segment", "frame").agg(F.sqrt(F.sum("total") / of.window).alias("level"))


_RUNS = "array<struct<begin:bigint,end:bigint,head:array<double>,tail:array<double>>>"


def _silent_runs(of: Silence, by: str, kind: pa.DataType):
    """Segments (frames, levels) to the runs of silent frames that can matter: long ones and those at a segment's ends."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for segment, rows in zip(batch.column("segment").to_pylist(), batch.column("rows"), strict=True):
                level = np.zeros(SEGMENT)
                level[rows.values.field(0).to_numpy(zero_copy_only=False) - segment * SEGMENT] = rows.values.field(1).to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], level < of.level, [0]])))
                own = []
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if b - a >= of.interval or a == 0 or b == SEGMENT:
                        own.append({"begin": segment * SEGMENT + a, "end": segment * SEGMENT + b, "head": level[a:b][: of.kept + 1].tolist(), "tail": level[a:b][-(of.kept + 1) :].tolist()})
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column("segment"), pa.nulls(batch.num_rows, pa.int64()), pa.array(found, kind)], [by, "segment", "samples", "runs"])

    return find


class _Cuts:
    """The fold over a medium's silent runs, in order: takes runs, gives (begin, end) of parts, in frames."""

    def __init__(self, of: Silence, samples: int):
        self.of, self.samples, self.frames = of, samples, of.frames(samples)
        self.whole = -(-samples // of.step) <= of.least  # too short to be cut
        self.run: dict | None = None
        self.clip, self.after, self.parts = 0, 0, 0
        self.any = False

    def take(self, begin: int, end: int, head: list[float], tail: list[float]) -> Iterator[tuple[int, int]]:
        """A run; one that goes on where the last ended is part of it."""
        if begin >= self.frames:
            return
        keep = self.of.kept + 1
        if self.run and self.run["end"] == begin:
            own = self.run
            if len(own["head"]) < keep:
                own["head"] = (own["head"] + head)[:keep]
            own["tail"], own["end"] = (own["tail"] + tail)[-keep:], end
            return
        yield from self.close()
        self.run = {"begin": begin, "end": end, "head": head, "tail": tail}

    def close(self) -> Iterator[tuple[int, int]]:
        """The run ends with a loud frame after it."""
        run, self.run = self.run, None
        if run is None or run["begin"] >= self.frames:
            return
        a, b, kept = run["begin"], run["end"], self.of.kept
        if b >= self.frames:
            self.run = run
            return
        leading = a == 0 and b > kept
        if not leading and not (b - a >= self.of.interval and b - self.clip >= self.of.least):
            return
        if b - a <= kept:
            left = right = a + int(np.argmin(run["head"]))
        else:
            left = a + int(np.argmin(run["head"]))
            tail = run["tail"][-kept:] if kept else []
            right = b - len(tail) + int(np.argmin(tail)) if tail else b
        yield from self.cut(0 if a == 0 else left, right)
        self.clip = right

    def cut(self, left: int, right: int) -> Iterator[tuple[int, int]]:
        if self.any or left > 0:
            yield self.after, left
        self.after, self.any = right, True

    def finish(self) -> Iterator[tuple[int, int]]:
        if self.run and self.run["end"] < self.frames:
            yield from self.close()
        run, self.run = self.run, None
        if run and run["begin"] < self.frames and self.frames - run["begin"] >= self.of.interval:
            head = run["head"][: self.frames - run["begin"]]
            yield from self.cut(run["begin"] + int(np.argmin(head)), self.frames + 1)
        if not self.any:
            self.whole = True
        elif self.after < self.frames:
            yield self.after, self.frames

    def samples_of(self, begin: int, end: int) -> tuple[int, int]:
        return begin * self.of.step, min(self.samples, end * self.of.step)


def silence_slices(samples: DataFrame, by: str, of: Silence) -> DataFrame:
    """(by, part, begin, end): the parts, as places of samples, into which waveforms (by, start, values) are cut at silences.

    A silence of at least `min_interval`, after a part of at least `min_length`, is cut at its quietest frame; of one longer
    than `max_kept` the quietest frames of its first and its last `max_kept` are the cuts, and what lies between goes. So
    does the silence before the first and after the last sound. A waveform without a cut is one part; one without samples, or without a sound, has none.

    Levels and runs of silence are found by segments of SEGMENT frames. What is folded in order are the runs that can matter.
    """
    levels = frame_levels(samples, by, of)
    own = samples.schema[by].dataType.simpleString()
    segments = levels.groupBy(by, "segment").agg(F.collect_list(F.struct("frame", "level")).alias("rows"))  # SEGMENT frames at most
    kind = f"{by} {own}, segment long, samples long, runs {_RUNS}"
    arrow = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("head", pa.list_(pa.float64())), ("tail", pa.list_(pa.float64()))]))
    runs = segments.mapInArrow(_silent_runs(of, by, arrow), kind)
    lengths = samples.where("size(values) > 0").groupBy(by).agg(F.max(F.col("start") + F.size("values")).cast("long").alias("samples"))
    rows = runs.unionByName(lengths.select(by, F.lit(-1).cast("long").alias("segment"), "samples", F.lit(None).cast(_RUNS).alias("runs")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, medium, at, key_type = None, None, 0, None

        def ended() -> Iterator[tuple]:
            if cuts is not None:
                yield from numbered(cuts.finish() if not cuts.whole else ())
                if cuts.whole:
                    yield medium, 0, 0, cuts.samples

        def numbered(found) -> Iterator[tuple]:
            for begin, end in found:
                yield medium, cuts.parts, *cuts.samples_of(begin, end)
                cuts.parts += 1

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (key_type, pa.int32(), pa.int64(), pa.int64()), strict=True)], [by, "part", "begin", "end"])

        for batch in batches:
            key_type, out = batch.schema.field(by).type, []
            for own, segment, length, found in zip(*(batch.column(c).to_pylist() for c in (by, "segment", "samples", "runs")), strict=True):
                if segment == -1:
                    out += ended()
                    cuts, medium, at = _Cuts(of, length), own, 0
                    continue
                if cuts.whole:
                    continue
                if segment > at:  # segments that no row reaches are silent
                    zeros = [0.0] * (of.kept + 1)
                    out += numbered(cuts.take(at * SEGMENT, segment * SEGMENT, zeros[: (segment - at) * SEGMENT], zeros[: (segment - at) * SEGMENT]))
                for r in found:
                    out += numbered(cuts.take(r["begin"], r["end"], r["head"], r["tail"]))
                at = segment + 1
            yield made(out)
        if key_type is not None:
            yield made(list(ended()))

    return rows.repartition(by).sortWithinPartitions(by, "segment").mapInArrow(fold, f"{by} {own}, part int, begin long, end long")


#: Milliseconds: a cue's end looks for blocks so near, a begin so far off moves, a shift over this is softened.
REACH, JITTER, LARGEST = 2000, 100, 1000
#: Blocks before and after the chosen one that are searched when its boundary is far off.
BEFORE, AFTER = 5, 4


def coherent_cues(cues: DataFrame, blocks: DataFrame, by: str, *, segment_seconds: int) -> DataFrame:
    """Cues (by, number, begin, end) with `begin` and `end` moved to keep in step with scene blocks (by, begin, end).

    In order of their number: a begin over JITTER off the adjusted end before it moves there, but for the first cue of each
    segment of time. An end moves to a boundary of a block, each of which serves once: of the first block in REACH that
    holds it the nearer boundary, else the nearest boundary in REACH. A shift of over LARGEST looks at the
    neighbouring blocks too, and if none is nearer goes three tenths of the way. Cues whose reach holds no unused block keep
    their end, and cues without times go.

    The blocks in reach come from a binned interval join, with their neighbours' boundaries; the fold holds the end before it
    and the last block that served.
    """
    order = Window.partitionBy(by).orderBy("begin", "end")
    at = lambda f, k: F.struct(*(f(c, k).over(order).alias(c) for c in ("begin", "end")))
    around = [*(at(F.lag, k) for k in range(BEFORE, 0, -1)), *(at(F.lead, k) for k in range(1, AFTER + 1))]
    known = blocks.withColumn("near", F.filter(F.array(*around), lambda b: b["begin"].isNotNull()))
    times = cues.where("begin is not null and end is not null").select(by, *(F.col(c).cast("long").alias(c) for c in ("number", "begin", "end")))
    reached = media.overlapping(times.select(by, "number", "end"), known, by, REACH, keep=("near",))
    lists = reached.groupBy(by, "number").agg(F.array_sort(F.collect_list(F.struct("block_begin", "block_end", "near"))).alias("reach"))
    rows = times.join(lists.hint("merge"), [by, "number"], "left")
    own = cues.schema[by].dataType.simpleString()

    def moved_end(end: int, reach: list[dict], last: tuple | None) -> tuple[int, tuple] | None:
        open_ = [b for b in reach or () if last is None or (b["block_begin"], b["block_end"]) > last]
        if not open_:
            return None
        inside = next((b for b in open_ if b["block_begin"] <= end <= b["block_end"]), None)
        if inside:
            best = inside["block_begin"] if end - inside["block_begin"] < inside["block_end"] - end else inside["block_end"]
        if not inside or best == end:
            marks = [m for b in open_ for m in (b["block_begin"], b["block_end"])]
            best = min(marks, key=lambda m: abs(m - end))  # of equals the first
        chosen = inside or open_[-1]
        if abs(best - end) > LARGEST:
            seen = {(b["block_begin"], b["block_end"]) for b in open_}
            marks = [m for b in chosen["near"] if (b["begin"], b["end"]) not in seen for m in (b["begin"], b["end"])]
            nearer = min(marks, key=lambda m: abs(m - end), default=None)
            best = nearer if nearer is not None and abs(nearer - end) < abs(best - end) else int(end * 0.7 + best * 0.3)
        return best, (chosen["block_begin"], chosen["block_end"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        medium, before, last, segment = object(), None, None, -1
        for batch in batches:
            begins, ends = [], []
            for own, begin, end, reach in zip(*(batch.column(c).to_pylist() for c in (by, "begin", "end", "reach")), strict=True):
                if own != medium:
                    medium, before, last, segment = own, None, None, -1
                here = begin // 1000 // segment_seconds
                new, segment = here > segment, max(here, segment)
                if before is not None and not new and abs(before - begin) > JITTER:
                    begin = before
                found = moved_end(end, reach, last)
                if found:
                    end, last = found
                before = end
                begins.append(begin)
                ends.append(end)
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column("number"), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], [by, "number", "begin", "end"])

    return rows.repartition(by).sortWithinPartitions(by, "number").mapInArrow(fold, f"{by} {own}, number long, begin long, end long")
