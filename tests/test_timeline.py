"""Cuts at silences and coherent subtitles against plain versions, in small batches."""

import math
import random
from contextlib import contextmanager

import pytest

from millrace.operators import media, timeline
from millrace.plans import catalog, signals


@contextmanager
def batches_of(spark, n):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plain_parts(x, of):
    """Parts of a list of samples, found frame by frame."""
    if math.ceil(len(x) / of.step) <= of.least:
        return [(0, len(x))]
    half = of.window // 2
    level = []
    for i in range(of.frames(len(x))):
        level.append(math.sqrt(sum(x[p] ** 2 for p in range(i * of.step - half, i * of.step - half + of.window) if 0 <= p < len(x)) / of.window))
    n, quietest = len(level), lambda a, b: min(range(a, min(b, len(level))), key=lambda i: (level[i], i))
    cuts, clip, a = [], 0, 0
    while a < n:
        if level[a] >= of.level:
            a += 1
            continue
        b = a
        while b < n and level[b] < of.level:
            b += 1
        if b == n:
            if n - a >= of.interval:
                cuts.append((quietest(a, a + of.kept + 1), n + 1))
        elif (a == 0 and b > of.kept) or (b - a >= of.interval and b - clip >= of.least):
            one = b - a <= of.kept
            left, right = (quietest(a, b),) * 2 if one else (quietest(a, a + of.kept + 1), quietest(b - of.kept, b))
            cuts.append((0 if a == 0 else left, right))
            clip = right
        a = b
    if not cuts:
        return [(0, len(x))]
    parts = [(0, cuts[0][0])] if cuts[0][0] else []
    parts += [(r, l) for (_, r), (l, _) in zip(cuts, cuts[1:], strict=False)]
    parts += [(cuts[-1][1], n)] if cuts[-1][1] < n else []
    return [(a * of.step, min(len(x), b * of.step)) for a, b in parts]


@pytest.mark.parametrize("segment,of", [(16, timeline.Silence(1000, -30.0, 100, 40, 8, 24)), (4096, timeline.Silence(1000, -30.0, 60, 30, 10, 10)), (7, timeline.Silence(800, -20.0, 50, 50, 5, 100))])
def test_silence_slices(spark, monkeypatch, segment, of):
    monkeypatch.setattr(timeline, "SEGMENT", segment)
    r = random.Random(segment)
    media, rows = {}, []
    for k in range(40):
        x = []
        while len(x) < r.choice((5, 300, 3000)):
            gain, n = r.choice((0.0, 0.001, 0.001, 1.0, 1.0)), r.randrange(1, 260)
            if gain == 0.0 and r.random() < 0.5:
                x += [0.0] * (3 * n)
            x += [gain * r.uniform(-1, 1) for _ in range(n)]
        media[k], at = x, 0
        while at < len(x):  # rows of any length; some silent ones are left out
            n = r.randrange(1, 90)
            part = x[at : at + n]
            if any(part) or at + n >= len(x):
                rows.append((k, at, part))
            at += n
    r.shuffle(rows)
    rows += [(99, 0, []), (98, 0, None), (None, 0, [1.0] * 5)]
    with batches_of(spark, 3):
        got = timeline.silence_slices(spark.createDataFrame(rows, "k int, start long, values array<double>").repartition(4), "k", of).collect()
    want = [(k, i, *p) for k, x in media.items() for i, p in enumerate(plain_parts(x, of))] + [(None, 0, 0, 5)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kinds = [(p[0][0] > 0, len(p) > 1, p[-1][1] < len(x)) for x, p in ((x, plain_parts(x, of)) for x in media.values()) if p]
    assert all(any(k[i] for k in kinds) for i in range(3))  # leading, middle and trailing silences were cut


def test_silence_bounds():
    with pytest.raises(ValueError):
        timeline.Silence(1000, min_length=10, min_interval=40)
    of = timeline.Silence(44100)
    assert (of.step, of.window, of.least, of.interval, of.kept) == (882, 3528, 50, 10, 5)


def plain_cues(cues, blocks, seconds):
    """Cues of one medium, in order; every block is looked at for every cue."""
    out, before, used, top = [], None, -1, -1
    for number, begin, end in cues:
        here = begin // 1000 // seconds
        if before is not None and here <= top and abs(before - begin) > 100:
            begin = before
        top = max(top, here)
        reach = [j for j, (a, b) in enumerate(blocks) if j > used and a - 2000 <= end <= b + 2000]
        if reach:
            home = next((j for j in reach if blocks[j][0] <= end <= blocks[j][1]), None)
            goal = None
            if home is not None:
                a, b = blocks[home]
                goal = a if end - a < b - end else b
            if home is None or goal == end:
                goal = sorted(((abs(m - end), i, m) for i, m in enumerate(m for j in reach for m in blocks[j])))[0][2]
            chosen = home if home is not None else reach[-1]
            if abs(goal - end) > 1000:
                others = [m for j in range(max(0, chosen - 5), min(len(blocks), chosen + 5)) if j not in reach for m in blocks[j]]
                best = min(others, key=lambda m: abs(m - end), default=None)
                goal = best if best is not None and abs(best - end) < abs(goal - end) else int(end * 0.7 + goal * 0.3)
            end, used = goal, chosen
        before = end
        out.append((number, begin, end))
    return out


def test_coherent_cues(spark):
    r = random.Random(4)
    cues, blocks, want = [], [], []
    for k in range(30):
        marks = sorted(r.sample(range(0, 120_000), r.randrange(0, 40)))
        own = list(zip(marks, marks[1:], strict=False))
        at, mine = 0, []
        for i in range(r.randrange(0, 30)):
            at += r.randrange(0, 5000)
            mine.append((i, at, at + r.randrange(200, 6000)))
        cues += [(k, *c) for c in mine]
        blocks += [(k, *b) for b in own]
        want += [(k, *c) for c in plain_cues(mine, own, 30)]
    cues += [(3, 900, None, 5), (3, 901, 5, None)]
    with batches_of(spark, 4):
        got = timeline.coherent_cues(spark.createDataFrame(cues, "k int, number long, begin long, end long").repartition(5), spark.createDataFrame(blocks, "k int, begin long, end long"), "k", segment_seconds=30).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(a != (k, *c) for a, (k, *c) in zip(sorted(want), sorted(c for c in cues if c[2] is not None and c[3] is not None), strict=True))


def test_coherent_subtitles_query(spark, small):
    cues, marks = catalog._cues(spark, small)
    by, cuts = {}, {}
    for r in cues.collect():
        by.setdefault(r.user_id, []).append((r.end, r.number))
    for r in marks.collect():
        cuts.setdefault(r.user_id, []).append(r.mark)
    want = []
    for user, ends in by.items():
        m = sorted(cuts.get(user, []))
        own = list(zip(m, m[1:], strict=False))
        own += [(m[-1], m[-1] + int(sum(b - a for a, b in own) / len(own)))] if own else []
        want += [(user, *c) for c in plain_cues([(i, end - 3000, end) for i, (end, _) in enumerate(sorted(ends), 1)], own, 600)]
    got = signals.coherent_subtitles(spark, small).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_nearest_marks_over_ranges(spark):
    rng = random.Random(5)
    points = [("a" if rng.random() < 0.7 else rng.choice("bcd"), rng.randrange(-3000, 9000), k) for k in range(600)] + [("a", None, 600), ("d", None, 601), (None, 70, 602)]
    marks = [(rng.choice("aab"), rng.randrange(0, 40) * 190) for _ in range(60)] + [(None, 20), (None, 121), ("c", 8999), ("a", None)]
    of = lambda by: sorted(m for b, m in marks if b == by and m is not None)
    plain = {k: (of(by)[:1] or [None])[0] if t is None else min(of(by), key=lambda m: (abs(m - t), m), default=None) for by, t, k in points}
    for width in (50, 1000, 10**6):
        found = media.nearest(spark.createDataFrame(points, "medium string, at long, k int"), spark.createDataFrame(marks, "medium string, mark long"), "medium", "at", "mark", width).collect()
        assert {r["k"]: r["nearest"] for r in found} == plain and len(found) == len(points)
