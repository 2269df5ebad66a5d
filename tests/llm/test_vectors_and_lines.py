"""Operators 11 to 13 against plain versions, and their defined results."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives, line_dedup, queries, vector_codes

SPACE = " \t\n\x0b\x0c\r"


def lower_ascii(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_lines(rows, min_docs, keep_first, min_chars):
    """rows: (id, text) in order of (id, nulls last); the kept bits of each."""
    found, where = [], defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i, (_, text) in enumerate(rows):
        found.append([True] * ((text or "").count("\n") + 1))
    for i in order:
        for pos, line in enumerate((rows[i][1] or "").split("\n")):
            key = lower_ascii(line.strip(SPACE))
            if key and len(key) >= min_chars:
                where[key].append((i, pos))
    for places in where.values():
        if len({i for i, _ in places}) >= min_docs:
            for i, pos in places[int(keep_first) :]:
                found[i][pos] = False
    return found


def some_lines(seed, n):
    r = random.Random(seed)
    common = ["Home | About", "  home | about\t", "HOME | ABOUT\r", "İstanbul", "ı", "naïve ÉCOLE", "\x1f", "x", "\xa0x\xa0", " ", ""]
    rows = []
    for i in range(n):
        lines = [r.choice(common) if r.random() < 0.6 else f"line {r.randrange(40)}" for _ in range(r.randrange(0, 9))]
        rows.append((None if i % 17 == 3 else i, None if i % 13 == 5 else "\n".join(lines)))
    rows.append((n, "\n".join(f"long {k % 50}" for k in range(30000))))  # a very long text
    rows += [(n + 1, "\n".join(["Home | About"] * 50)), (n + 2, ""), (n + 3, "\n\n")]
    return rows


@pytest.mark.parametrize("min_docs,keep_first,min_chars", [(10, False, 1), (1, True, 1), (2, True, 3), (3, False, 5)])
def test_line_bitmaps(spark, tmp_path, min_docs, keep_first, min_chars):
    rows = some_lines(min_docs, 300)
    want = plain_lines(rows, min_docs, keep_first, min_chars)
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, keep string, n_lines int").repartition(5)
    got = line_dedup.clean(docs, into=("lines", "gone", "bits"), min_docs=min_docs, keep_first=keep_first, min_chars=min_chars).collect()
    assert len(got) == len(rows)
    loose = set()  # rows with null ids: which of equal lines is the first is their place's, not the list's
    for k, (i, t) in enumerate(rows):
        if i is None:
            loose.add(k)
    assert docs.columns + ["lines", "gone", "bits"] == list(got[0].asDict())
    for r in got:
        if keep_first and r.n_lines in loose:
            continue
        bits = want[r.n_lines]
        assert line_dedup.unpack(r.bits, r.lines).tolist() == bits, (r.n_lines, r.text)
        assert (r.lines, r.gone) == (len(bits), bits.count(False))
        text = rows[r.n_lines][1]
        assert r.text == (text if all(bits) else "\n".join(x for x, b in zip(text.split("\n"), bits, strict=True) if b))
    if keep_first:
        total = sum(r.gone for r in got)
        assert total == sum(b.count(False) for b in want)


def test_line_bitmaps_hot_line(spark):
    """One line with most rows lies in several ranges, and counts whole."""
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = [(i, f"hot\nonly {i}\nHOT ") for i in range(3000)] + [(3000, "hot"), (3001, "cold"), (3002, "cold")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r for r in line_dedup.bitmaps(docs, min_docs=2, keep_first=True).collect()}
        kept = {i: line_dedup.unpack(r.keep, r.n_lines).tolist() for i, r in got.items()}
        assert kept[0] == [True, True, False] and kept[3000] == [False] and kept[3001] == [True] and kept[3002] == [False]
        assert all(kept[i] == [False, True, False] for i in range(1, 3000))
        got = line_dedup.bitmaps(docs, min_docs=3001, keep_first=False)
        assert got.agg(F.sum("n_dropped")).first()[0] == 6001
        assert line_dedup.bitmaps(docs, min_docs=3002, keep_first=False).agg(F.sum("n_dropped")).first()[0] == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lines_of_nothing(spark):
    assert line_dedup.bitmaps(spark.createDataFrame([], "doc_id string, text string, id int, place int")).count() == 0
    got = line_dedup.bitmaps(spark.createDataFrame([("a", None), ("a", None), (None, "")], "doc_id string, text string"), min_docs=1).collect()
    assert sorted((r.doc_id or "", r.n_lines, r.n_dropped) for r in got) == [("", 1, 0), ("a", 1, 0), ("a", 1, 0)]


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, label, vector). Every distance is measured, in Python's integers."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return {}, ""
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    ints = []
    for _, _, v in kept:
        v = [math.floor(scale * x) for x in v]
        v += [0] * (-len(v) % parts)
        w = len(v) // parts
        ints.append([v[p * w : (p + 1) * w] for p in range(parts)])
    books = [[ints[e][p] for e in range(min(entries, len(ints)))] for p in range(parts)]
    assign = lambda: [[min((sum((a - b) ** 2 for a, b in zip(x[p], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)] for x in ints]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p] for x, c in zip(ints, codes, strict=True) if c[p][1] == e]
                if own:
                    books[p][e] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    codes = assign()
    said = ",".join(str(v) for p in books for e in p for v in e)
    out = sorted((r[0], r[1], "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c)) for r, c in zip(kept, codes, strict=True))
    return out, hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("rows_of", ["ties", "few", "long", "odd"])
def test_vector_codes(spark, rows_of):
    r = random.Random(7)
    if rows_of == "ties":  # few distinct components: many equal distances, and copies
        rows = [(i, i % 3, [r.choice((-0.5, 0.0, 0.25, 0.5)) / 8 for _ in range(16)]) for i in range(400)]
        rows += [(400 + i, 1, rows[i][2]) for i in range(60)]
    elif rows_of == "few":
        rows = [(i, None, [r.gauss(0, 1) for _ in range(8)]) for i in range(5)]
    elif rows_of == "long":
        rows = [(i, i % 2, [r.gauss(0, 0.2) for _ in range(64)]) for i in range(300)]
    else:  # a width that 8 does not divide
        rows = [(i, 0, [r.gauss(0, 1) for _ in range(11)]) for i in range(100)]
    want, said = plain_codes(rows)
    bad = [(900, 1, None), (901, 1, [None, *rows[0][2][1:]]), (902, 1, [math.nan, *rows[0][2][1:]]), (903, 1, [math.inf, *rows[0][2][1:]]), (904, 1, rows[0][2][:-1]), (905, 1, [])]
    docs = spark.createDataFrame([(*x, 5) for x in rows + bad], "vec_id long, label int, embedding array<double>, code int").repartition(4)
    coded, books = vector_codes.encode(docs)
    got = vector_codes.digest(coded, books).collect()
    assert {x.codebooks_sha256 for x in got} == {said}
    assert sorted((x.vec_id, x.code, x.error) for x in got) == sorted((i, c, e) for i, _, c, e in want)
    sums = defaultdict(int)
    for _, label, _, e in want:
        sums[label] += e
    label = {i: x for i, x, _, _ in want}
    assert all(x.label_error == sums[label[x.vec_id]] for x in got)


def test_vector_codes_prune_and_decode():
    """Bounds pass over most entries, and what is left equals a full search; codes decode to near vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (16, 64))
    x = vector_codes.integers(centres[rng.integers(0, 16, 3000)] + rng.normal(0, 0.05, (3000, 64)), 4096, 8)
    books = x[:16].transpose(1, 0, 2).copy()
    state, measured = vector_codes.first_codes(x, books), 0
    for _ in range(6):
        new = books.copy()
        for p in range(8):
            for e in range(16):
                own = x[state[0][:, p] == e, p]
                if len(own):
                    new[p, e] = own.sum(0) // len(own)
        moved = vector_codes._up(((new - books) ** 2).sum(2))
        books = new
        *state, n = vector_codes.next_codes(x, books, moved, *state)
        measured += n
        full = ((x[:, :, None] - books[None]) ** 2).sum(3)
        assert (full.argmin(2) == state[0]).all() and (state[1] ** 2 >= full.min(2)).all() and (state[2] ** 2 <= full).all()
    assert measured < 0.25 * 6 * 3000 * 8 * 16
    back = vector_codes.decode(state[0], books)
    assert back.shape == (3000, 64) and np.abs(back - (x.reshape(3000, 64) + 0.5) / 4096).mean() < 0.2


def test_vector_codes_extremes(spark):
    """Components that no long could square, an empty table, a null id, equal ids."""
    rows = [(None, 1, [1e30, 0.0]), (1, 1, [-1e30, 1.0]), (1, None, [0.5, 0.5]), (2, None, [0.5, 0.5])]
    coded, books = vector_codes.encode(spark.createDataFrame(rows, "vec_id int, label int, embedding array<float>"), parts=2, entries=2)
    got = vector_codes.digest(coded, books).collect()
    assert sorted((x.vec_id or 0) for x in got) == [0, 1, 1, 2] and all(len(x.code) == 4 for x in got)
    coded, books = vector_codes.encode(spark.createDataFrame([], "vec_id int, label string, embedding array<float>"))
    assert vector_codes.digest(coded, books).collect() == []


def plain_negatives(rows, anchor, scale=256, positives=5, negatives=3):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, label, v) in enumerate(kept):
        if i is None or not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, same_label == label) for n, (j, same_label, w) in enumerate(kept) if n != k)
        for ps, p, _ in [s for s in scored if s[2]][:positives]:
            inside = [(n, j) for n, j, same in scored if not same and 50 * -ps <= 100 * -n <= 95 * -ps][:negatives]
            out += [(i, p, rank, j, -ps, -n) for rank, (n, j) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "ties", "copies"])
def test_hard_negatives(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)  # several blocks
    r = random.Random(11)
    if kind == "spread":
        rows = [(i, r.randrange(3), [r.gauss(0, 0.3) for _ in range(16)]) for i in range(500)]
    elif kind == "ties":
        rows = [(i, r.randrange(2), [r.choice((-1.0, 0.0, 1.0)) / 256 for _ in range(5)]) for i in range(400)]
    else:
        rows = [(i, i % 2, [0.1, 0.2, 0.3] if i % 3 else [0.08, 0.17, 0.25]) for i in range(300)]
    bad = [(1000, None, rows[0][2]), (1050, 1, None), (1100, 1, [math.nan, *rows[0][2][1:]]), (1150, 1, [None, *rows[0][2][1:]])]
    docs = spark.createDataFrame([(*x, "y") for x in rows + bad], "vec_id long, label int, embedding array<double>, score string").repartition(3)
    got = hard_negatives.mine(docs, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert got


def test_hard_negatives_of_little(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.mine(spark.createDataFrame([], kind), F.col("vec_id") % 2 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, 1, [1.0])], kind), F.col("vec_id") % 2 == 0).count() == 0
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (None, 1, [0.9, 0.0]), (None, 2, [0.7, 0.0]), (3, 2, [0.6])]
    got = sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, kind), F.col("vec_id") == 0).collect()), key=repr)
    assert len(got) == 4 and {(x[0], x[3], x[5]) for x in got} == {(0, None, 256 * math.floor(0.7 * 256))}


def test_new_queries_over_small_tables(spark, small):
    for name in ("op11_line_dedup", "op12_vector_codes", "op13_hard_negatives"):
        assert queries.QUERIES[name](spark, small).count() > 0


def test_vectors_without_components(spark):
    rows = spark.createDataFrame([(i, 1, []) for i in range(3)], "vec_id long, label int, embedding array<double>")
    coded, books = vector_codes.encode(rows)
    assert {(x.code, x.error) for x in vector_codes.digest(coded, books).collect()} == {("00" * 8, 0)}
    assert hard_negatives.mine(rows, F.col("vec_id") == 0).count() == 0
