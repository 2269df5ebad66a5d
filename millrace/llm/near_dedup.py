"""Operator 5: near-duplicates by min-max hashing, confirmed on full shingle sets.

Of each of PERMUTATIONS permutations of a document's shingles both the smallest and the largest value are kept,
so a signature of 2 * PERMUTATIONS values costs half the hash evaluations. Signatures are banded: documents that
agree in all values of a band share a bucket. At similarity 0.8 a pair of large sets shares none of the 40 bands of 6
values with a probability of 5e-6; of small sets minima and maxima agree together more often, which makes that 6e-5 for
sets of 5 and 4 shingles.

Documents with equal shingle sets form a class and go on as one. Links between classes are confirmed on their
full sets; pairs whose signatures agree in under LEAST_AGREEING of their values (7.7 standard deviations below
0.8) are not tried. A test measures, by the size of sets, which share of pairs at 0.80 to 0.82 is linked. No bucket's pairs are all emitted:

1. In every bucket the smallest class is the pivot; each class tries the pivot with which it shares most
   bands. Confirmed links give trees, so a bucket of near copies takes as many tries as it has members.
2. Buckets that still hold several components are compared in blocks of about BLOCK by BLOCK classes: those
   outside the largest component with all others, two of them once. A block picks by signatures which of its classes
   may be linked over components (a pair that shares several bands only in the first of them), gets the sets of those
   once, and emits the links that join components: fewer rows than it has members.

Components are found with alternating
large- and small-star steps. A hot bucket is dealt out by blocks, a hot pivot or class by skew joins.

Defined results: words are runs without ASCII white space, A-Z lower-cased; a document's set has its distinct
`width`-word shingles; with fewer words the whole sequence as one; null and empty texts have the empty set and
are linked with nothing; rows without a doc_id are linked with nothing and have no component; repeated rows
and doc_ids with one text share a class; texts of any length count whole; an empty table gives no rows; other
columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._text import IS_SPACED, SPACED, Words, constants, mix64, row_type, words_of
from millrace.session import in_batches, materialize

PERMUTATIONS, BANDS = 120, 40
ROWS = 2 * PERMUTATIONS // BANDS
LEAST_AGREEING, BLOCK, PIVOT_BANDS, MOST_BROADCAST = 0.6, 512, 4, 1_000_000

_A = (constants(11, PERMUTATIONS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (constants(12, PERMUTATIONS) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each document of a slice."""
    grams, at = words.grams(width)
    bounds, counts = np.searchsorted(at, words.first), words.counts()
    out = []
    for d, n in enumerate(counts):
        if 0 < n < width:
            out.append(np.array([words.gram(int(words.first[d]), int(words.first[d + 1]))], np.uint64))
        else:
            out.append(np.unique(grams[bounds[d] : bounds[d + 1]]))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest and largest value of each set under each permutation; sets must not be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    for p in range(PERMUTATIONS):
        x = flat * _A[p] + _B[p]
        out[:, 2 * p] = np.minimum.reduceat(x, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(x, starts)
    return out


def _key(s: np.ndarray) -> bytes:
    return np.array([mix64(s).sum(dtype=np.uint64), mix64(s * constants(5, 1)[0]).sum(dtype=np.uint64)], ">u8").tobytes()


def _sketch(batches: Iterator[pa.RecordBatch], width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    by, band = constants(21, ROWS), constants(22, BANDS)
    for batch in batches:
        for lo, hi, words in words_of(batch.column("text"), IS_SPACED, SPACED):
            sets = shingle_sets(words, width)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, bands, sigs = [b""] * len(sets), [np.zeros(0, np.int64)] * len(sets), [b""] * len(sets)
            if full:
                sig = signatures([sets[i] for i in full])
                hashed = mix64((sig.reshape(len(full), BANDS, ROWS).astype(np.uint64) * by).sum(axis=2, dtype=np.uint64) + band).view(np.int64)
                low = (sig ^ (sig >> np.uint32(16))).astype(np.uint8)
                for k, i in enumerate(full):
                    keys[i], bands[i], sigs[i] = _key(sets[i]), hashed[k], low[k].tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(np.concatenate(bands), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists.cast(schema.field("bands").type), pa.array(sigs, pa.binary())], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch], width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in words_of(batch.column("text"), IS_SPACED, SPACED):
            sets = shingle_sets(words, width)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), lists.cast(schema.field(1).type)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Successive rows that are equal in `by`, as one table each."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_pylist() for c in by]
        lo = 0
        for i, key in enumerate(zip(*columns, strict=True)):
            if key != last:
                if i > lo:
                    kept.append(batch.slice(lo, i - lo))
                if kept:
                    yield pa.Table.from_batches(kept)
                kept, lo, last = [], i, key
        kept.append(batch.slice(lo))
    if kept:
        yield pa.Table.from_batches(kept)


_CELL = ["band", "hash", "outer_block", "inner_block"]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of signatures or bands as rows of numbers."""
    if pa.types.is_list(column.type):
        return np.asarray(pa.concat_arrays([c.flatten() for c in column.chunks])).reshape(len(column), -1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _cells(live: DataFrame) -> DataFrame:
    """Classes of buckets, each in the blocks that it belongs to: outer by inner ones, in one pass over the classes.

    A class of the bucket's largest component is only inner; a small one is outer too.
    """
    small, own = F.col("component") != F.col("most"), lambda blocks: F.pmod(F.xxhash64("key"), F.col(blocks)).cast("int")
    at = lambda i, j, outer, inner: F.struct(i.alias("outer_block"), j.alias("inner_block"), outer.alias("outer"), inner.alias("inner"))
    every = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    outer = F.when(small, F.transform(every("inner_blocks"), lambda j: at(own("outer_blocks"), j, F.lit(True), j == own("inner_blocks")))).otherwise(F.array())
    inner = F.transform(F.filter(every("outer_blocks"), lambda i: ~small | (i != own("outer_blocks"))), lambda i: at(i, own("inner_blocks"), F.lit(False), F.lit(True)))
    return live.select("band", "hash", "key", "n", "component", small.alias("small"), "sig", F.col("all_bands").alias("bands"), F.inline(F.concat(outer, inner)))


def _places(*lists: np.ndarray) -> list[np.ndarray]:
    """Lists of keys as their places among all of them."""
    place = {k: i for i, k in enumerate(sorted({k for keys in lists for k in keys}))}
    return [np.array([place[k] for k in keys], np.int64) for keys in lists]


def _candidates(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The classes of each block that take part in a pair to confirm, each once; outer ones with their partners' keys.

    A pair belongs to the block of the first band that it shares, and of two classes that are both `small` (outside the
    bucket's largest component) to that in which the smaller is outer.
    """
    rows: list[tuple] = []
    for block in _runs(batches, _CELL):
        outer, inner = block.filter(block.column("outer")), block.filter(block.column("inner"))
        if not len(outer) or not len(inner):
            continue
        cell = [block.column(c)[0].as_py() for c in _CELL]
        (sx, sy), (bx, by) = ([_matrix(t.column(c)) for t in (outer, inner)] for c in ("sig", "bands"))
        (nx, ny), (cx, cy), (kx, ky) = ([np.array(t.column(c).to_pylist(), object if c != "n" else np.int64) for t in (outer, inner)] for c in ("n", "component", "key"))
        small = np.array(inner.column("small").to_pylist(), bool)
        (px, py), (gx, gy) = _places(kx, ky), _places(cx, cy)  # numpy takes bytes that end in NUL for shorter ones
        partners, told = set(), set()
        for i in range(len(kx)):
            ok = np.flatnonzero((gy != gx[i]) & (~small | (py > px[i])) & (100 * np.minimum(ny, nx[i]) >= 80 * np.maximum(ny, nx[i])) & ((by == bx[i]).argmax(axis=1) == cell[0]))
            agree = (sy[ok] == sx[i]).sum(axis=1)
            best = np.argsort(-agree, kind="stable")
            found = ok[best[agree[best] >= LEAST_AGREEING * 2 * PERMUTATIONS]]
            if len(found):
                rows.append((*cell, kx[i], cx[i], [ky[j] for j in found]))
                partners.update(found.tolist())
                told.add(kx[i])
        rows += [(*cell, ky[j], cy[j], None) for j in sorted(partners) if ky[j] not in told]
        if len(rows) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _links(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of each block's candidates the links that are confirmed and join what no other of its links has joined."""
    found: list[tuple[bytes, bytes]] = []
    for block in _runs(batches, _CELL):
        keys, parts, partners = (block.column(c).to_pylist() for c in ("key", "component", "partners"))
        sets = {k: np.asarray(x.values) for k, x in zip(keys, block.column("shingles"), strict=True)}
        component = dict(zip(keys, parts, strict=True))
        root = {c: c for c in parts}

        def top(c: bytes, root=root) -> bytes:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for a, others in zip(keys, partners, strict=True):
            for b in others or ():
                x, y = top(component[a]), top(component[b])
                if x == y:
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[x] = y
                    found.append((min(a, b), max(a, b)))
    yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.binary()) for j in (0, 1)], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """(key, component) for the ends of edges (a, b): the component's smallest key. Large-star and small-star steps."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # Large star: each neighbour above a node points to the smallest neighbour.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Small star: a node and its neighbours below it point to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
        edges = materialize(small.where("a <> b").distinct())
        # Done once every node has one neighbour below it that has none.
        ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").limit(1).count():
            break
    return edges.select(F.col("a").alias("key"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 at least."""
    of = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - both
    return pairs.join(of("b"), "b").join(of("a"), "a").where(100 * both >= 80 * union).select("a", "b")


def link(docs: DataFrame, *, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", "text")
    kind, arrow = row_type("doc_id long, key binary, n long, bands array<long>, sig binary", doc_id=id_type)
    sketches = materialize(docs.transform(in_batches, lambda it: _sketch(it, width, arrow), kind))
    some = sketches.where("n > 0 and doc_id is not null")
    classes = materialize(some.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))

    # A bucket's rows: only of buckets with several classes.
    banded = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    pivots = banded.groupBy("band", "hash").agg(F.min("key").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = materialize(banded.join(pivots, ["band", "hash"]).select("band", "hash", "pivot", "key"))
    shared = buckets.where("key <> pivot").groupBy("key", "pivot").agg(F.count(F.lit(1)).alias("bands")).where(F.col("bands") >= PIVOT_BANDS)
    pairs = materialize(shared.groupBy("key").agg(F.max(F.struct("bands", "pivot")).alias("x")).select(F.col("x.pivot").alias("a"), F.col("key").alias("b")))

    # Sets are made of the classes that share a bucket with another, from one text each.
    wanted = materialize(classes.join(buckets.select("key").distinct(), "key", "left_semi").select("doc_id"))
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    kind, arrow = row_type("key binary, shingles array<long>")
    sets = materialize(docs.join(wanted, "doc_id", "left_semi").transform(in_batches, lambda it: _sets(it, width, arrow), kind))
    if sets.count() != sets.select("key").distinct().count():  # repeated rows
        sets = materialize(sets.dropDuplicates(["key"]))

    # Each class has one pivot at most, a smaller one: two jumps up these trees give components that will do here.
    edges = materialize(_confirmed(pairs, sets))
    labels = edges.select(F.col("b").alias("key"), F.col("a").alias("component"))
    for _ in range(2):
        above = labels.select(F.col("key").alias("component"), F.col("component").alias("top"))
        labels = labels.join(above, "component", "left").select("key", F.coalesce("top", "component").alias("component"))
    labels = materialize(labels)
    member = buckets.join(labels, "key", "left").select("band", "hash", "key", F.coalesce("component", "key").alias("component"))
    # The largest component of each bucket that has several is only compared with; counts are summed before the shuffle.
    sizes = member.groupBy("band", "hash", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("total"), F.max(F.struct("size", "component")).alias("top")).where("parts > 1")
    blocks = lambda size: F.ceil(size / BLOCK).cast("int")
    mixed = mixed.select("band", "hash", F.col("top.component").alias("most"), blocks(F.col("total") - F.col("top.size")).alias("outer_blocks"), blocks(F.col("total")).alias("inner_blocks"))
    live = member.join(mixed, ["band", "hash"]).join(classes.select("key", "n", "sig", F.col("bands").alias("all_bands")), "key")
    cells = _cells(live)
    kind, arrow = row_type("band int, hash long, outer_block int, inner_block int, key binary, component binary, partners array<binary>")
    found = cells.repartition(*_CELL).sortWithinPartitions(*_CELL).transform(in_batches, lambda it: _candidates(it, arrow), kind)
    kind, pair = row_type("a binary, b binary")
    checked = found.join(sets, "key").repartition(*_CELL).sortWithinPartitions(*_CELL).transform(in_batches, lambda it: _links(it, pair), kind)
    labels = components(edges.union(checked.distinct()))

    roots = classes.select("key", "doc_id").join(labels, "key")
    least = roots.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = roots.select("key", "component").join(least, "component").select("key", "component_id")
    alone = classes.join(labels.select("key"), "key", "left_anti").select("key", F.col("doc_id").alias("component_id"))
    of = linked.union(alone)
    out = sketches.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key")).join(of, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
