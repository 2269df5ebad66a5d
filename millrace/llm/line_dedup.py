"""Operator 11: lines that recur over documents, as compressed bitmaps of the lines that stay.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys are hashed to 128 bits and
dealt out by ranges of (hash, document), sorted within each range by document and position, and each range is streamed
once. As documents are part of the bounds, a key with a third of all lines lies in as many ranges as its lines need, and
a document's lines of a key lie together. Bounds are quantiles of a bounded sample of documents: they balance, and decide nothing.

A range decides alone on every key that neither opens nor closes it: all that it holds is counts of documents and the
lines of fewer than `min_docs` documents. Of the key that opens a range and of the one that closes it, it reports the
number of documents; these reports, two a range, are all that the driver gets, and tell which of such lines go. What the
ranges say is stored in the shared folder, so that a lost executor costs no second sampling.

The lines that go are gathered by document into a bitmap with a bit a line (1: the line stays), packed eight a byte from
the highest bit on and deflated. Texts take part in no shuffle but in `clean`, which puts bitmaps to texts.

Documents have no need of distinct ids: a row is a document, known by its id and by where it lies. "First" is the
lowest integer id, then the place.

Defined results: null and empty texts are one empty line; empty keys, and keys under `min_chars` code points, always
stay; texts of any length are read whole; rows with equal or null doc_ids are documents of their own, those with null ids
last; of a line that occurs several times in a document all occurrences count as one document; an empty table gives no
rows; other columns, of whatever name, are kept by `clean` and ignored by `bitmaps`.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._text import row_type
from millrace.session import in_batches, materialize, shared_dir

SPACE = b" \t\n\x0b\x0c\r"
#: Lines in a batch that leaves a worker; sampled lines for each range, and the most that are sampled.
LINES, SAMPLE_PER_RANGE, MOST_SAMPLED = 1 << 15, 200, 200_000
LAST = (1 << 63) - 1

_LINE = "h1 long, h2 long, id long, place long, pos int, range int"
_SAID = "kind byte, h1 long, h2 long, id long, place long, pos int, range int, docs long, lead boolean"
#: What a range says: this line goes; this line goes if its key does; its opening, or closing, key has so many documents.
GOES, MAY_GO, OPENS, CLOSES = 0, 1, 2, 3


def placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key struct (id, place) that is the same whenever a row is read again, and the key's name."""
    key, integer = f"key_{uuid.uuid4().hex}", docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    own = F.coalesce(F.col("doc_id").cast("long") if integer else F.xxhash64("doc_id"), F.lit(LAST))
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select("*", F.struct(own.alias("id"), F.xxhash64(at["file_path"], at["row_index"]).alias("place")).alias(key)), key
    except AnalysisException:
        return materialize(docs.select("*", F.struct(own.alias("id"), F.monotonically_increasing_id().alias("place")).alias(key))), key


def _hashed(bounds: np.ndarray | None, min_chars: int):
    """Batches of (id, place, text) to lines; `bounds` has rows (h1, h2, id, place) in order."""

    schema = row_type(_LINE)[1]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        ids: list[int] = []
        places: list[int] = []
        at: list[int] = []

        def flush() -> pa.RecordBatch:
            hashes = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            columns = [hashes[:, 0], hashes[:, 1], np.array(ids, np.int64), np.array(places, np.int64)]
            out = [*columns, np.array(at, np.int32), _range_of(columns, bounds)]
            for held in (digests, ids, places, at):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], schema=schema)

        for batch in batches:
            for i, place, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for pos, line in enumerate((text or "").encode().split(b"\n")):
                    line = line.strip(SPACE).lower()
                    if not line or len(line) < 4 * min_chars and len(line.decode()) < min_chars:
                        continue
                    digests.append(xxhash.xxh3_128_digest(line))
                    ids.append(i), places.append(place), at.append(pos)
                    if len(at) >= LINES:
                        yield flush()
        if at:
            yield flush()

    return lines


def _range_of(columns: list[np.ndarray], bounds: np.ndarray | None) -> np.ndarray:
    """How many bounds are not above each row. Only rows that share a bound's first hash are compared further."""
    if bounds is None or not len(bounds):
        return np.zeros(len(columns[0]), np.int32)
    lo, hi = np.searchsorted(bounds[:, 0], columns[0], "left"), np.searchsorted(bounds[:, 0], columns[0], "right")
    for r in np.flatnonzero(lo < hi):
        row, a, b = tuple(int(c[r]) for c in columns), int(lo[r]), int(hi[r])
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if tuple(bounds[m].tolist()) <= row else (a, m)
        lo[r] = a
    return lo.astype(np.int32)


def _bounds(rows: DataFrame, key: str, ranges: int, min_chars: int) -> np.ndarray:
    """Quantiles of the lines of sampled documents; at most `MOST_SAMPLED` lines come to the driver."""
    wanted, there = min(MOST_SAMPLED, SAMPLE_PER_RANGE * ranges), max(1, rows.count())
    some = rows.select(f"{key}.id", f"{key}.place", "text").where(F.pmod(F.xxhash64(F.lit(17), "place"), F.lit(there)) < wanted)
    lines = in_batches(some, _hashed(None, min_chars), row_type(_LINE)[0])
    found = lines.select("h1", "h2", "id", "place").orderBy(F.xxhash64("h1", "place", "pos")).limit(wanted).collect()
    found = np.array(sorted(map(tuple, found)), np.int64).reshape(-1, 4)
    return np.unique(found[[i * len(found) // ranges for i in range(1, ranges)]], axis=0) if len(found) else found


def _streamed(min_docs: int, first: bool):
    """Sorted lines of one range to what it says of them. Rows that wait belong to fewer than min_docs documents."""
    schema = row_type(_SAID)[1]

    def said(kind: int, rows: np.ndarray, docs: int | None = None, lead: int | None = None) -> pa.RecordBatch:
        n = len(rows)
        leads = np.zeros(n, bool)
        if lead is not None:
            leads[lead] = True
        known = [pa.array(rows[:, c].astype(np.int32 if c > 3 else np.int64)) for c in range(6)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *known, pa.array([docs] * n, pa.int64()), pa.array(leads)], schema=schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = np.zeros((0, 6), np.int64)  # the lines so far of the last key, while it is undecided
        key, docs, last, opening, decided = None, 0, None, True, False
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(6)])
            if not len(rows):
                continue
            edges = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            starts = np.concatenate([[0], edges, [len(rows)]])
            fresh = np.ones(len(rows), bool)  # a line that is its key's first in its document
            fresh[1:] = np.any(rows[1:, :4] != rows[:-1, :4], axis=1)
            counts = np.add.reduceat(fresh, starts[:-1])
            # runs that begin and end inside the batch, of too few documents: most of all, and nothing to say of them
            quiet = (counts < min_docs) | (first & (np.diff(starts) == 1))
            quiet[0] = quiet[-1] = False
            for r in np.flatnonzero(~quiet):
                part = rows[starts[r] : starts[r + 1]]
                mine = tuple(part[0, :2].tolist())
                if mine != key:
                    if key is not None:
                        if opening:
                            yield said(OPENS, before, docs)
                        opening = False
                    key, docs, last, decided = mine, 0, None, False
                    waiting = np.zeros((0, 6), np.int64)
                    begun = True
                else:
                    begun = False
                docs += int(counts[r]) - (tuple(part[0, 2:4].tolist()) == last)  # a batch may end within a document
                last, before = tuple(part[-1, 2:4].tolist()), part[-1:]
                if opening:
                    yield said(MAY_GO, part, lead=0 if begun else None)
                elif decided:
                    yield said(GOES, part)
                else:
                    waiting = np.concatenate([waiting, part]) if len(waiting) else part.copy()
                    if docs >= min_docs:
                        decided = True
                        if len(waiting) > first:
                            yield said(GOES, waiting[int(first) :])
                        waiting = waiting[:0]
        if key is not None:
            if opening:
                yield said(OPENS, before, docs)
            else:
                if len(waiting):
                    yield said(MAY_GO, waiting, lead=0)
                yield said(CLOSES, before, docs)

    return stream


def _verdicts(edges: list, min_docs: int, first: bool) -> list[tuple[int, int, int, bool]]:
    """(h1, h2, range, whether the range holds a first line that stays) of the keys at ranges' edges that go."""
    by_key: dict[tuple[int, int], list] = {}
    for e in sorted(edges, key=lambda e: e.range):
        by_key.setdefault((e.h1, e.h2), []).append(e)
    return [(*key, e.range, first and e is found[0]) for key, found in by_key.items() if sum(e.docs for e in found) >= min_docs for e in found]


def dropped(rows: DataFrame, key: str, *, min_docs: int, first: bool, min_chars: int, folder: str) -> DataFrame:
    """id, place, pos of the lines that go; what ranges say is written to `folder`."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows, key, ranges, min_chars)
    ranges = len(bounds) + 1
    lines = in_batches(rows.select(f"{key}.id", f"{key}.place", "text"), _hashed(bounds, min_chars), row_type(_LINE)[0])
    dealt = lines.repartitionById(ranges, F.col("range")).sortWithinPartitions("h1", "h2", "id", "place", "pos")
    in_batches(dealt, _streamed(min_docs, first), row_type(_SAID)[0]).write.parquet(folder)
    told = spark.read.schema(row_type(_SAID)[0]).parquet(folder)
    edges = told.where(F.col("kind").isin(OPENS, CLOSES)).collect()  # two a range at most
    kind = T.StructType.fromDDL("h1 long, h2 long, range int, holds boolean")
    verdicts = spark.createDataFrame(_verdicts(edges, min_docs, first), kind)
    may = told.where(F.col("kind") == MAY_GO).join(F.broadcast(verdicts), ["h1", "h2", "range"]).where(~(F.col("lead") & F.col("holds")))
    return told.where(F.col("kind") == GOES).select("id", "place", "pos").unionByName(may.select("id", "place", "pos"))


def pack(kept: np.ndarray) -> bytes:
    """A bitmap from its bits."""
    return zlib.compress(np.packbits(kept).tobytes())


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `keep` and the number of dropped lines in place of the positions, the last column."""
    for batch in batches:
        at = batch.schema.names.index("gone")
        maps, lost = [], []
        for n, gone in zip(batch.column(at - 1).to_pylist(), batch.column(at), strict=True):
            bits = np.ones(n, bool)
            if gone.is_valid:
                bits[gone.values.to_numpy(zero_copy_only=False)] = False
            maps.append(pack(bits))
            lost.append(int(n - bits.sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(lost, pa.int64()), pa.array(maps, pa.binary())], names=[*batch.schema.names[:at], "n_dropped", "keep"])


def _marked(docs: DataFrame, rows: DataFrame, key: str, more: list[str], folder: str | None, **how) -> DataFrame:
    """`more` columns of each row, as c0, c1 and so on, n_lines, n_dropped and keep."""
    gone = dropped(rows, key, folder=folder or f"{shared_dir(docs.sparkSession)}/lines-{uuid.uuid4().hex}", **how).groupBy("id", "place").agg(F.collect_list("pos").alias("gone"))
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n")))).cast("long") + 1
    side = rows.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(more)), F.col(key)["id"].alias("id"), F.col(key)["place"].alias("place"), F.coalesce(lines, F.lit(1).cast("long")).alias("n_lines"))
    found = side.join(gone, ["id", "place"], "left").select(*(f"c{i}" for i in range(len(more))), "n_lines", "gone")
    out = T.StructType([*found.schema.fields[:-1], T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType())])
    return in_batches(found, _packed, out)


def bitmaps(docs: DataFrame, *, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1, folder: str | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep for every document (doc_id, text), read whole.

    Keys found in at least `min_docs` documents lose all lines, or all but the first one with `keep_first`; with
    `min_docs` of 1 and `keep_first` every repetition goes, within a document too. folder: a new folder, shared by all
    executors, for what the ranges say; the result reads it, and the caller may remove it after use. By default it is
    made in the shared folder and left there.
    """
    rows, key = placed(docs.select("doc_id", "text"))
    found = _marked(docs, rows, key, ["doc_id"], min_docs=min_docs, first=keep_first, min_chars=min_chars, folder=folder)
    return found.withColumnRenamed("c0", "doc_id")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, out = batch.schema.names.index("c0"), []
        for text, n, bitmap in zip(batch.column(at).to_pylist(), batch.column("n_lines").to_pylist(), batch.column("keep").to_pylist(), strict=True):
            bits = unpack(bitmap, n)
            out.append(text if bits.all() else "\n".join(x for x, stays in zip(text.split("\n"), bits, strict=True) if stays))
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def clean(docs: DataFrame, *, into: tuple[str, str, str] = ("n_lines", "n_dropped", "keep"), min_docs: int = 2, keep_first: bool = True, min_chars: int = 1, folder: str | None = None) -> DataFrame:
    """docs without the lines that go, and with the columns named in `into`; the lines left are joined by line ends.

    A text that loses nothing stays as it is (null too); one that loses every line becomes empty. The rest as in `bitmaps`.
    """
    rows, key = placed(docs)
    names = ["text", *(c for c in docs.columns if c != "text")]
    found = _marked(docs, rows, key, names, min_docs=min_docs, first=keep_first, min_chars=min_chars, folder=folder)
    found, order = in_batches(found, _cut, found.schema), {c: f"c{i}" for i, c in enumerate(names)}
    return found.select(*(F.col(order[c]).alias(c) for c in docs.columns), *(F.col(c).alias(n) for c, n in zip(("n_lines", "n_dropped", "keep"), into, strict=True)))
