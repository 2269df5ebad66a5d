"""Operator 12: vectors compressed to codes of parts, with Elkan's pruning of Lloyd's rounds.

Components become integers, floor(scale * x). A vector is cut into equal consecutive parts; each part position has a
codebook of its own, first the parts of the vectors with the smallest ids. A round gives every part its nearest entry,
then moves each entry to the componentwise floored mean of its parts.

Between rounds each row keeps, for each part, an upper bound of the distance to its entry and a lower bound of the
distance to every entry. When entries move, lower bounds shrink by how far theirs moved and upper bounds grow by it; all
are rounded outward, so they stay bounds. An entry is passed over only where it is strictly farther than the part's own:
where its lower bound, or half its distance from the own entry, exceeds the upper bound. The others are measured as
integers, and of equal integers the lower index wins, so no rounding decides. Rows, bounds and codes are a table in the
shared folder, written anew each round and removed after the next; a round is one pass over it. A task sums its parts by
entry; the driver gets the sums of as many numbers as the codebooks have and makes the codebooks, whatever the number of rows.

Defined results: rows whose vector is null, or holds a null or a non-finite component, have no code; so have those whose
vector is not as long as that of the smallest id (of equal ids, the smallest vector). Vectors whose length the parts do
not divide are filled up with zeros. Components beyond +-2**26 count as that, so that sums of squares fit a long. With
fewer rows than entries, codebooks are as small as that. Entries without parts stay. Rows with equal or null ids are rows
of their own, null ids last. An empty table gives no rows and no codebooks; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._text import row_type
from millrace.llm._vectors import blobs, matrix, unblob, usable, width_of
from millrace.session import in_batches, remove, shared_dir

#: Components beyond this count as this.
FARTHEST = 1 << 26
#: Labels whose sums are sent to all tasks.
MOST_BROADCAST = 500_000
#: Rows taken at a time, so that what a batch needs stays small.
ROWS = 4096

_STATE = "x binary, code binary, upper binary, lower binary"


def integers(vectors: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """(rows, parts, width of a part) as integers, filled up with zeros."""
    held = np.clip(np.floor(scale * vectors), -FARTHEST, FARTHEST).astype(np.int64)
    if gap := -held.shape[1] % parts:
        held = np.pad(held, ((0, 0), (0, gap)))
    return held.reshape(len(held), parts, held.shape[1] // parts)


def _up(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf).astype(np.float64)


def _down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squares.astype(np.float64)), -np.inf), 0)


def _squares(x: np.ndarray, rows: np.ndarray, parts: np.ndarray, entries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of the given parts to the given entries, as integers."""
    gap = x[rows, parts] - books[parts, entries]
    return np.einsum("ij,ij->i", gap, gap)


def first_codes(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper and lower bounds before anything is known: all entries are measured."""
    squares = np.stack([((x - books[:, e]) ** 2).sum(2) for e in range(books.shape[1])], 2)
    code = squares.argmin(2)
    return code, _up(np.take_along_axis(squares, code[..., None], 2)[..., 0]), _down(squares)


def next_codes(x: np.ndarray, books: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds after entries moved by at most `moved` (parts, entries), and how many distances were measured."""
    every, n_entries = np.arange(books.shape[0])[None, :], books.shape[1]
    upper = np.nextafter(upper + moved[every, code], np.inf)
    lower = np.maximum(np.nextafter(lower - moved, -np.inf), 0)
    gaps = books[:, :, None] - books[:, None, :]
    halves = _down((gaps**2).sum(3)) / 2  # half the distances between a part's entries, rounded down
    own = np.arange(n_entries) == code[..., None]
    open_ = ~own & ~(lower > upper[..., None]) & ~(halves[every, code] > upper[..., None])
    r, p = np.nonzero(open_.any(2))  # of these the upper bound is made exact
    best = _squares(x, r, p, code[r, p], books)
    upper[r, p] = _up(best)
    lower[r, p, code[r, p]] = _down(best)
    open_[r, p] &= ~(lower[r, p] > upper[r, p][:, None]) & ~(halves[p, code[r, p]] > upper[r, p][:, None])
    at, e = np.nonzero(open_[r, p])
    found = _squares(x, r[at], p[at], e, books)
    lower[r[at], p[at], e] = _down(found)
    ranked = np.full((len(r), n_entries), np.iinfo(np.int64).max)
    ranked[np.arange(len(r)), code[r, p]] = best
    ranked[at, e] = found
    code, nearest = code.copy(), ranked.argmin(1)  # of equal ones the first
    code[r, p] = nearest
    upper[r, p] = _up(ranked[np.arange(len(r)), nearest])
    return code, upper, lower, len(best) + len(found)


def _state(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> list[pa.Array]:
    return [blobs(x.astype(np.int32)), blobs(code.astype(np.uint8)), blobs(upper), blobs(lower)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _begun(books: np.ndarray, width: int, scale: int, kind: pa.Schema):
    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            x = integers(matrix(batch.column("vector"), width), scale, books.shape[0])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *_state(x, *first_codes(x, books))], schema=kind)

    return begin


def _read(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, ...]:
    parts, entries, width = books.shape
    x = unblob(batch.column("x"), np.int32, (parts, width)).astype(np.int64)
    return x, unblob(batch.column("code"), np.uint8, (parts,)).astype(np.int64), *(unblob(batch.column(c), np.float64, s) for c, s in (("upper", (parts,)), ("lower", (parts, entries))))


def _renewed(books: np.ndarray, moved: np.ndarray, kind: pa.Schema):
    def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            x, *known = _read(batch, books)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *_state(x, *next_codes(x, books, moved, *known)[:3])], schema=kind)

    return renew


def _summed(parts: int, entries: int, width: int, kind: pa.Schema):
    """Batches of (x, code) to the sum of each component of each part's entries and what it is the sum of, once a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in _pieces(batches):
            x, code = unblob(batch.column("x"), np.int32, (parts, width)), unblob(batch.column("code"), np.uint8, (parts,))
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], x[:, p])
        p, e = np.nonzero(counts)
        columns = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), np.repeat(counts[p, e], width), sums[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kind, strict=True)], schema=kind)

    return add


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of their parts. The driver gets a row for each component of them."""
    kind, arrow = row_type("part int, entry int, pos int, n long, total long")
    summed = in_batches(state.select("x", "code"), _summed(*books.shape, arrow), kind)
    out = books.copy()
    for r in summed.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r.part, r.entry, r.pos] = r.total // r.n  # floors negative sums down too
    return out


def books_text(books: np.ndarray) -> str:
    """All components by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))


def encode(rows: DataFrame, *, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, folder: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every row of `rows` with a usable vector, and the codebooks (parts, entries, width).

    code has a byte a part; error is the sum of its parts' squared distances to their entries. folder: a new folder, shared by
    all executors; the result reads its last table, and the caller may remove it after use.
    """
    spark = rows.sparkSession
    folder = folder or f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    held = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("label"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    held = held.withColumn("none", F.col("id").isNull())
    width = width_of(held.withColumn("at", F.struct("none", "id")), "at", "vector")
    held = held.where(F.size("vector") == width)
    first = [r[0] for r in held.orderBy("none", "id", "vector").select("vector").limit(entries).collect()]
    books = integers(np.array(first, np.float64).reshape(len(first), width), scale, parts).transpose(1, 0, 2).copy()
    ids = {"id": held.schema["id"].dataType, "label": held.schema["label"].dataType}
    kind, arrow = row_type(f"id int, label int, {_STATE}", **ids)
    if not len(first):
        nothing = spark.createDataFrame([], row_type("vec_id int, label int, code binary, error long", vec_id=ids["id"], label=ids["label"])[0])
        return nothing, books
    in_batches(held.select("id", "label", "vector"), _begun(books, width, scale, arrow), kind).write.parquet(f"{folder}/0")
    for k in range(rounds):
        state = spark.read.schema(kind).parquet(f"{folder}/{k}")
        old, books = books, moved_books(state, books)
        moved = _up(((books - old) ** 2).sum(2))
        in_batches(state, _renewed(books, moved, arrow), kind).write.parquet(f"{folder}/{k + 1}")
        remove(spark, f"{folder}/{k}")
    made, sent = row_type("id int, label int, code binary, error long", **ids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            x, code = unblob(batch.column("x"), np.int32, books.shape[::2]).astype(np.int64), unblob(batch.column("code"), np.uint8, (parts,))
            gap = x - books[np.arange(parts)[None, :], code]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("code"), pa.array((gap**2).sum((1, 2)))], schema=sent)

    last = spark.read.schema(kind).parquet(f"{folder}/{rounds}").select("id", "label", "x", "code")
    return in_batches(last, measure, made).withColumnRenamed("id", "vec_id"), books


def decode(codes: np.ndarray, books: np.ndarray, scale: int = 4096) -> np.ndarray:
    """Vectors of rows of codes (rows, parts): the middle of what their entries' integers stand for."""
    return ((books[np.arange(books.shape[0])[None, :], codes] + 0.5) / scale).reshape(len(codes), -1)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors of equal labels summed, null labels together; null where it does not fit a long.

    Sums are made before the shuffle; up to `MOST_BROADCAST` of them go to all tasks, and beyond that both sides are shuffled.
    """
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    sums = F.broadcast(sums) if coded.select("label").distinct().count() <= MOST_BROADCAST else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def digest(coded: DataFrame, books: np.ndarray) -> DataFrame:
    said = hashlib.sha256(books_text(books).encode()).hexdigest()
    return with_label_errors(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(said).alias("codebooks_sha256"))
