"""Vectorised word hashing on Arrow string buffers.

Everything here works on slices of at most SLICE_BYTES of text (or one document, whose
words are then hashed in chunks), so a worker's memory does not follow the Arrow batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Bytes whose powers are held at once while words are hashed.
HASH_BYTES = 1 << 18

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n odd pseudo-random 64-bit multipliers, the same in every process."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def byte_table(is_word: np.ndarray) -> np.ndarray:
    """For each byte: 0 outside words, else the byte with A-Z lower-cased."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return np.where(is_word, t, 0).astype(np.uint8)


def _space_words() -> np.ndarray:
    ok = np.ones(256, bool)
    ok[[0x20, *range(0x09, 0x0E)]] = False
    return ok


def _alnum_words() -> np.ndarray:
    ok = np.zeros(256, bool)
    ok[0x30:0x3A] = ok[0x41:0x5B] = ok[0x61:0x7B] = True
    ok[0x80:] = True
    return ok


#: Words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z. A NUL byte is a word
#: byte of the first kind; it is kept apart from "outside" by IS_SPACED.
IS_SPACED, IS_ALNUM = _space_words(), _alnum_words()
SPACED, ALNUM = byte_table(IS_SPACED), byte_table(IS_ALNUM)

_BASE = U64(0x9DDFEA08EB382D69)
_BYTES = constants(0xB17E5, 256)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        up, down = np.full(n, _BASE), np.full(n, U64(inverse))
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if n > 4 * HASH_BYTES:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is the empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `most` bytes together; a larger row stands alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of a slice of documents: 64-bit hashes, byte spans and each document's first word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, is_word: np.ndarray, table: np.ndarray):
        """data: the slice's bytes; at: the documents' offsets in them, from 0."""
        n = len(data)
        self.data, self.at = data, at
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U64)
            self.first = np.zeros(len(at), np.int64)
            return
        inside = is_word[data]
        edge = np.zeros(n, bool)
        edge[at[:-1][at[:-1] < n]] = True  # a document's first byte
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.hash = self._hashes(table)
        self.first = np.searchsorted(self.start, at)

    def _hashes(self, table: np.ndarray) -> np.ndarray:
        out, k = np.empty(len(self.start), U64), 0
        while k < len(self.start):
            base = int(self.start[k])
            m = max(k + 1, int(np.searchsorted(self.end, base + HASH_BYTES, side="right")))
            up, down = _power(int(self.end[m - 1]) - base + 1)
            total = np.zeros(int(self.end[m - 1]) - base + 1, U64)
            np.cumsum(_BYTES[table[self.data[base : self.end[m - 1]]]] * up[:-1], out=total[1:])
            a, b = self.start[k:m] - base, self.end[k:m] - base
            out[k:m] = (total[b] - total[a]) * down[a] + (b - a).astype(U64)
            k = m
        return mix64(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows within documents, and their first words."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        by, out = constants(0x6A4D, k), np.zeros(n - k + 1, U64)
        for j in range(k):
            out += self.hash[j : n - k + 1 + j] * by[j]
        whole = np.ones(n - k + 1, bool)
        for j in range(1, k):  # windows that begin fewer than k words before another document
            cut = self.first[1:-1] - j
            whole[cut[(cut >= 0) & (cut <= n - k)]] = False
        at = np.flatnonzero(whole)
        return mix64(out[at]), at

    def gram(self, lo: int, hi: int) -> int:
        """The hash of words lo to hi as one window of that length."""
        by = constants(0x6A4D, hi - lo)
        return int(mix64(np.array([(self.hash[lo:hi] * by).sum(dtype=U64)], U64))[0])


def words_of(column: pa.Array, is_word: np.ndarray, table: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, their Words) over a string column."""
    at, data = utf8(column)
    for lo, hi in slices(at, most):
        yield lo, hi, Words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], is_word, table)


def word_hashes(text: str, is_word: np.ndarray, table: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), is_word, table).hash


def row_type(ddl: str, **of):
    """The type of rows given in DDL, and as Arrow; `of` sets the types of columns taken over from the input."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([T.StructField(f.name, of.get(f.name, f.dataType)) for f in T.StructType.fromDDL(ddl).fields])
    return kind, to_arrow_schema(kind)
