"""Operator 6: benchmark decontamination with a distributed positional inverted index.

The corpus is indexed once, whatever the benchmark: each segment of documents stores for every term that occurs in
it (as a 64-bit hash) the sorted positions at which it stands, delta-coded and compressed, next to its documents' ids
and word counts. The index lies in the shared folder and serves any number of blocks of windows. Segments hold whole
documents, so the lists of a window's terms meet without a shuffle. Term frequencies come from the stored index.

A search takes each window's terms from the rarest on: the positions of the rarest, less its offset, are candidate
starts, and each further term keeps those at whose offset it has a posting. What is left after all terms is an exact
occurrence. A proximity match is a place of a window in a document at which all but a fifth of its terms stand within
`slack` words of their offset. Of the missing and the one next to them in rarity at least one must stand there, so the
postings of these few rarest terms lead to all matches; they are tried with twice the slack before each shift is.

The benchmark is the stated query set. Its items are hashed in tasks, long ones in overlapping pieces, and dealt into
blocks of about `BLOCK_WORDS` words, which are read one at a time; each goes to the tasks whole (some 55 MB for a block
of windows of 10 words), and the results of several blocks are joined by document.

Defined results: null and empty texts have no words and no hits; items without words never occur; equal
windows of several items count for each of them; items with one id count once; documents and items of any length are
searched whole; repeated rows and doc_ids are searched once per row; an empty corpus gives no rows, an empty benchmark
no hits; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._text import ALNUM, IS_ALNUM, row_type, word_hashes, words_of
from millrace.session import in_batches, materialize

WINDOW, SLACK, BLOCK_WORDS, PIECE_WORDS = 10, 3, 1_000_000, 100_000
_CODEC = "zstd"


def _packed(values: np.ndarray, kind: str) -> bytes:
    return pa.compress(values.astype(kind).tobytes(), codec=_CODEC, asbytes=True)


def _unpacked(value: pa.Scalar, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(value.as_buffer(), decompressed_size=n * np.dtype(kind).itemsize, codec=_CODEC), kind)


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for lo, hi, words in words_of(batch.column("text"), IS_ALNUM, ALNUM):
            at = np.argsort(words.hash, kind="stable").astype(np.uint32)
            ordered = words.hash[at]
            begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(at) else np.zeros(0, np.int64)
            terms, counts = ordered[begin], np.diff(begin, append=len(at))
            steps = np.diff(at, prepend=np.uint32(0))  # modulo 2^32
            steps[begin] = at[begin]
            del ordered
            uids = pa.array(np.arange(uid, uid + hi - lo), pa.int64())
            uid += hi - lo
            lists = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), c) for c in (batch.column("doc_id")[lo:hi], uids)]
            packed = [pa.array([_packed(v, k)], pa.binary()) for v, k in ((words.first, "<u4"), (terms, "<u8"), (counts, "<u4"), (steps, "<u4"))]
            yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip([*lists, pa.array([len(at)]), pa.array([len(terms)]), *packed], schema.types, strict=True)], schema=schema)


def _known(batch: pa.RecordBatch, row: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment's terms those of a vocabulary: their place in it, their place in the segment, and all terms' counts."""
    n = batch.column("n_terms")[row].as_py()
    terms, counts = _unpacked(batch.column("terms")[row], n, "<u8"), _unpacked(batch.column("counts")[row], n, "<u4").astype(np.int64)
    if not n or not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    at = np.minimum(np.searchsorted(terms, vocabulary), n - 1)
    known = np.flatnonzero(terms[at] == vocabulary)
    return known, at[known], counts


def _postings(batch: pa.RecordBatch, row: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, positions) of the terms of a vocabulary in a segment."""
    known, at, counts = _known(batch, row, vocabulary)
    steps = _unpacked(batch.column("steps")[row], batch.column("n_words")[row].as_py(), "<u4")
    begin = np.cumsum(counts) - counts
    places, own = _spread(begin[at], (begin + counts)[at])
    if not len(places):
        return known, counts[at], places
    total = np.cumsum(steps, dtype=np.uint32)
    base = total[begin[at]] - steps[begin[at]]
    return known, counts[at], (total[places] - base[own]).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    n = np.zeros(len(vocabulary), np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            known, at, counts = _known(batch, row, vocabulary)
            n[known] += counts[at]
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], schema=schema)


class Windows:
    """The distinct windows of a block of items, those of one length together."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.ids = [i for i, _ in items]
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        rows: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, hashes) in enumerate(items):
            terms = np.searchsorted(self.vocabulary, hashes).astype(np.int32)
            n = min(window, len(terms))
            rows.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(terms, n), k))
        self.groups = []
        for n, found in sorted(rows.items()):
            every = np.concatenate([w for w, _ in found])
            owner = np.concatenate([np.full(len(w), k) for w, k in found])
            distinct, back = np.unique(every, axis=0, return_inverse=True)
            pairs = np.unique(np.column_stack([back.ravel(), owner]), axis=0)
            self.groups.append((n, distinct, pairs))

    def order_by_rarity(self, frequency: np.ndarray) -> None:
        """Plan each window's lookups from its rarest term on; find windows by each of their rarest terms."""
        self.plans = []
        for n, windows, pairs in self.groups:
            order = np.argsort(frequency[windows], axis=1, kind="stable").astype(np.min_scalar_type(n))
            by_term = []
            for level in range(min(n // 5 + 1, n)):
                own = np.take_along_axis(windows, order[:, level : level + 1].astype(np.int64), 1).ravel()
                by = np.argsort(own, kind="stable")
                by_term.append((by, own[by]))
            self.plans.append((n, windows, order, by_term, self._owners(pairs, np.arange(len(windows)), len(windows))))

    @staticmethod
    def _owners(pairs: np.ndarray, inverse: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        window = inverse[pairs[:, 0]]
        by = np.argsort(window, kind="stable")
        return np.searchsorted(window[by], np.arange(n + 1)), pairs[by, 1]


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [start, end), and the range of each."""
    n = end - start
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + start[own], own


def intersect(terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, first: np.ndarray, windows: Windows, slack: int) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], list[tuple[np.ndarray, np.ndarray]]]:
    """Exact occurrences [(window starts, their items' rows, length)] and near ones [(starts, items)] in a segment."""
    postings = (np.repeat(terms.astype(np.int64), counts) << 32) | positions
    ends = np.cumsum(counts)
    exact, near = [], []

    def documents(start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether windows lie within a document, and its bounds."""
        own = np.clip(np.searchsorted(first, start, side="right") - 1, 0, len(first) - 2)
        return (start >= first[own]) & (start + n <= first[own + 1]), first[own], first[own + 1]

    def held(term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether terms have a posting from low to high."""
        low, high = (term << 32) | low, (term << 32) | high
        at = np.minimum(np.searchsorted(postings, low), len(postings) - 1)
        return (postings[at] >= low) & (postings[at] <= high)

    def owners(start: np.ndarray, window: np.ndarray, owner_at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        item, pick = _spread(owner_at[window], owner_at[window + 1])
        return start[pick], owner[item]

    for n, spec, order, by_term, (owner_at, owner) in windows.plans:

        def anchored(level: int, by_term=by_term, order=order) -> tuple[np.ndarray, np.ndarray]:
            """(window, start) for all postings of the windows' terms of a rank of rarity."""
            by, sorted_terms = by_term[level]
            own_terms = terms.astype(sorted_terms.dtype)
            lo, hi = np.searchsorted(sorted_terms, own_terms), np.searchsorted(sorted_terms, own_terms, side="right")
            has = hi > lo
            place, own = _spread(lo[has], hi[has])
            posting, pick = _spread((ends - counts)[has][own], ends[has][own])
            window = by[place][pick]
            return window, positions[posting].astype(np.int64) - order[window, level].astype(np.int64)

        window, start = anchored(0)
        whole = documents(start, n)[0] if len(start) else np.zeros(0, bool)
        window, start = window[whole], start[whole]
        for level in range(1, n):
            if not len(start):
                break
            offset = order[window, level].astype(np.int64)
            at = start + offset
            left = held(spec[window, offset].astype(np.int64), at, at)
            window, start = window[left], start[left]
        exact.append((*owners(start, window, owner_at, owner), n))

        def spared(window: np.ndarray, start: np.ndarray, width: int, n=n, spec=spec, order=order) -> tuple[np.ndarray, np.ndarray]:
            """Places at which at most a fifth of the terms do not stand within `width` words of their offset."""
            missed = np.zeros(len(start), np.int64)
            for level in range(n):
                if not len(start):
                    break
                _, begin, end = documents(np.clip(start, first[0], first[-1] - 1), 1)
                offset = order[window, level].astype(np.int64)
                low, high = np.maximum(start + offset - width, begin), np.minimum(start + offset + width, end - 1)
                missed = missed + ~((low <= high) & held(spec[window, offset].astype(np.int64), low, np.maximum(high, low)))
                left = missed <= n // 5
                window, start, missed = window[left], start[left], missed[left]
            return window, start

        if slack:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for level in range(min(n // 5 + 1, n)):
                window, start = anchored(level)
                # A window's place is held by the document of the posting that leads to it.
                anchor = start + order[window, level].astype(np.int64)
                _, begin, end = documents(anchor, 1) if len(anchor) else (None, anchor, anchor)
                shift = np.arange(-slack, slack + 1)
                window, start, begin, end = _coarse(window, start, begin, end, n, spec, order, held, 2 * slack)
                moved = (start[:, None] + shift).ravel()
                window, begin, end = (np.repeat(x, len(shift)) for x in (window, begin, end))
                whole = (moved >= begin) & (moved + n <= end)
                found.append(spared(window[whole], moved[whole], slack))
            pairs = np.unique(np.column_stack([np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])]).astype(np.int64), axis=0)
            near.append(owners(pairs[:, 1], pairs[:, 0], owner_at, owner))
    return exact, near


def _coarse(window, start, begin, end, n, spec, order, held, width):
    """Postings around which, with a wider slack, at most a fifth of the terms are missing; bounds are the document's."""
    missed = np.zeros(len(start), np.int64)
    for level in range(n):
        if not len(start):
            break
        offset = order[window, level].astype(np.int64)
        low, high = np.maximum(start + offset - width, begin), np.minimum(start + offset + width, end - 1)
        missed = missed + ~((low <= high) & held(spec[window, offset].astype(np.int64), np.minimum(low, high), high))
        left = missed <= n // 5
        window, start, missed, begin, end = window[left], start[left], missed[left], begin[left], end[left]
    return window, start, begin, end


def _search(batches: Iterator[pa.RecordBatch], windows: Windows, slack: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            first = _unpacked(batch.column("first")[row], len(batch.column("uid")[row]) + 1, "<u4").astype(np.int64)
            terms, counts, positions = _postings(batch, row, windows.vocabulary)
            docs = len(first) - 1
            exact, near = intersect(terms, counts, positions, first, windows, slack) if len(positions) else ([], [])
            change, items, close = np.zeros(int(first[-1]) + 1, np.int64), [set() for _ in range(docs)], [set() for _ in range(docs)]
            for start, item, n in exact:
                np.add.at(change, start, 1)
                np.add.at(change, start + n, -1)
                for d, i in zip(np.searchsorted(first, start, side="right") - 1, item, strict=True):
                    items[d].add(windows.ids[i])
            for start, item in near:
                for d, i in zip(np.searchsorted(first, start, side="right") - 1, item, strict=True):
                    close[d].add(windows.ids[i])
            hit = np.cumsum(change[:-1]) > 0
            edge = np.zeros(len(hit), bool)
            edge[first[:-1][first[:-1] < len(hit)]] = True
            begin = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & ~edge))
            end = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & ~np.concatenate([edge[1:], [True]]))) + 1
            owner = np.searchsorted(first, begin, side="right") - 1
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(docs + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(begin - first[owner], pa.int64()), pa.array(end - first[owner], pa.int64())], ["begin", "end"]))
            made = [*(batch.column(k)[row].values for k in ("doc_id", "uid")), pa.array(np.diff(first), pa.int64()), runs, pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([sorted(x - y) for x, y in zip(close, items, strict=True)], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(made, schema.types, strict=True)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch], window: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Items as hashes of their words, in pieces that share a window less a word; each with the words before it in its task."""
    task, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            hashes = word_hashes(text or "", IS_ALNUM, ALNUM)
            for lo in range(0, max(len(hashes) - window + 1, min(len(hashes), 1)), PIECE_WORDS):
                piece = hashes[lo : lo + PIECE_WORDS + window - 1]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((task, before, len(piece), item, piece.astype("<u8").tobytes()), schema.types, strict=True)], schema=schema)
                before += len(piece)


def _blocks(benchmark: DataFrame, window: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The benchmark's pieces in blocks; the driver holds one block, and a number for each task that made pieces."""
    kind, arrow = row_type("task long, before long, n long, item_id string, hashes binary")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    pieces = materialize(items.transform(in_batches, lambda it: _pieces(it, window, arrow), kind))
    sums = sorted((r["task"], r["n"]) for r in pieces.groupBy("task").agg(F.sum("n").alias("n")).collect())
    ends = np.cumsum([n for _, n in sums])
    spark = benchmark.sparkSession
    starts = spark.createDataFrame([(task, int(end - n)) for (task, n), end in zip(sums, ends, strict=True)], "task long, base long")
    dealt = pieces.join(F.broadcast(starts), "task").withColumn("block", F.floor((F.col("base") + F.col("before")) / BLOCK_WORDS))
    for k in range(int(ends[-1] - 1) // BLOCK_WORDS + 1 if len(ends) else 1):
        rows = dealt.where(F.col("block") == k).select("item_id", "hashes").collect()
        yield [(r["item_id"], np.frombuffer(r["hashes"], "<u8")) for r in rows]


def _merged(runs: Column) -> Column:
    """Overlapping and touching runs as one."""
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def add(done: Column, run: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], run["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (run["begin"] <= last["end"]), joined).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(runs), none, add)


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """doc_id, n_words, runs (hit words as [begin, end)), items and near_items of each row of docs (doc_id, text).

    benchmark: item_id, text. runs and items are of exact occurrences; near_items have proximity matches only.
    """
    id_type = docs.schema["doc_id"].dataType
    kind, stored = row_type("doc_id array<long>, uid array<long>, n_words long, n_terms long, first binary, terms binary, counts binary, steps binary", doc_id=T.ArrayType(id_type))
    index = materialize(docs.select("doc_id", "text").transform(in_batches, lambda it: _segments(it, stored), kind))
    results = []
    for block in _blocks(benchmark, window):
        windows = Windows(block, window)
        vocabulary, frequency = windows.vocabulary, np.zeros(len(windows.vocabulary), np.int64)
        kind, counted = row_type("term int, n long")
        for r in index.transform(in_batches, lambda it, v=vocabulary, s=counted: _frequencies(it, v, s), kind).groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a row for each term of the block
            frequency[r["term"]] = r["n"]
        windows.order_by_rarity(frequency)
        kind, arrow = row_type("doc_id long, uid long, n_words long, runs array<struct<begin:bigint,end:bigint>>, items array<string>, near_items array<string>", doc_id=id_type)
        results.append(index.transform(in_batches, lambda it, w=windows, s=arrow: _search(it, w, slack, s), kind))
    if len(results) == 1:
        return results[0].drop("uid")
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    every = every.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), flat("runs"), flat("items"), flat("near_items"))
    items = F.array_distinct("items")
    return every.select("doc_id", "n_words", _merged(F.col("runs")).alias("runs"), items.alias("items"), F.array_except("near_items", items).alias("near_items"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of what `find` returns."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))
