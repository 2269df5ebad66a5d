"""Operator 1: mixture-controlled packing.

Deficit round-robin over source queues. In every round (one window of `window` tokens) each queue may
spend its share of the window; the fraction of a token that a round cannot spend is the queue's deficit
and is carried into the next round. With free cuts this has a closed form: after j rounds the queues up
to k have spent floor(min(j * window, N) * S_k / N) tokens, S_k being the tokens in queues 0..k and N
the total. A document's pieces therefore follow from its position in its queue alone: no task sees a whole
queue, and the deficits are carried over windows and partitions exactly.

With explicit `targets` a queue may run dry before others. The stream is then a list of phases, each
ending when a queue is exhausted; within a phase the queues that are left share windows by their targets.

Defined results: null text is the empty text, which still has its end token; null sources share the queue
of source ""; an empty table gives no rows; repeated rows and repeated doc_ids are packed once per row;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._text import IS_SPACED, SPACED, Words, row_type, words_of
from millrace.session import in_batches, materialize

WINDOW = 2048
#: Rows of (partition, source) offsets up to which they are broadcast, 40 MB at most.
MOST_BROADCAST = 1_000_000
#: Words a worker remembers with their ids; what it has not seen lately is encoded again.
CACHED_WORDS = 800_000


class WordEncoder:
    """Encodes texts word by word through one of the `tokenizers` files.

    Exact for tokenizers that lower-case, drop white space and never make a token over it: a text's ids are
    then its words' ids in order. Words that were seen lately are looked up by their hashes; new ones are
    encoded many at a time, kept apart by the word "0" (words that hold a 0 are encoded alone).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        (self.apart,) = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.known, self.begin, self.size, self.used, self.clock = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.ids = np.zeros(0, self.kind)

    def _encoded(self, words: list[bytes]) -> list[np.ndarray]:
        texts = [w.decode() for w in words]
        alone = [i for i, t in enumerate(texts) if "0" in t]
        some = [i for i, t in enumerate(texts) if "0" not in t]
        out: list = [None] * len(words)
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.kind)
        for lo in range(0, len(some), 1000):
            part = some[lo : lo + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" 0 ".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(ids == self.apart)
            if len(cut) != len(part) - 1:
                raise ValueError("this tokenizer does not keep words apart")
            for i, a, b in zip(part, [0, *(cut + 1)], [*cut, len(ids)], strict=True):
                out[i] = ids[a:b]
        return out

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        new = self._encoded(words)
        if len(self.known) + len(new) > CACHED_WORDS:  # what the last slices have not used goes
            keep = np.flatnonzero(self.used >= self.clock - 4)
            size = self.size[keep]
            self.ids = self.ids[np.arange(size.sum()) + np.repeat(self.begin[keep] - (np.cumsum(size) - size), size)]
            self.known, self.used, self.size, self.begin = self.known[keep], self.used[keep], size, np.cumsum(size) - size
        size = np.array([len(x) for x in new], np.int64)
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *new])
        at = np.searchsorted(self.known, hashes)  # both are sorted
        self.known, self.begin, self.size = np.insert(self.known, at, hashes), np.insert(self.begin, at, begin), np.insert(self.size, at, size)
        self.used = np.insert(self.used, at, self.clock)

    def __call__(self, words: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's documents in a row, each document's followed by `end`, and how many each has."""
        self.clock += 1
        distinct, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        new = np.arange(len(distinct))
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            new = np.flatnonzero(self.known[at] != distinct)
            self.used[at] = self.clock
        if len(new):
            self._learn(distinct[new], [words.data[words.start[i] : words.end[i]].tobytes() for i in first[new]])
        at = np.searchsorted(self.known, distinct)
        size = self.size[at][back]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[at][back] - (ends - size), size)]
        upto = np.concatenate([[0], ends])[words.first[1:]]
        return np.insert(ids, upto, end), np.diff(np.concatenate([[0], upto])) + 1


#: A worker's encoders; their words serve the next task too.
_encoders: dict[str, WordEncoder] = {}


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    encoder, part, spent = _encoders[path], TaskContext.get().partitionId(), {}
    for batch in batches:
        for lo, hi, words in words_of(batch.column("text"), IS_SPACED, SPACED):
            ids, n = encoder(words, end)
            before = []
            for s, k in zip(batch.column("source")[lo:hi].to_pylist(), n.tolist(), strict=True):
                before.append(spent.get(s, 0))
                spent[s] = before[-1] + k
            offsets = np.concatenate([[0], np.cumsum(n) * encoder.kind.itemsize]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.RecordBatch.from_arrays([pa.array([part] * (hi - lo), pa.int32()), batch.column("source")[lo:hi], batch.column("doc_id")[lo:hi], pa.array(before, pa.int64()), pa.array(n, pa.int64()), packed], schema=schema)


class Phase:
    """A stretch of the stream over which the same queues share every window by the same targets."""

    def __init__(self, base: int, takes: list[tuple[int, int, int]], window: int):
        """takes: (queue, first, end) of the tokens that each queue spends here."""
        self.base, self.window, self.total = base, window, sum(e - b for _, b, e in takes)
        self.queues: dict[int, tuple[int, int, int, int, int]] = {}
        low = 0
        group: list[tuple[int, int, int]] = []
        for i, take in enumerate(takes):
            group.append(take)
            size = sum(e - b for _, b, e in group)
            rest = sum(e - b for _, b, e in takes[i + 1 :])
            # Below a token in a window a queue's rounded quota could fall; such queues share one quota.
            if size * window >= self.total and (rest == 0 or rest * window >= self.total) or i == len(takes) - 1:
                shift = 0
                for q, b, e in group:
                    self.queues[q] = (b, e, low, low + size, shift)
                    shift += e - b
                low, group = low + size, []

    def pieces(self, queue: int, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(place in the queue, length, place in the stream) of what of [a, b) lies in this phase."""
        if queue not in self.queues:
            return
        first, end, low, high, shift = self.queues[queue]
        a, b = max(a, first), min(b, end)
        if a >= b:
            return
        total, window = self.total, self.window
        x, y, back = a - first + shift, b - first + shift, first - shift
        j = x * total // ((high - low) * window)

        def spent(j: int) -> tuple[int, int]:
            done = min(j * window, total)
            below = done * low // total
            return below, done * high // total - below

        below, c = spent(j)
        while c > x:
            j -= 1
            below, c = spent(j)
        above, d = spent(j + 1)
        while d <= x:
            j, below, c = j + 1, above, d
            above, d = spent(j + 1)
        while x < y:
            stop = min(y, d)
            if stop > x:
                yield x + back, stop - x, self.base + j * window + above - below + x - c
            x, j, below, c = stop, j + 1, above, d
            above, d = spent(j + 1)


def plan_phases(sizes: list[int], targets: list[float] | None, window: int) -> list[Phase]:
    """Phases for queues of these sizes. Without targets the mixture is the corpus's own: one phase."""
    if targets is None:
        return [Phase(0, [(q, 0, n) for q, n in enumerate(sizes)], window)] if sum(sizes) else []
    done, phases, base = [0] * len(sizes), [], 0
    shares = [round(t * (1 << 20)) for t in targets]
    while left := [q for q, n in enumerate(sizes) if n > done[q]]:
        active = [q for q in left if shares[q] > 0] or left
        share = {q: shares[q] or 1 for q in active}
        m = min(active, key=lambda q: (sizes[q] - done[q]) / share[q])
        takes = [(q, done[q], sizes[q] if q == m else min(sizes[q], done[q] + (sizes[m] - done[m]) * share[q] // share[m])) for q in active]
        phases.append(Phase(base, [t for t in takes if t[2] > t[1]], window))
        base += phases[-1].total
        for q, _, e in takes:
            done[q] = e
    return phases


def _cut(batches: Iterator[pa.RecordBatch], phases: list[Phase], window: int, wide: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        queue, begin, size, ids = (batch.column(c) for c in ("queue", "begin", "n", "ids"))
        rows, out = [], [[] for _ in range(6)]

        def ready(rows=rows, out=out, batch=batch):
            made = pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), batch.column("source").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in out)], schema=schema)
            for x in (rows, *out):
                x.clear()
            return made

        for i, (q, a, n) in enumerate(zip(queue.to_pylist(), begin.to_pylist(), size.to_pylist(), strict=True)):
            own = memoryview(np.frombuffer(ids[i].as_buffer(), "<u2" if wide == 2 else "<u4").astype("<u4").tobytes())
            for phase in phases:
                for at, length, stream in phase.pieces(q, a, a + n):
                    while length:  # phases need not begin with a window
                        part = min(length, window - stream % window)
                        start = at - a
                        rows.append(i)
                        for x, v in zip(out, (start, part, zlib.crc32(own[4 * start : 4 * (start + part)]), n, stream // window, stream % window), strict=True):
                            x.append(v)
                        at, stream, length = at + part, stream + part, length - part
            if len(rows) > 50_000:
                yield ready()
        yield ready()


def pack(docs: DataFrame, tokenizer: str, *, end_token: int = 1, window: int = WINDOW, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of documents in windows: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text, source. tokenizer: path of a `tokenizers` file. targets: token shares by source
    (sources not named get what is left once the named are spent); default: the corpus's own mixture.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    kind, arrow = row_type("pid int, source string, doc_id long, before long, n long, ids binary", doc_id=id_type)
    texts = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    tokens = materialize(texts.transform(in_batches, lambda it: _encode(it, tokenizer, end_token, arrow), kind))

    sums = tokens.groupBy("pid", "source").agg(F.sum("n").alias("tokens"))
    by_source = sums.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    if targets is None:
        # Sources of a token in a window or more: at most `window` of them. All others share one queue.
        own = sorted((r["source"], r["tokens"]) for r in by_source.where(F.col("tokens") * window >= total).collect())
    else:
        own = sorted((r["source"], r["tokens"]) for r in by_source.where(F.col("source").isin([*targets])).collect())
    rest = total - sum(n for _, n in own)
    phases = plan_phases([n for _, n in own] + [rest], targets and [targets[s] for s, _ in own] + [0.0], window)

    names = spark.createDataFrame([(s, q) for q, (s, _) in enumerate(own)], "source string, queue int")
    sums = sums.join(F.broadcast(names), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(own))))  # names: at most `window` rows, or the caller's targets
    within = Window.partitionBy("queue", "pid").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("queue", "pid").agg(F.sum("tokens").alias("tokens")).select("queue", "pid", F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("part_at"))
    at = sums.withColumn("source_at", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(parts, ["queue", "pid"]).select("pid", "source", "queue", (F.col("part_at") + F.col("source_at")).alias("queue_at"))

    at = materialize(at)
    if at.count() <= MOST_BROADCAST:  # else both sides are shuffled
        at = F.broadcast(at)
    placed = tokens.join(at, ["pid", "source"]).select("doc_id", "source", "queue", (F.col("queue_at") + F.col("before")).alias("begin"), "n", "ids")
    result, cut_arrow = row_type("doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", doc_id=id_type)
    wide = WordEncoder(tokenizer).kind.itemsize
    return placed.transform(in_batches, lambda it: _cut(it, phases, window, wide, cut_arrow), result)
