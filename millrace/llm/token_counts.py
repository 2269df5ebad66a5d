"""Operator 2: token counts of sections, by offsets.

Each document is encoded once as a whole with a byte-level vocabulary, whose tokens cover the text's bytes in
order. Token spans and section spans are both sorted and tile the text, so an interval join by binary search
gives each token its first and last section. A token over a boundary is allocated by `rule`: "first" (the section
of its first character), "majority" (the one with most of its characters; of equals the first) or "share" (to
each section in proportion to its characters). Sections are the text's lines, each with its line feed.
One pass, no shuffle; the counts of a document's sections always add up to its tokens.

Defined results: null and empty texts have one empty section; repeated rows and doc_ids are counted once per
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._text import row_type, slices, utf8
from millrace.session import in_batches

RULES = ("first", "majority", "share")
_encoders: dict[str, tuple] = {}


def encoder(path: str, pattern: str) -> tuple:
    """The encoding of a file of base64 tokens and ranks, and each token's bytes."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[[*ranks.values()]] = [len(t) for t in ranks]
        _encoders[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _encoders[path]


def allocate(token_end: np.ndarray, begin: np.ndarray, chars: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by section, and those of them that also lie in another; chars: characters before each byte."""
    token_begin = np.concatenate([[0], token_end[:-1]])
    first = np.searchsorted(begin, token_begin, side="right") - 1
    last = np.searchsorted(begin, token_end - 1, side="right") - 1
    inside = first == last
    n = np.bincount(first[inside], minlength=len(begin)).astype(float)
    crossing = np.zeros(len(begin))
    for t in np.flatnonzero(~inside):
        own = np.arange(first[t], last[t] + 1)
        edges = chars[np.concatenate([[token_begin[t]], begin[own[1:]], [token_end[t]]])]
        part = np.diff(edges).astype(float)
        if rule == "share" and part.sum():
            n[own] += part / part.sum()
            crossing[own] += part > 0
        else:
            to = own[0] if rule == "first" or not part.sum() else own[np.argmax(part)]
            n[to] += 1
            crossing[to] += 1
    return n, crossing


def _count(batches: Iterator[pa.RecordBatch], path: str, pattern: str, rule: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encode, size = encoder(path, pattern)
    for batch in batches:
        at, data = utf8(batch.column("text"))
        for lo, hi in slices(at):
            raw, bound = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            tokens = [np.array(encode.encode_ordinary(raw[bound[i] : bound[i + 1]].tobytes().decode()), np.int64) for i in range(hi - lo)]
            token_end = np.cumsum(size[np.concatenate(tokens)]) if len(raw) else np.zeros(0, np.int64)
            lines = np.flatnonzero(raw == 10) + 1
            lines = lines[~np.isin(lines, bound)]
            begin = np.sort(np.concatenate([bound[:-1], lines]))  # empty documents keep a section of their own
            doc = np.sort(np.concatenate([np.arange(hi - lo), np.searchsorted(bound[:-1], lines, side="right") - 1]))
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            n, crossing = allocate(token_end, begin, chars, rule) if len(token_end) else (np.zeros(len(begin)), np.zeros(len(begin)))
            end = np.concatenate([begin[1:], [len(raw)]])
            start = np.searchsorted(doc, np.arange(hi - lo))
            base = chars[bound[doc]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi].take(pa.array(doc)), pa.array(np.arange(len(doc)) - start[doc], pa.int64()), pa.array(chars[begin] - base, pa.int64()), pa.array(chars[end] - base, pa.int64()), pa.array(n), pa.array(crossing.astype(np.int64))], schema=schema)


def attribute(docs: DataFrame, vocabulary: str, pattern: str, *, rule: str = "majority") -> DataFrame:
    """doc_id, section, begin, end (characters), n_tokens and n_crossing of each section of docs (doc_id, text)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind, arrow = row_type("doc_id long, section long, begin long, end long, n_tokens double, n_crossing long", doc_id=docs.schema["doc_id"].dataType)
    out = docs.select("doc_id", "text").transform(in_batches, lambda it: _count(it, vocabulary, pattern, rule, arrow), kind)
    return out if rule == "share" else out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
