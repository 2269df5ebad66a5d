"""Operator 7: toxicity by a weighted lexicon.

Texts are folded (compatibility forms, case, look-alike letters, digits for letters), reduced to words, and
searched once with an Aho-Corasick automaton of lexicon words and exception phrases; a word inside an
exception phrase does not count. The weights of the words found, also as a rate by the text's length, go
through a logistic function.

The lexicon is learned; none is built in. On one part of a bounded sample of labelled documents (at most
`MOST_LABELLED`, taken by a hash of the id) each word gets the smoothed log-odds of toxic against other documents that
hold it, and all words with enough support and significance stay. Exception phrases are learned too: two words that
hold one of the lexicon and stand in as many other documents as toxic ones, by rate. The logistic function is fitted on
the rest of the sample. A labelled id gives one text, however many rows share it, so that the sample, which is stored once,
has at most as many rows as labels. Scoring covers all rows and needs no shuffle.

Defined results: null and empty texts are scored like a text without lexicon words; texts of any length are scored
whole; labels that are null are not learned from, of two labels of a document the toxic one counts; without usable
labels there is no lexicon and all texts have one score below 0.5; a null doc_id is scored, and its `held_out` is null; repeated rows are scored once per row; an empty
table gives no rows; other columns, of whatever name, are ignored, and `lang`, `source` and the id are never inputs of
a score.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm._text import row_type, slices, utf8
from millrace.session import in_batches, materialize

MOST_LABELLED, MIN_SUPPORT, MIN_LOG_ODDS, MIN_G2 = 20_000, 3, 1.0, 10.0

#: Look-alike letters of other scripts, and digits that stand for letters.
FOLD = dict(zip("аеорсухіѕјԁһӏԛԝвкмнтοαειντυχκρ", "aeopcyxisjdhlqwbkmhtoaeivtuxkp", strict=True)) | dict(zip("0134578", "oieastb", strict=True)) | {"ı": "i", "ł": "l", "ø": "o"}
_fold = {ord(k): v for k, v in FOLD.items()}
_inside = re.compile(r"(?<=\w)[@$](?=\w)")
_gaps = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """The words of a text, folded, with single spaces between and around them."""
    text = unicodedata.normalize("NFKC", text).lower()
    if "@" in text or "$" in text:
        text = _inside.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return " " + _gaps.sub(" ", text.translate(_fold)).strip() + " "


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    #: Of: 1, the weights' sum, the largest weight, the weights' sum by 100 words, the number of different words.
    logistic: tuple[float, ...] = (-3.0, 0.4, 0.4, 0.1, 0.2)
    exceptions: tuple[str, ...] = ()


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.automaton = model, ahocorasick.Automaton()
        for w, x in model.weights.items():
            self.automaton.add_word(f" {w} ", (w, x, len(w) + 2))
        for e in map(fold, model.exceptions):
            self.automaton.add_word(e, ("", 0.0, len(e)))
        self.automaton.make_automaton()

    def features(self, folded: str) -> tuple[float, float, float, int]:
        hits, shields = [], []
        for end, (w, x, n) in self.automaton.iter(folded) if len(self.automaton) else ():
            (hits if w else shields).append((end + 1 - n, end, w, x))
        if shields:  # for each start the farthest end of the shields that begin up to it
            shields.sort()
            begins, ends = [s[0] for s in shields], list(accumulate((s[1] for s in shields), max))
            hits = [h for h in hits if not (k := bisect_right(begins, h[0])) or ends[k - 1] < h[1]]
        if not hits:
            return 0.0, 0.0, 0.0, 0
        distinct = {w: x for _, _, w, x in hits}
        return sum(distinct.values()), max(distinct.values()), 100 * sum(h[3] for h in hits) / max(folded.count(" ") - 1, 1), len(distinct)

    def design(self, folded: list[str]) -> np.ndarray:
        x = np.array([self.features(f) for f in folded], float).reshape(-1, 4)
        return np.column_stack([np.ones(len(x)), np.minimum(x[:, 0], 50), x[:, 1], np.minimum(x[:, 2], 50), np.minimum(x[:, 3], 20)])

    def scores(self, folded: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(folded) @ np.array(self.model.logistic), -30, 30)))


def _terms(folded: str, around: dict[str, float] | None) -> set[str]:
    """The different words of a text, or the pairs of words that hold one of `around`."""
    words = folded.split()
    return set(words) if around is None else {f"{a} {b}" for a, b in pairwise(words) if a in around or b in around}


def _document_frequencies(batches: Iterator[pa.RecordBatch], schema: pa.Schema, around: dict[str, float] | None = None) -> Iterator[pa.RecordBatch]:
    """Terms with the documents of either label that hold them, summed over a slice."""
    for batch in batches:
        at, data = utf8(batch.column("text"))
        toxic = batch.column("toxic").to_pylist()
        for lo, hi in slices(at, 4 << 20):
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for i in range(lo, hi):
                n[toxic[i]].update(_terms(fold(data[at[i] : at[i + 1]].tobytes().decode()), around))
            words = sorted(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, schema.field(0).type), pa.array([n[1][w] for w in words], pa.int64()), pa.array([n[0][w] for w in words], pa.int64())], schema=schema)


def _design(batches: Iterator[pa.RecordBatch], model: Model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(model)
    for batch in batches:
        at, data = utf8(batch.column("text"))
        for lo, hi in slices(at):
            x = matcher.design([fold(data[at[i] : at[i + 1]].tobytes().decode()) for i in range(lo, hi)])
            yield pa.RecordBatch.from_arrays([batch.column("toxic")[lo:hi], *(pa.array(x[:, j]) for j in range(5))], schema=schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the intercept is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MOST_LABELLED) -> Model:
    """A model from labels (doc_id, toxic 0/1) that are not held out."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    labels = labels.where(~F.coalesce(held_out("doc_id"), F.lit(True))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # Of rows with one id the text of the least hash: as many rows as labels at most, found before the shuffle.
    sample = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    sample = materialize(sample.select("doc_id", "toxic", F.col("least.text").alias("text")))
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) < 7

    kind, arrow = row_type("word string, toxic long, other long")
    sizes = {r["toxic"]: r["count"] for r in sample.where(part).groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model()
    counted = sample.where(part).select("text", "toxic").transform(in_batches, lambda it: _document_frequencies(it, arrow), kind).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.1) / (n1 - a + 0.1)) - F.log((b + 0.1 * n0 / n1) / (n0 - b + 0.1))
    term = lambda seen, total, of: F.when(seen > 0, seen * F.log(seen * (n1 + n0) / (total * of))).otherwise(0)
    both = a + b
    g2 = 2 * reduce(lambda x, y: x + y, [term(a, both, n1), term(b, both, n0), term(n1 - a, n1 + n0 - both, n1), term(n0 - b, n1 + n0 - both, n0)])
    kept = counted.where((a >= MIN_SUPPORT) & (odds >= MIN_LOG_ODDS) & (g2 >= MIN_G2)).select("word", odds.alias("weight"), g2.alias("g2"))
    rows = kept.orderBy("word").collect()  # words of at most `most` documents
    model = Model({r["word"]: float(min(r["weight"], 8.0)) for r in rows})

    kind, arrow = row_type("phrase string, toxic long, other long")
    weights = model.weights
    phrases = sample.where(part).select("text", "toxic").transform(in_batches, lambda it: _document_frequencies(it, arrow, weights), kind).groupBy("phrase").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    harmless = phrases.where((b >= MIN_SUPPORT) & (odds <= 0)).orderBy("phrase").collect()
    model.exceptions = tuple(r["phrase"] for r in harmless)

    kind, arrow = row_type("toxic int, f0 double, f1 double, f2 double, f3 double, f4 double")
    seen = sample.where(~part).select("text", "toxic").transform(in_batches, lambda it: _design(it, model, arrow), kind).collect()  # at most `most` rows of six numbers
    if len({r[0] for r in seen}) == 2:
        x = np.array(seen, float)
        x = x[np.lexsort(x.T)]
        w = fit_logistic(x[:, 1:], x[:, 0])
        model.logistic = tuple(map(float, w))
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(model)
    for batch in batches:
        at, data = utf8(batch.column("text"))
        for lo, hi in slices(at):
            scores = matcher.scores([fold(data[at[i] : at[i + 1]].tobytes().decode()) for i in range(lo, hi)])
            yield pa.RecordBatch.from_arrays([pa.array(scores), *(batch.column(c)[lo:hi] for c in batch.schema.names)], schema=schema)


def score(docs: DataFrame, model: Model, *, into: str = "score") -> DataFrame:
    """`docs` with a first column `into`; a column of that name in `docs` gives way."""
    docs = docs.drop(into)
    kind = T.StructType([T.StructField(into, T.DoubleType()), *docs.schema.fields])
    arrow = to_arrow_schema(kind)
    return docs.transform(in_batches, lambda it: _score(it, model, arrow), kind)
