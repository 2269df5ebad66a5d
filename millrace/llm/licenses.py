"""Operator 9: license scan by diagonal voting.

Every document gives the hashes of all its word pairs with their positions; templates give theirs. A Spark join
of the two on the hash yields votes, summed by diagonal (position in the document less position in the
template). A phrase stands where all its pairs vote for one diagonal. For longer templates neighbouring
diagonals are merged, which bridges inserted and left-out words, and the merged span is verified by its words:
it must hold `MIN_PAIRS` of the template's pairs, and the template's words that it holds, each counted once however often
it stands there, must be `MIN_WORDS` of the template's and of its own, so inserted words count against it; and of the words that tell the template from
those that it resembles, one at least. Of overlapping spans of different labels the best stays: the one with the
larger share of its template's pairs, then the longer, then the earlier template. A score is that share of words.

Templates are a parameter; those of up to `MOST_TEMPLATE_WORDS` words together are broadcast, beyond that they are
shuffled. One scan: a document also emits one header row, which passes the join by a key of its own, so that
documents without any vote return too. Votes are summed before the shuffle.

Defined results: null and empty texts have no words and no labels; texts of any length are scanned whole; equal
phrases count once for each place; repeated rows and doc_ids are scanned once per row; an empty table gives no rows;
other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._text import ALNUM, IS_ALNUM, Words, mix64, row_type, words_of
from millrace.session import in_batches

PAIR, MIN_PAIRS, MIN_WORDS, NEIGHBOURS, MOST_TEMPLATE_WORDS = 2, 0.6, 0.75, 3, 100_000

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Public license texts and notices, and their labels.
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
WARRANTY = "AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
MIT_WHOLE = f"""{MIT} (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED {WARRANTY}. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
GNU = "you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation"
APACHE = """Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"""
APACHE_WHOLE = f"""{APACHE}. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
APACHE_GRANT = """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to
reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"""
CREATIVE = {"cc-by": "Attribution", "cc-by-sa": "Attribution-ShareAlike", "cc-by-nd": "Attribution-NoDerivatives", "cc-by-nc": "Attribution-NonCommercial", "cc-by-nc-sa": "Attribution-NonCommercial-ShareAlike", "cc-by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
SPDX = {
    "mit": "MIT", "apache": "Apache-2.0", "isc": "ISC", "0bsd": "0BSD", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "gpl": "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later", "lgpl": "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later",
    "agpl": "AGPL-3.0-only AGPL-3.0-or-later", "mpl": "MPL-2.0", "epl": "EPL-1.0 EPL-2.0", "unlicense": "Unlicense", "cc0": "CC0-1.0", **{k: f"{k.upper()}-4.0" for k in CREATIVE},
}
TEMPLATES = (
    (MIT, "mit"), (MIT_WHOLE, "mit"), (APACHE, "apache"), (APACHE_WHOLE, "apache"), (APACHE_GRANT, "apache"),
    (f"{ISC}, provided that the above copyright notice and this permission notice appear in all copies.", "isc"), (f"{ISC}. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES", "0bsd"),
    (BSD, "bsd"), (f"{BSD}: 1. {BSD_TWO} {BSD_DISCLAIMER}", "bsd-2-clause"), (f"{BSD}: 1. {BSD_TWO} {BSD_THIRD} {BSD_DISCLAIMER}", "bsd-3-clause"),
    (GNU.format(""), "gpl"), (GNU.format("Lesser"), "lgpl"), (GNU.format("Library"), "lgpl"), (GNU.format("Affero"), "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License", "epl"),
    ("This is free and unencumbered software released into the public domain", "unlicense"), ("the person who associated a work with this deed has dedicated the work to the public domain", "cc0"),
    *((f"Licensed under {k.upper().replace('CC-', 'CC ')} 4.0", k) for k in CREATIVE),
    *((f"This work is licensed under a Creative Commons {name} 4.0 International License", k) for k, name in CREATIVE.items()),
    *((f"SPDX-License-Identifier: {name}", k) for k, names in SPDX.items() for name in names.split()),
)


def _pairs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A header (its place is the number of words, its hash one of its own) and all pairs of each document."""
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for lo, hi, words in words_of(batch.column("text"), IS_ALNUM, ALNUM):
            docs = hi - lo
            hashes, at = words.grams(PAIR)
            owner = np.searchsorted(words.first, at, side="right") - 1
            n = pa.array(np.concatenate([words.counts(), at - words.first[owner]]), pa.int64())
            key = pa.array(np.concatenate([mix64(np.arange(uid, uid + docs, dtype=np.uint64)), hashes]).view(np.int64), pa.int64())
            ids = pa.concat_arrays([batch.column("doc_id")[lo:hi], pa.nulls(len(at), batch.column("doc_id").type)])
            header = pa.array(np.arange(docs + len(at)) < docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(docs), owner]) + uid, pa.int64()), ids, header, n, key], schema=schema)
            uid += docs


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def telling(templates) -> list[set[str]]:
    """For each template the words that no template of another label has which holds half of its pairs."""
    words = [template_words(text) for text, _ in templates]
    pairs = [set(itertools.pairwise(w)) for w in words]
    alike = lambda k, j: templates[j][1] != templates[k][1] and 2 * len(pairs[k] & pairs[j]) >= len(pairs[k])
    found = []
    for k in range(len(templates)):
        near = [set(words[j]) for j in range(len(templates)) if alike(k, j)]
        found.append(set(words[k]).difference(*near) if near else set())
    return found


def _template_rows(phrases, templates) -> list[tuple]:
    """(template, its label, whether a phrase, its pairs, whether some of its words tell it, pair's place, whether one is in the pair, hash)."""
    rows: list[tuple] = []
    for k, ((text, label), tells) in enumerate(zip([*phrases, *templates], [set()] * len(phrases) + telling(templates), strict=True)):
        raw, words = np.frombuffer(text.encode(), np.uint8), template_words(text)
        hashes, at = Words(raw, np.array([0, len(raw)]), IS_ALNUM, ALNUM).grams(PAIR)
        if not len(at):
            raise ValueError(f"a template needs {PAIR} words at least: {text!r}")
        rows += [(k, label, k < len(phrases), len(at), bool(tells), int(p), bool(tells & set(words[p : p + PAIR])), int(h)) for p, h in zip(at, hashes.view(np.int64), strict=True)]
    return rows


def scan(docs: DataFrame, *, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each row of docs (doc_id, text).

    phrases: the base, (words, label); templates: the method's own, (text, label).
    """
    rows = _template_rows(phrases, templates)
    known = docs.sparkSession.createDataFrame(rows, "template int, label string, base boolean, pairs int, needs boolean, place long, tells boolean, hash long").withColumn("header", F.lit(False))
    if len(rows) <= MOST_TEMPLATE_WORDS:
        known = F.broadcast(known)
    kind, arrow = row_type("uid long, doc_id long, header boolean, at long, hash long", doc_id=docs.schema["doc_id"].dataType)
    pairs = docs.select("doc_id", "text").transform(in_batches, lambda it: _pairs(it, arrow), kind)

    by = ["uid", "header", "template", "label", "base", "pairs", "needs"]
    votes = pairs.join(known, ["hash", "header"], "left").where("header or template is not null").withColumn("diagonal", F.col("at") - F.col("place"))
    summed = votes.groupBy(*by, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("begin"), F.max("at").alias("end"), F.collect_set("place").alias("places"), F.bool_or("tells").alias("tells"), F.first("doc_id", ignorenulls=True).alias("doc_id"))
    summed = summed.where("header or base and votes = pairs or not base and votes >= least(2, pairs)")

    row = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = (F.col("header") | F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(row) > NEIGHBOURS, F.lit(True))).cast("int")
    spans = summed.withColumn("apart", apart).withColumn("span", F.sum("apart").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*by, "span").agg(F.min("begin").alias("begin"), (F.max("end") + PAIR).alias("end"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.bool_or("tells").alias("tells"), F.first("doc_id", ignorenulls=True).alias("doc_id"))
    held = F.size(F.array_union("places", F.transform("places", lambda p: p + 1)))
    spans = spans.withColumn("share", F.when(F.col("base"), 1.0).otherwise(held / F.greatest(F.col("pairs") + 1, F.col("end") - F.col("begin"))))
    verified = (F.size("places") >= MIN_PAIRS * F.col("pairs")) & (F.col("share") >= MIN_WORDS) & (F.col("tells") | ~F.col("needs"))

    header, base = F.col("header"), F.col("base") & ~F.col("header")
    place = F.when(base, F.col("begin"))
    span = F.struct("begin", "end", "label", "share", (F.size("places") / F.col("pairs")).alias("close"), "pairs", "template")
    found = spans.groupBy("uid").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max(F.when(header, F.col("begin"))).alias("n_words"),
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.array_sort(F.collect_list(F.when(base, span))).alias("base_spans"), F.array_sort(F.collect_list(F.when(~header & ~F.col("base") & verified, span))).alias("own"),
    )
    rank = lambda x: F.struct(x["close"], x["pairs"], -x["template"])
    beaten = lambda x: F.exists("own", lambda y: (y["label"] != x["label"]) & (y["begin"] < x["end"]) & (x["begin"] < y["end"]) & (rank(y) > rank(x)))
    found = found.withColumn("spans", F.array_sort(F.concat("base_spans", F.filter("own", lambda x: ~beaten(x)))))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0))
    out = F.transform("spans", lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["label"].alias("label")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", labels("base_spans").alias("base_labels"), labels("spans").alias("labels"), score.alias("score"), out.alias("spans"))
