"""The pipeline's stages on a small table with planted cases."""

import random
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from test_operators import plain_components, plain_shingles, plain_windows, plain_words

import corpus_pipeline
from millrace.llm import decontaminate, near_dedup, pii, toxicity
from millrace.session import read_table


def test_stages(spark, small, tmp_path):
    docs = read_table(spark, small, "documents")
    rng = random.Random(9)
    words = [f"word{i}" for i in range(300)]
    body = " ".join(rng.choice(words) for _ in range(80))
    item = read_table(spark, small, "benchmark").first()["text"]
    planted = [(5000, body, "a"), (5001, body, "a"), (5002, body + " extra", "b"), (5003, " ".join(rng.choice(words) for _ in range(60)) + " " + item, "c"), (5004, "Mail the.72@mail3.example.com " + " ".join(rng.choice(words) for _ in range(30)), "c"), (5005, None, None), (5006, "", "c"), (None, "no id", "c")]
    extra = spark.createDataFrame([(*p, 1) for p in planted], "doc_id long, text string, source string, score int")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    ids = {k: {r["doc_id"] for r in d.select("doc_id").collect()} for k, d in seen.items()}
    assert ids["near-dedup"] & {5000, 5001, 5002} == {5000} and {5003, 5004, 5005, 5006, None} <= ids["near-dedup"]
    assert 5003 not in ids["decontamination"] and {5004, 5005, 5006, None} <= ids["decontamination"]
    text = {r["doc_id"]: r for r in seen["pii"].collect()}
    assert "the.72@mail3" not in text[5004]["text"] and text[5004]["n_chars"] == len(text[5004]["text"]) and text[5005]["text"] is None
    assert {r["doc_id"] for r in seen["packing"].collect()} == ids["pii"] == ids["decontamination"]
    left = seen["near-dedup"]
    assert near_dedup.link(left).where("not kept and doc_id is not null").count() == 0
    assert decontaminate.digest(decontaminate.find(seen["decontamination"], read_table(spark, small, "benchmark"))).where("contaminated").count() == 0
    model = toxicity.fit(read_table(spark, small, "documents"), read_table(spark, small, "labels"))
    assert model.weights is not None


@pytest.mark.parametrize("of", ["sf0.001", "sf0.01"])
def test_run_equals_a_plain_pipeline(spark, of):
    from tokenizers import Tokenizer

    sf_dir = f"/root/testdata/{of}"
    docs = {r["doc_id"]: r["text"] or "" for r in read_table(spark, sf_dir, "documents").collect()}
    matcher = toxicity.Matcher(toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))
    docs = {d: t for d, t in docs.items() if matcher.scores([toxicity.fold(t)])[0] < 0.5}
    parent = plain_components({d: plain_shingles(t, 5) for d, t in docs.items()})
    docs = {d: t for d, t in docs.items() if parent[d] == d}
    windows = plain_windows([(r["item_id"], r["text"]) for r in read_table(spark, sf_dir, "benchmark").collect()])
    lengths = {len(w) for w in windows}
    clean = lambda words: not any(tuple(words[k : k + n]) in windows for n in lengths for k in range(len(words) - n + 1))
    docs = {d: t for d, t in docs.items() if clean(plain_words(t))}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    tokenizer, entity = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), re.compile("|".join((r"@", r"\d{16}", r"\d{3}[ )]*[ -]\d{3}-\d{4}", r"(?:\d+\.){3}\d", r"[0-9a-fA-F]{32}", "|".join(pii.TITLES.values()))))
    covered = Counter()
    for r in rows:
        covered[r["doc_id"]] += r["length"]
        if not entity.search(docs[r["doc_id"]]):  # texts without personal data are packed as they are
            ids = tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids + [1]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]]))
    assert all(covered[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_each_row_is_judged_by_its_own_text(spark, small):
    rng = random.Random(4)
    text = lambda: " ".join(f"term{rng.randrange(10**6)}" for _ in range(80))
    stage = dict(corpus_pipeline.STAGES)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(3)
    left = lambda name, rows: sorted(r["place"] for r in stage[name](spark, frame(rows), small).collect())
    a, b, c, d, e = (text() for _ in range(5))
    copies = [(None, a, 1), (None, a, 2), (None, a + " more", 3)]
    near = [(7, b, 4), (7, b + " more", 5), (8, b, 6)]
    shared = [(9, d, 7), (9, c, 8), (3, c, 9), (None, c, 10)]
    alone = [(None, e, 11), (None, None, 12), (None, "", 13), (None, " ", 14), (5, None, 15), (5, None, 16)]
    kept = left("near-dedup", copies + near + shared + alone + [(3, c, 9)])
    assert len([k for k in kept if k in (1, 2, 3)]) == 1 and len([k for k in kept if k in (4, 5, 6)]) == 1 and 6 not in kept
    assert [k for k in kept if k > 6] == [7, 9, 11, 12, 13, 14, 15, 16]
    item = read_table(spark, small, "benchmark").first()["text"]
    assert left("decontamination", [(None, f"{a} {item}", 1), (None, a, 2), (4, f"{b} {item}", 3), (4, c, 4), (None, None, 5), (None, "", 6)]) == [2, 4, 5, 6]


def test_empty_tables_and_odd_texts(spark, small, tmp_path, monkeypatch):
    docs = read_table(spark, small, "documents")
    odd = spark.createDataFrame([(None, None), (9001, None), (9002, ""), (9003, " \n"), (9004, "x " * 200_000), (9004, "x " * 200_000), (9005, "a" * 300_000)], "doc_id long, text string")
    for name, table in (("none", docs.limit(0)), ("odd", odd.selectExpr("doc_id", "text", "'en' as lang", "'src' as source", "1L as n_chars", "2 as key", "3 as file", "4 as row", "5 as _metadata"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for other in ("labels", "benchmark"):
            read_table(spark, small, other).write.parquet(f"{tmp_path}/{name}/{other}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    for most in (corpus_pipeline.MOST_BROADCAST, 0):
        monkeypatch.setattr(corpus_pipeline, "MOST_BROADCAST", most)
        rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
        assert Counter(r["doc_id"] for r in rows if not r["start"]) == Counter({None: 1, 9001: 1, 9002: 1, 9003: 1, 9004: 1, 9005: 1})
