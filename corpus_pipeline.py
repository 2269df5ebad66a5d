"""The training-corpus pipeline over `documents`: what it keeps is packed into windows.

Each stage gets what its predecessor kept, with all columns of documents. Toxic documents go; of each group of
near-duplicates (shingles of five words, the library's default; `op5_near_duplicates` has four by its contract) the
one with the smallest id stays; documents that hold a passage of the benchmark go; personal data are replaced by
surrogates, and `n_chars` follows the text; the rest is packed.

Every row is judged by its own text, whether or not it has an id or shares one: rows go by where they lie in their
file. Which rows go is told by their keys alone; up to `MOST_BROADCAST` of them are broadcast, so that texts are not
shuffled to drop some, and beyond that they are.

Defined results: of a group of near-duplicates exactly one row stays, one without an id only if no other has one;
null and empty texts, and texts without words, are near-duplicates of nothing, hold no passage and pass all stages;
texts of any length are judged whole; repeated rows are near-duplicates; an empty table gives no pieces; columns of
whatever name are kept to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, near_dedup, packing, pii, toxicity
from millrace.llm.queries import pii_key
from millrace.session import materialize, read_table, remove, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, score = toxicity.fit(docs, read_table(spark, sf_dir, "labels")), f"score_{uuid.uuid4().hex}"
    return toxicity.score(docs, model, into=score).where(F.col(score) < 0.5).select(*(f"`{c}`" for c in docs.columns))


#: Keys of rows to drop that are sent to all tasks, of some 50 bytes each.
MOST_BROADCAST = 500_000


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key by id (none last) and place, and the key's name; it is the same whenever a row is read again.

    The place is a row's number in its file. Rows that come from no file are stored with a number first.
    """
    own, kind = F.col("doc_id"), docs.schema["doc_id"].dataType
    none = F.lit("").cast(kind) if kind.typeName() == "string" else F.lit(0).cast(kind)
    key = f"key_{uuid.uuid4().hex}"
    made = lambda file, row: F.struct(own.isNull().alias("none"), F.coalesce(own, none).alias("id"), file.alias("file"), row.alias("row"))
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select("*", made(F.xxhash64(place["file_path"]), place["row_index"]).alias(key)), key
    except AnalysisException:
        return materialize(docs.select("*", made(F.lit(0).cast("long"), F.monotonically_increasing_id()).alias(key))), key


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """rows but those whose key is in `gone` (doc_id), without the key."""
    gone = materialize(gone.select(F.col("doc_id").alias(key)))
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").drop(key)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    return without(rows, key, near_dedup.link(rows.select(F.col(key).alias("doc_id"), "text")).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    found = decontaminate.find(rows.select(F.col(key).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"), slack=0)
    return without(rows, key, decontaminate.digest(found).where("contaminated"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.replace(docs, key=pii_key(spark), into=f"found_{uuid.uuid4().hex}").select(*(f"`{c}`" for c in docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", replace_pii), ("packing", pack)]

#: Lexicon, hash confirmation order, surrogates and windows are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, place = read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            remove(spark, f"{place}/{k - 1}")
    packed = STAGES[-1][1](spark, docs, sf_dir)  # has stored its tokens, and reads no documents again
    remove(spark, place)
    return packed
