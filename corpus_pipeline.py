"""The corpus pipeline: toxic and poor documents go, one of each group of near copies stays, recurring passages are cut, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows as Parquet in the
shared folder and reads them again as the next one's docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_name, scratch, stage_table, table
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import learn_quality, reject_poor
from tidemark.llm.simhash import similar_documents
from tidemark.llm.substrings import remove_recurring
from tidemark.llm.toxicity import learn, reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon finds toxic go."""
    return reject_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds poor go."""
    return reject_poor(docs, learn_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays: that with the smallest id (rows without one last), of equal ids the one with the least text hash.

    Rows are judged by their texts: rows with one id and different texts are different documents. All texts without words are one class.
    """
    found = similar_documents(docs)
    gone = found.where("not first").select("id", "text_hash").distinct()
    often = found.where("first").groupBy("id", "text_hash").count().where("count > 1").select("id", "text_hash")
    own = fresh_name(docs.columns, "_text_hash")
    hashed = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    names = [fresh_name(docs.columns, x) for x in ("id_", "text_hash_")]
    gone, often = (x.toDF(*names) for x in (gone, often))
    same = hashed["doc_id"].eqNullSafe(F.col(names[0])) & (hashed[own] == F.col(names[1]))
    once = hashed.join(gone, same, "left_anti").join(often, same, "left_anti")
    return once.union(hashed.join(often, same, "left_semi").dropDuplicates(["doc_id", own])).drop(own)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that recur are cut; n_chars follows; a text that loses nothing stays as it is."""
    cut = remove_recurring(docs).where("n_removed > 0").select("id", "text_hash", "kept").dropDuplicates(["id", "text_hash"])
    same = docs["doc_id"].eqNullSafe(cut["id"]) & (F.xxhash64(docs["text"]) == cut["text_hash"])
    changed, length = cut["text_hash"].isNotNull(), F.char_length(cut["kept"]).cast("long")
    new = {"text": F.when(changed, cut["kept"]).otherwise(docs["text"]), "n_chars": F.when(changed, length).otherwise(docs["n_chars"])}
    return docs.join(cut, same, "left").select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies, in tokens: bin, offset and the bin's capacity."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack_documents(docs, path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id").drop("text_hash")


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Learned classifiers and near-duplicate classes have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            with scratch(spark):
                docs = stage_table(stage(spark, docs, sf_dir), name, keep=True)
        name, stage = STAGES[-1]
        return stage_table(stage(spark, docs, sf_dir), name, keep=True)
