"""Corpus preparation in stages, each on all rows that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm.minhash import near_duplicates
from promptloom.llm.packing import pack_documents
from promptloom.llm.quality import quality
from promptloom.llm.toxicity import toxicity
from promptloom.session import materialise

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit, in all their columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = _fresh("score", docs.columns)
    return toxicity(docs, labels, out=score).where(F.col(score) < TOXIC).drop(score)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on their text and whose host passes."""
    return quality(docs).where("kept").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows without an id stay. Of rows that repeat an id and text one stays; texts that
    share an id without being near duplicates all stay, and of those that are the one
    with the smallest digest.
    """
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        # the joins rename nothing, so columns of any name pass
        return docs.join(_away(docs, "doc_id"), "doc_id", "left_anti").select(*docs.columns)
    digest, key = (_fresh(name, docs.columns) for name in ("digest", "key"))
    told = docs.withColumn(digest, F.xxhash64("text"))
    # numbers in the order of id and digest stand for the two
    keys = (
        told.where("doc_id IS NOT NULL")
        .select("doc_id", digest)
        .distinct()
        .repartitionByRange("doc_id", digest)
        .sortWithinPartitions("doc_id", digest)
        .withColumn(key, F.monotonically_increasing_id())
    )
    told = told.join(materialise(keys, "keys"), ["doc_id", digest], "left")
    told = materialise(told.select(*docs.columns, key), "keyed")
    left = told.join(_away(told, key).withColumnRenamed("doc_id", key), key, "left_anti")
    named = left.where(F.col(key).isNotNull()).dropDuplicates([key])
    return named.unionByName(left.where(F.col(key).isNull())).select(*docs.columns)


def _away(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id``: the keys of documents that have a near duplicate of a smaller key."""
    judged = near_duplicates(docs, doc_id=key).where("doc_id IS NOT NULL AND NOT kept")
    return materialise(judged.select("doc_id").distinct(), "away")


def _fresh(name: str, taken: list[str]) -> str:
    while name in {c.lower() for c in taken}:
        name += "_"
    return name


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

# learned scores, similarity and tokens have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
