"""Corpus pipeline: toxicity, language ID, near-duplicates, mixture and tokens, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame over all that its predecessor kept;
``run`` writes each result as Parquet to the shared folder and reads it back as the next one's input.
All stages but the last return the columns of ``documents``, whatever other columns there are.  Every
stage takes null ids, texts, languages and sources, empty and very long texts, repeated rows and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, langid, mixing, neardup, toxicity
from evidentia.llm.common import cut, scope, session, unused

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go; it learns from ``labels`` of the documents it is given."""
    labels = session(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and documents unlike anything in the languages that are learnt, go."""
    session(spark)
    return langid.keep_known(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays; of equal rows one, of rows without an id all that differ."""
    session(spark)
    same = unused("_same", docs.columns)
    id_ = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias(same)  # a null id is an id like others here
    kept = neardup.near_duplicates(docs).where("kept").select(id_).distinct()
    return docs.select("*", id_).join(kept, same, "left_semi").dropDuplicates([same, "text"]).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    session(spark)
    return mixing.take(docs, name="pipeline-mix")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document of the mix: the token ids, and digests of them and of what they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL has no trained classifiers or BPE; the tests of the training-data operators hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage writes on its way is removed when its result is written."""
    docs = session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope(spark):
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
