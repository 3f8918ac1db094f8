"""A corpus pipeline of five of the training-text operators; part of ``newsdesk.llm``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps.  ``run`` writes
each stage's rows to the shared folder, hands on the table that it reads back, and
deletes the one before.

What stages do with odd rows: null and empty texts are not toxic, near nothing, hold
no passage and no benchmark window, and encode to no ids.  Rows without doc_id stay
in every stage, and take no part where documents are compared by it; rows that share
one are judged by their own texts.  An empty table gives an empty table.  All stages
but the last keep the columns of docs, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsdesk.llm import decontaminate, near_dedup, sentencepiece_codec, substring_dedup, toxicity
from newsdesk.llm.common import release, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels of documents that are still there."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return near_dedup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller doc_id has as well go; so do documents left without words."""
    return substring_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.reject(docs, table(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256 and decoded_sha256."""
    return sentencepiece_codec.digests(docs, public_tokenizers.path(sentencepiece_codec.MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_and_decode),
]

#: The toxicity model cannot be put in SQL; tests hold run() against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return docs
