"""The corpus pipeline: quality filter, near-dedup, passage dedup, masking of personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; it is written and read again as the next one's
``docs``. All but the last return the columns of ``documents``. Repeated rows of one ``doc_id`` stay together;
empty and null texts are judged by the quality classifier like any other and pass the later stages unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import minhash, packing, pii, quality, suffix
from tidemark.llm.common import table, written

#: Least quality score of a document that stays.
LEAST_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.remainder(5) == 0)
    return quality.kept(docs, model, LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.distinct_documents(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return suffix.without_repeats(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their place in training sequences."""
    path = public_tokenizers.path
    cut = packing.pieces(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(cut)


STAGES = [
    ("quality classifier", quality_filter),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: A classifier fitted by boosting and a tokenizer's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
