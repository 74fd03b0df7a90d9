"""From raw documents to packed sequences, in five stages over the operators of ``timberline.llm``.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``.

Defined results: a null text is kept as an empty one by every stage but the quality rules, which reject texts with fewer than 20
words. Rows without an id go through, each by itself. Rows of one id are judged each by its own text; near copies leave one
document of each group, and rows equal in id and text become one. Columns beside those of ``documents`` are passed on. Empty
tables go through all stages and give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timberline.llm import minhash, packing, pii, quality, toxicity
from timberline.llm.common import pin, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: The near-duplicate stage and the learned ones can't be put in SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            # Nothing reads a stage's input any more once its output is written.
            docs = written = pin(docs, replaces=written)
    return docs
