"""The registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timberline.llm import embedding, htmltext, merkle, minhash, packing, perfecthash, periodic, pii, quality, resharding, toxicity, urls, wordbpe
from timberline.llm.common import read


def op1_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.assign(read(spark, sf_dir, "documents"), old_shards=6, new_shards=8)


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op3_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), positives=3000, unlabelled=8000)
    return toxicity.score(docs, model, threshold=0.3)


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op5_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=75)


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op8_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op9_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_crochemore_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(read(spark, sf_dir, "documents"))


def op12_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perfecthash.exact_duplicates(read(spark, sf_dir, "documents"), perfecthash.in_history()).drop("known")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_min_cost_resharding,
        op2_pattern_packing,
        op3_nnpu_toxicity,
        op4_quality_cascade,
        op5_speculative_bpe,
        op6_bbit_minhash,
        op7_contextual_pii,
        op8_redirect_equivalence,
        op9_tag_path_ratios,
        op10_cross_polytope,
        op11_crochemore_runs,
        op12_perfect_hash_dedup,
        op13_merkle_manifest,
    )
}

#: DuckDB's SQL for the queries that SQL can express; the others are tested against brute force in ``tests/llm``.
ORACLES: dict[str, str] = {"op4_quality_cascade": quality.SQL, "op11_crochemore_runs": periodic.SQL, "op12_perfect_hash_dedup": perfecthash.SQL, "op13_merkle_manifest": merkle.SQL}
