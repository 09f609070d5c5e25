"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, fingerprints, mixing, neardup, packing, pii, quality, sharding, substrings, urls


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_extendible_sharding": sharding.op1,
        "op2_cotraining_quality": quality.op2,
        "op3_url_filters": urls.op3,
        "op4_simhash_fingerprints": fingerprints.op4,
        "op5_best_fit_packing": packing.op5,
        "op6_pii_deobfuscation": pii.op6,
        "op7_pivotal_mixing": mixing.op7,
        "op8_simhash_bktree_neardup": neardup.op8,
        "op9_sentence_span_dedup": substrings.op9,
        "op10_vantage_point_ann": ann.op10,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_extendible_sharding": sharding.SQL, "op3_url_filters": urls.SQL, "op10_vantage_point_ann": ann.SQL}
