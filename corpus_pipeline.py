"""Documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopyflow.llm import stages
from canopyflow.llm.common import stored

STAGES = [("quality_classifier", stages.quality), ("simhash_near_dedup", stages.near_dedup),
          ("suffix_array_dedup", stages.repeats), ("best_fit_packing", stages.packing)]
ORACLE_SQL = None  # fingerprints, learned scores and tokens are beyond SQL; tests/llm/test_pipeline.py has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
