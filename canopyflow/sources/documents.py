"""Small JSON documents: the node topology and model reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("MAE", "RMSE", "R_squared", "train_MAE", "train_RMSE", "train_R_squared")
TIMINGS = ("training_time_seconds", "inference_time_seconds")
REPORT = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS])),
    T.StructField("performance", T.StructType([T.StructField(m, T.DoubleType()) for m in TIMINGS])),
    T.StructField("feature_importance", T.MapType(T.StringType(), T.DoubleType())),
])


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """node_id -> star_id of files that hold JSON objects, pretty-printed or one per line."""
    text = spark.read.text(path, wholetext=True)
    objects = text.select(F.explode(F.split("value", r"(?<=\})\s*(?=\{)")).alias("value"))
    return objects.select(F.explode(F.from_json("value", "map<string,string>")).alias("node_id", "star_id"))


def write_topology(topology: DataFrame, path: str, parts: int = 1) -> None:
    """JSON objects of nodes and hubs, ``parts`` of them; the reader merges the parts.

    A fleet has one row per node; ask for about one part per 100,000 nodes so that no object grows with the fleet.
    """
    pair = F.struct(F.col("node_id").cast("string"), F.col("star_id").cast("string"))
    by_part = topology.groupBy(F.pmod(F.xxhash64("node_id"), F.lit(parts)).alias("_p"))
    by_part.agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("value")).select("value").write.text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All ``*_metrics.json`` below a models folder, with the task each belongs to (the folder two levels up)."""
    df = spark.read.json(path, schema=REPORT, multiLine=True, pathGlobFilter="*_metrics.json", recursiveFileLookup=True)
    task = F.regexp_extract(F.input_file_name(), r"/([^/]+)/models_archive/[^/]+$", 1)
    return df.select(task.alias("task"), "model_name", "best_params", "metrics.*", "performance.*", "feature_importance")


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON line per report, a folder per task and model; a new report replaces the one of the same task and model."""
    doc = F.to_json(F.struct(
        "model_name", "best_params", F.struct(*METRICS).alias("metrics"), F.struct(*TIMINGS).alias("performance"), "feature_importance"))
    reports.select(F.col("task").alias("report_task"), F.col("model_name").alias("report_model"), doc.alias("value")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("report_task", "report_model").text(path)


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """Reports written by write_reports."""
    df = spark.read.text(path)
    return df.select(F.col("report_task").alias("task"), F.from_json("value", REPORT).alias("_r")).select(
        "task", "_r.model_name", "_r.best_params", "_r.metrics.*", "_r.performance.*", "_r.feature_importance")
