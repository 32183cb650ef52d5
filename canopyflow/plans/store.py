"""Trained models that another process can load: a folder for each training run, and a registry that is switched at once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow import config as C
from canopyflow.plans.learn import Fitted
from canopyflow.sources.versions import COMMIT, VersionedTable, Files

#: the registry's name for the season models of all variables
SEASON = "season"
REGISTRY = T.StructType([T.StructField(n, t) for n, t in (
    ("freq", T.IntegerType()), ("task", T.StringType()), ("best_model", T.StringType()), ("mae", T.DoubleType()), ("target", T.StringType()),
    ("columns", T.ArrayType(T.StringType())), ("run", T.StringType()))])


@dataclass(frozen=True)
class Trained:
    """What forecasts need: the season models, and by task the pipeline with its input columns and its test error."""

    season: DataFrame
    models: dict[str, tuple[PipelineModel, list[str]]]
    mae: dict[str, float]


class ModelStore:
    """Models under ``path``: ``runs/<run>/<freq>m/<task>`` and ``runs/<run>/<freq>m/season``, and the registry of those in force."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = VersionedTable(spark, f"{self.path}/registry", REGISTRY, ["freq", "task"], [COMMIT])

    def _folder(self, run: str, freq_min: int, task: str) -> str:
        return f"{self.path}/runs/{run}/{freq_min}m/{task}"

    def save(self, freq_min: int, season: DataFrame, winners: Mapping[str, Fitted], tasks: Mapping[str, C.Task] = C.TASKS) -> str:
        """Store a training run, then put all of it in force by one commit. Tasks that it does not have keep their models."""
        run = uuid.uuid4().hex
        season.write.parquet(self._folder(run, freq_min, SEASON))
        for name, best in winners.items():
            best.model.write().save(self._folder(run, freq_min, name))
        rows = [(freq_min, n, b.spec.name, float(b.metrics["MAE"]), tasks[n].target, list(b.cols), run) for n, b in winners.items()]
        rows.append((freq_min, SEASON, None, None, None, [], run))
        self.table.append(self.spark.createDataFrame(rows, REGISTRY).coalesce(1))
        self.table.compact()
        return run

    def registry(self, freq_min: int) -> DataFrame:
        """The models in force: a row for each task, and one for the season models."""
        return self.table.read(F.col("freq") == freq_min)

    def load(self, freq_min: int, threads: int = 4) -> Trained:
        """The models in force of a frequency; a task that was never trained is not among them."""
        rows = self.registry(freq_min).collect()  # a row for each task
        season = [r.run for r in rows if r.task == SEASON]
        if not season:
            raise LookupError(f"no models of {freq_min} minutes at {self.path}")
        named = [r for r in rows if r.task != SEASON]
        with ThreadPoolExecutor(threads) as pool:
            pipelines = list(pool.map(lambda r: PipelineModel.load(self._folder(r.run, freq_min, r.task)), named))
        return Trained(self.spark.read.parquet(self._folder(season[0], freq_min, SEASON)), {r.task: (p, list(r.columns)) for r, p in zip(named, pipelines)},
                       {r.task: r.mae for r in named})

    def prune(self, grace_s: float = 86_400) -> None:
        """Drop the folders of runs that nothing in force comes from, but for those younger than ``grace_s`` seconds."""
        self.table.vacuum(keep=1, grace_s=grace_s)
        used = {r.run for r in self.table.read().select("run").distinct().collect()}
        files = Files(self.spark, self.path)
        for run, written in files.listed("runs").items():
            if run not in used and time.time() - written >= grace_s:
                files.delete(f"runs/{run}")
