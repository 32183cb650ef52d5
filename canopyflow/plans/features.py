"""Model input: cyclic time, differences, lags, and the train / test split."""

from __future__ import annotations

from pyspark.sql import DataFrame

from canopyflow import config as C
from canopyflow.functions.climate import time_features
from canopyflow.operators import sequence as seq
from canopyflow.operators.slicing import Slicing
from canopyflow.session import materialise

TIME_COLS = ["time_sin", "time_cos"]


def extended(task: C.Task) -> list[str]:
    """Model columns before lags."""
    return [*task.features, *TIME_COLS, *([f"{f}_diff" for f in task.features] if task.use_lags else [])]


def lagged(task: C.Task) -> list[str]:
    """Columns that are lagged."""
    if not task.use_lags:
        return []
    return [c for c in extended(task) if c not in TIME_COLS] + ([task.target] if task.lag_target else [])


def model_columns(task: C.Task, freq_min: int, lags: int | None = None) -> list[str]:
    n = lags or task.lags(freq_min)
    return [*extended(task), *[f"{c}_lag_{i}" for c in lagged(task) for i in range(1, n + 1)]]


def without_diffs(cols: list[str]) -> list[str]:
    """The column list of the variant that ignores differences (their lags stay)."""
    return [c for c in cols if not c.endswith("_diff")]


def build(df: DataFrame, slicing: Slicing, task: C.Task, freq_min: int, lags: int | None = None) -> DataFrame:
    """Feature columns of a task for every row. All lags come from one window and one select."""
    cols = [*task.features, *([task.target] if task.target in df.columns else [])]
    d = df.select("id_board", "_time", *cols)
    if task.use_lags:
        d = materialise(seq.diff_features(d, slicing, list(task.features), freq_min))
        d = seq.lag_features(d, slicing, lagged(task), lags or task.lags(freq_min), freq_min)
    return d.withColumns(time_features("_time"))


def training_frame(df: DataFrame, slicing: Slicing, task: C.Task, freq_min: int, lags: int | None = None) -> DataFrame:
    """Complete rows of all boards with the first 90 % of each board marked as training rows."""
    cols = model_columns(task, freq_min, lags)
    d = build(df, slicing, task, freq_min, lags).na.drop("any", subset=[*cols, task.target])
    d = materialise(d.select("id_board", "_time", *cols, task.target))
    return seq.fraction_split(d, slicing)
