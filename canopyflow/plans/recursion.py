"""Forecasts that feed their own output back, for all boards at once.

A board is one row that holds its newest values as short arrays. A step appends the environment's forecast, derives the model's inputs of
the newest row by array functions, has the model predict, and puts the prediction in its place. So a step is a projection and a
``transform`` of the fitted pipeline, whatever it is made of; nothing is shuffled after the boards' rows are collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.plans.features import TIME_COLS, lagged
from canopyflow.session import materialise

MIN_US = 60_000_000
#: steps that one job takes; a longer plan is slow to optimise, and a lost executor repeats a job
_STEPS_A_JOB = 6


def _fill_down(a: Column) -> Column:
    """The last known value at each place of an array."""
    return F.aggregate(a, F.array().cast("array<double>"), lambda done, x: F.array_append(done, F.coalesce(x, F.try_element_at(done, F.lit(-1)))))


def _filled(a: Column) -> Column:
    """Null places take the last known value, those before the first known one the next."""
    return F.reverse(_fill_down(F.reverse(_fill_down(a))))


def _diffs(a: Column, t: Column, gap_us: float) -> Column:
    """Differences to the place before, filled where there is none: at the first place, and after a gap."""
    known = _fill_down(a)

    def diff(i: Column) -> Column:
        before = F.get(t, i) - F.get(t, i - 1)
        return F.when((i > 0) & (before <= gap_us), F.get(known, i) - F.get(known, i - 1))

    return _filled(F.transform(F.sequence(F.lit(0), F.size(t) - 1), diff))


def _sources(t: Column, lags: int, freq_us: float) -> Column:
    """For each lag the place its value comes from: that of the newest place whose lag does not reach over a gap."""
    def source(i: Column) -> Column:
        near = F.filter(F.sequence(i, F.size(t) - 1), lambda j: F.get(t, j) - F.get(t, j - i) <= i * F.lit(freq_us * C.GAP_FACTOR))
        return F.when(i < F.size(t), F.array_max(near) - i)

    return F.transform(F.sequence(F.lit(1), F.lit(lags)), source)


def _boards(history: DataFrame, env: DataFrame, features: Sequence[str], target: str, steps: int) -> DataFrame:
    """A row per board: its stamps and values in order, and the environment's coming rows. Both are bounded by a few dozen rows."""
    past = F.array_sort(F.collect_list(F.struct(F.unix_micros("_time").alias("t"), *[F.col(c).cast("double").alias(c) for c in [*features, target]])))
    coming = F.array_sort(F.collect_list(F.struct(F.col("step").cast("int").alias("step"), *[F.col(c).cast("double").alias(c) for c in features])))
    a = history.groupBy("id_board").agg(past.alias("_past"))
    b = env.groupBy("id_board").agg(F.slice(coming, 1, steps).alias("_env"))
    number = lambda c: F.transform("_past", lambda x: F.nanvl(x[c], F.lit(None).cast("double")))
    return a.join(b, "id_board").select(
        "id_board", "_env", F.transform("_past", lambda x: x["t"]).alias("_t"), F.try_element_at("_past", F.lit(-1))["t"].alias("_t0"),
        *[number(c).alias(f"_v_{c}") for c in features], number(target).alias("_y"), F.array().cast("array<struct<step:int,t:bigint,value:double>>").alias("_out"))


class _Step:
    """The projections of a step, the same for each: the number of the step is a column."""

    def __init__(self, cols: Sequence[str], task: C.Task, freq_min: int, lags: int):
        freq_us = freq_min * MIN_US
        features = list(task.features)
        values = [f"_v_{c}" for c in features]
        told = F.get("_env", F.col("_k"))
        own = ["id_board", "_env", "_t0", "_k"]
        self.append = [*own, "_out", F.array_append("_t", F.col("_now")).alias("_t"), F.array_append("_y", F.lit(0.0)).alias("_y"),
                       *[F.array_append(v, told[c]).alias(v) for v, c in zip(values, features)], "_now"]
        self.now = (F.col("_t0") + told["step"].cast("long") * freq_us).alias("_now")
        self.state = [*own, "_out", "_t", "_y", *values, "_now"]
        self.filled = [_filled(F.col(v)).alias(f"_f_{c}") for v, c in zip(values, features)]
        if task.use_lags:
            self.filled += [_filled(F.col("_y")).alias(f"_f_{task.target}"), _sources(F.col("_t"), lags, freq_us).alias("_from"),
                            *[_diffs(F.col(v), F.col("_t"), freq_us * C.GAP_FACTOR).alias(f"_f_{c}_diff") for v, c in zip(values, features)]]
        day = F.pmod(F.floor(F.col("_now") / MIN_US), F.lit(1440)) * (2 * math.pi / 1440)
        newest = F.size("_t") - 1
        known = {"time_sin": F.sin(day), "time_cos": F.cos(day)}
        known |= {c: F.get(f"_f_{c}", newest) for c in [*features, *([f"{c}_diff" for c in features] if task.use_lags else [])]}
        known |= {f"{c}_lag_{i}": F.get(f"_f_{c}", F.get("_from", F.lit(i - 1))) for c in lagged(task) for i in range(1, lags + 1)}
        self.inputs = [F.coalesce(known[c], F.lit(0.0)).alias(c) for c in cols]
        keep = lags + 2

        def last(a: Column, name: str) -> Column:
            return F.slice(a, F.greatest(F.size(a) - keep + 1, F.lit(1)), F.lit(keep)).alias(name)

        row = F.struct(told["step"].alias("step"), F.col("_now").alias("t"), F.round("prediction", 3).alias("value"))
        self.after = ["id_board", "_env", "_t0", (F.col("_k") + 1).alias("_k"), last(F.col("_t"), "_t"),
                      last(F.array_append(F.slice("_y", F.lit(1), newest), F.col("prediction")), "_y"), *[last(F.col(v), v) for v in values],
                      F.when(told.isNotNull(), F.array_append("_out", row)).otherwise(F.col("_out")).alias("_out")]

    def __call__(self, d: DataFrame, model: PipelineModel) -> DataFrame:
        d = d.select("*", self.now).select(self.append).select([*self.state, *self.filled]).select([*self.state, *self.inputs])
        return model.transform(d).select(self.after)


def recursive_forecast(history: DataFrame, env: DataFrame, model: PipelineModel, cols: Sequence[str], task: C.Task, freq_min: int,
                       lags: int | None = None) -> DataFrame:
    """Step by step: the environment forecast of a step becomes a row, the model predicts its target, the row joins the history.

    ``history``: the newest rows of each board, as ``context`` gives them. ``env``: (id_board, step, feature columns); a board gets as many
    steps as it has there, at most the task's. ``cols``: the model's input columns. Inputs that are not known are 0.
    """
    lags = lags or task.lags(freq_min)
    steps = task.steps(freq_min)
    unknown = set(cols) - {*task.features, *TIME_COLS, *(f"{c}_diff" for c in task.features), *(f"{c}_lag_{i}" for c in lagged(task) for i in range(1, lags + 1))}
    if unknown:
        raise ValueError(f"the model needs columns that the task does not make: {sorted(unknown)}")
    d = materialise(_boards(history, env, task.features, task.target, steps).withColumn("_k", F.lit(0)))
    step = _Step(cols, task, freq_min, lags)
    for k in range(steps):
        d = step(d, model)
        if (k + 1) % _STEPS_A_JOB == 0 and k + 1 < steps:
            d = materialise(d)
    return d.select("id_board", F.inline("_out").alias("step", "t", "value")).select("id_board", "step", F.timestamp_micros("t").alias("_time"), "value")
