"""Forecasts of the leaf temperature for all boards at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.functions.climate import time_features, vpd
from canopyflow.operators import sequence as seq
from canopyflow.operators import slicing as sl
from canopyflow.operators.filters import dedupe_last, override_latest, tail
from canopyflow.operators.joins import align
from canopyflow.operators.reshape import forecast_document
from canopyflow.plans.recursion import recursive_forecast
from canopyflow.plans.season import env_forecast
from canopyflow.session import materialise

#: a fitted pipeline and its input columns
Model = tuple[PipelineModel, Sequence[str]]


def history_rows(freq_min: int) -> int:
    return max(15, int(C.LAG_SPAN_MIN / freq_min))


def soft_sensor(df: DataFrame, slicing: sl.Slicing, model: PipelineModel, cols: Sequence[str], task: C.Task) -> DataFrame:
    """Estimate the target on rows with all inputs, then carry it over the board's others. Rows are scored where they are.

    Boards without such a row keep what they have.
    """
    t = time_features("_time")
    ok = F.lit(True)
    for c in cols:
        ok = ok & (F.col(c).isNotNull() if c in df.columns else F.lit(True))
    full = df.where(ok).withColumns({n: t[n] for n in t if n in cols})
    scored = model.transform(full).withColumn(task.target, F.col("prediction")).select(df.columns)
    both = materialise(scored.unionByName(df.where(~ok)))
    boards = df.where(ok).select("id_board").distinct()
    filled = seq.fill(both.join(boards, "id_board", "left_semi"), slicing, [task.target], forward=True, backward=True)
    return filled.select(df.columns).unionByName(both.join(boards, "id_board", "left_anti"))


def context(clean: DataFrame, freq_min: int, what_if: Mapping[str, float | None] | None = None, soft: tuple[PipelineModel, list[str], C.Task] | None = None,
            now: datetime | None = None) -> DataFrame:
    """The bounded history each board is forecast from: its newest rows, if it has enough of them.

    With ``now`` only rows of the last week count, so a board that has been silent longer gets no forecast. Of rows with one stamp
    the greatest ``seq`` counts, or without it the greatest values.

    ``what_if`` values replace those of the newest row. ``soft`` patches the target, unless measured values are wanted.
    """
    need = history_rows(freq_min)
    if now is not None:
        clean = clean.where(F.col("_time") >= F.lit(now - timedelta(days=C.FORECAST_LOOKBACK_DAYS)))
    values = [c for c in clean.columns if c not in ("id_board", "_time", "seq")]
    d = clean.withColumn("_seq", F.struct(*(c for c in ("seq", *values) if c in clean.columns)))
    d = tail(dedupe_last(d, ["id_board", "_time"], "_seq").drop("_seq"), need + 5, ["id_board"], ["_time"])
    counts = d.groupBy("id_board").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > need).select("id_board")
    d = d.join(counts, "id_board", "left_semi")
    if what_if:
        d = override_latest(d, what_if)
    d = materialise(d)
    if soft is not None:
        d = soft_sensor(d, sl.Slicing(("id_board",)), *soft)
    d = d.withColumn("vpd", vpd("leaf_temp", "air_temp", "humidity"))
    return materialise(tail(d, need, ["id_board"], ["_time"]))


def env_columns(env: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Long environment forecast to one row per board and step."""
    return env.groupBy("id_board", "step", "_time").agg(*[F.max(F.when(F.col("_field") == f, F.col("value"))).alias(f) for f in fields])


#: what a blended forecast says besides its value
ENSEMBLE = ("forecast_env", "forecast_auto", "weight_env", "weight_auto")


def blend_weights(mae_env: float | None, mae_auto: float | None) -> tuple[float, float]:
    """Inverse-error weights; equal ones when an error is not known."""
    if mae_env is None or mae_auto is None:
        return 0.5, 0.5
    a, b = 1.0 / (mae_env + C.BLEND_EPSILON), 1.0 / (mae_auto + C.BLEND_EPSILON)
    return a / (a + b), b / (a + b)


def blend(env: DataFrame, auto: DataFrame, mae_env: float | None, mae_auto: float | None, keys: Sequence[str] = ("id_board", "step")) -> DataFrame:
    """Weighted mean of the two forecasts, step by step."""
    w_env, w_auto = blend_weights(mae_env, mae_auto)
    both = align(env.withColumnRenamed("value", "forecast_env"), auto.select(*keys, F.col("value").alias("forecast_auto")), keys)
    return both.withColumn("value", F.bround(F.col("forecast_auto") * w_auto + F.col("forecast_env") * w_env, 3))


def with_forecast_vpd(forecast: DataFrame, env: DataFrame) -> DataFrame:
    """Deficit of each forecast step from the forecast air temperature and humidity."""
    j = forecast.join(env.select("id_board", "step", "air_temp", "humidity"), ["id_board", "step"])
    return j.withColumn("vpd", vpd("value", "air_temp", "humidity"))


def ensemble(history: DataFrame, env: DataFrame, group: str, models: Mapping[str, Model], mae: Mapping[str, float | None], freq_min: int,
             tasks: Mapping[str, C.Task] = C.TASKS, groups: Mapping[str, tuple[str, str, str]] = C.GROUPS) -> DataFrame:
    """Soft-sensor patched autoregressive forecast blended with the environmental one; with both and their weights."""
    soft, by_env, auto = groups[group]
    patched = materialise(soft_sensor(history, sl.Slicing(("id_board",)), *models[soft], tasks[soft]))
    a = recursive_forecast(patched, env, *models[auto], tasks[auto], freq_min)
    b = recursive_forecast(history, env, *models[by_env], tasks[by_env], freq_min)
    w_env, w_auto = blend_weights(mae.get(by_env), mae.get(auto))
    return blend(b, a, mae.get(by_env), mae.get(auto)).withColumns({"weight_env": F.round(F.lit(w_env), 3), "weight_auto": F.round(F.lit(w_auto), 3)})


def forecasts(clean: DataFrame, season: DataFrame, models: Mapping[str, Model], mae: Mapping[str, float | None], freq_min: int,
              groups: Sequence[str] = tuple(C.GROUPS), single: Sequence[str] = tuple(C.TASKS), tasks: Mapping[str, C.Task] = C.TASKS,
              group_tasks: Mapping[str, tuple[str, str, str]] = C.GROUPS, what_if: Mapping[str, float | None] | None = None,
              use_measured: bool = False, now: datetime | None = None, threads: int = 4) -> dict[str, tuple[DataFrame, DataFrame]]:
    """By source, the bounded history that every board is forecast from and the stored forecast of every group and task.

    The loop is over the catalogue, some of it at a time; boards are rows. A group or a task without its models gets none.
    """
    contexts = {}

    def ready(name: str) -> tuple[DataFrame, DataFrame]:
        soft = C.soft_task(name) if C.soft_task(name) in models else group_tasks[name][0] if name in group_tasks else None
        if soft not in contexts:
            patch = None if use_measured or soft not in models else (*models[soft], tasks[soft])
            h = context(clean, freq_min, what_if, patch, now)
            fields = [f for f in C.ENV_FEATURES if f in h.columns]
            steps = int(C.HORIZON_MIN / freq_min)
            contexts[soft] = (h, materialise(env_columns(env_forecast(h, season, freq_min, steps, fields), fields)))
        return contexts[soft]

    def of_group(g: str, h: DataFrame, env: DataFrame) -> DataFrame:
        return with_forecast_vpd(ensemble(h, env, g, models, mae, freq_min, tasks, group_tasks), env)

    def of_task(name: str, h: DataFrame, env: DataFrame) -> DataFrame:
        return with_forecast_vpd(recursive_forecast(h, env, *models[name], tasks[name], freq_min), env)

    jobs: list[tuple[str, Callable[..., DataFrame], str]] = [(f"ENSEMBLE_{g}", of_group, g) for g in groups if all(t in models for t in group_tasks[g])]
    jobs += [(name.upper(), of_task, name) for name in single if name in models]
    given = [ready(name) for _, _, name in jobs]
    with ThreadPoolExecutor(threads) as pool:
        done = list(pool.map(lambda job, at: materialise(job[1](job[2], *at)), jobs, given))
    return {source: (h, rows) for (source, _, _), (h, _), rows in zip(jobs, given, done)}


def score_all(*args, **kw) -> DataFrame:
    """Forecasts of every group and task for every board (arguments as for ``forecasts``): model_source, board, step, value, environment and
    deficit; for groups also the two forecasts that were blended and their weights."""
    out = [rows.withColumn("model_source", F.lit(source)) for source, (_, rows) in forecasts(*args, **kw).items()]
    if not out:
        raise ValueError("no group and no task has its models")
    d = out[0]
    for o in out[1:]:
        d = d.unionByName(o, allowMissingColumns=True)
    details = {c: F.lit(None).cast("double") for c in ENSEMBLE if c not in d.columns}
    return d.withColumns(details) if details else d


def documents(given: Mapping[str, tuple[DataFrame, DataFrame]], freq_min: int) -> DataFrame:
    """A nested document for each board and source of ``forecasts``; those of groups hold what was blended."""
    out = None
    for source, (history, rows) in given.items():
        doc = forecast_document(history, rows.withColumnRenamed("value", "leaf_temp"), freq_min).withColumn("model_source", F.lit(source))
        out = doc if out is None else out.unionByName(doc, allowMissingColumns=True)
    return out


def prediction_columns(scored: DataFrame, *keep: str) -> DataFrame:
    """Forecast rows under the names stored as points, and the columns in ``keep``."""
    return scored.select(*keep, "id_board", "_time", F.col("value").alias("leaf_temp_pred"), F.col("air_temp").alias("air_temp_pred"),
                         F.col("humidity").alias("humidity_pred"))
