"""Daily-season forecasts of the environment: one panel model per variable over all boards.

A linear trend and four daily Fourier pairs, fitted by least squares. The normal equations of all variables are one
aggregation over the panel (65 sums per variable), so no row passes through the driver and nothing iterates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import aggregates as agg
from canopyflow.operators import slicing as sl
from canopyflow.operators.filters import tail
from canopyflow.operators.sequence import future_grid
from canopyflow.session import materialise

PAIRS = 4
_MODEL = "_field string, t0 double, span double, coef array<double>"


def design(time: str = "_time") -> list[Column]:
    """Constant, trend from the model's own time range, sine and cosine of the day."""
    minute = F.hour(time) * 60 + F.minute(time) + F.second(time) / 60.0
    trend = (F.unix_micros(time) / 1e6 - F.col("t0")) / F.col("span")
    waves = [f(F.lit(2 * math.pi * k / 1440.0) * minute) for k in range(1, PAIRS + 1) for f in (F.sin, F.cos)]
    return [F.lit(1.0), trend, *waves]


def panel(df: DataFrame, freq_min: int, boards: Sequence[str] | None = None, fields: Sequence[str] = C.ENV_FEATURES) -> DataFrame:
    """Newest values per board and variable, of boards with enough of them."""
    if boards is not None:
        df = df.where(F.col("id_board").isin(list(boards)))
    days = C.SEASON_DAYS if freq_min >= C.FREQ_MIN else C.SEASON_DAYS // 2
    long = df.unpivot(["id_board", "_time"], [f for f in fields if f in df.columns], "_field", "y").where(F.col("y").isNotNull())
    by = ["id_board", "_field"]
    recent = materialise(tail(long, int(days * 1440 / freq_min), by, ["_time"]))
    enough = agg.gate(recent, "y", C.SEASON_MIN_ROWS, by).where("enough").select(*by)
    kept = recent.join(enough, by, "left_semi")
    total = agg.gate(kept, "y", C.SEASON_MIN_TOTAL, ["_field"]).where("enough").select("_field")
    return kept.join(total, "_field", "left_semi")


def fit_models(rows: DataFrame) -> DataFrame:
    """Coefficients per variable."""
    ends = rows.groupBy("_field").agg((F.min(F.unix_micros("_time")) / 1e6).alias("t0"), (F.max(F.unix_micros("_time")) / 1e6).alias("_t1"))
    ends = ends.select("_field", "t0", F.greatest(F.col("_t1") - F.col("t0"), F.lit(1.0)).alias("span"))  # a row per variable
    d = rows.join(F.broadcast(ends), "_field")
    x = [f"_x{i}" for i in range(2 + 2 * PAIRS)]
    d = d.select("_field", "t0", "span", "y", *[c.alias(n) for n, c in zip(x, design())])
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = d.groupBy("_field", "t0", "span").agg(
        F.array(*[F.sum(F.col(x[i]) * F.col(x[j])) for i, j in pairs]).alias("xx"), F.array(*[F.sum(F.col(c) * F.col("y")) for c in x]).alias("xy"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            m = np.zeros((len(x), len(x)))
            for (i, j), s in zip(pairs, r.xx):
                m[i, j] = m[j, i] = s
            out.append((r._1, r.t0, r.span, np.linalg.lstsq(m, np.asarray(r.xy), rcond=1e-12)[0].tolist()))
        return pd.DataFrame(out, columns=["_field", "t0", "span", "coef"])

    return sums.groupBy("_field").applyInPandas(solve, _MODEL)  # one row per variable


def predict(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Add ``yhat`` to rows of (_field, _time); null for a variable without a model. One model row per variable."""
    d = rows.join(F.broadcast(models), "_field", "left")
    terms = [c * F.get("coef", F.lit(i)) for i, c in enumerate(design())]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return d.withColumn("yhat", total).drop("t0", "span", "coef")


def season_fit(df: DataFrame, freq_min: int, boards: Sequence[str] | None = None, fields: Sequence[str] = C.ENV_FEATURES) -> tuple[DataFrame, DataFrame]:
    """(production models fitted on the whole panel, errors of models fitted on the first 80 % of the stamps)."""
    p = materialise(panel(df, freq_min, boards, fields))
    split = materialise(agg.quantile_split(p, sl.fit(p, ["_field"]), C.SEASON_SPLIT, ["_time", "id_board"]))
    held = predict(split.where(~F.col("is_train")), fit_models(split.where("is_train")))
    errors = agg.regression_metrics(held, "y", "yhat", ["_field"])
    return materialise(fit_models(p)), errors


def env_forecast(history: DataFrame, models: DataFrame, freq_min: int, steps: int, fields: Sequence[str] = C.ENV_FEATURES) -> DataFrame:
    """Forecast of each variable on the steps after each board's newest row: the model, else the last value, else 0."""
    grid = future_grid(history, freq_min, steps)
    have = [f for f in fields if f in history.columns]
    newest = history.groupBy("id_board").agg(*[F.max_by(f, "_time").alias(f) for f in have])
    last = newest.unpivot(["id_board"], have, "_field", "last_value") if have else None
    wanted = grid.withColumn("_field", F.explode(F.array(*[F.lit(f) for f in fields])))
    d = predict(wanted, models)
    if last is not None:
        d = d.join(last, ["id_board", "_field"], "left")
    else:
        d = d.withColumn("last_value", F.lit(None).cast("double"))
    return d.select("id_board", "step", "_time", "_field", F.coalesce("yhat", "last_value", F.lit(0.0)).alias("value"),
                    F.col("yhat").isNotNull().alias("from_model"))
