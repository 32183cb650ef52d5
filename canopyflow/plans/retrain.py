"""The full training run of one frequency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession

from canopyflow import config as C
from canopyflow.operators import slicing as sl
from canopyflow.operators.filters import filter_fields
from canopyflow.operators.reshape import pivot_fields
from canopyflow.plans import features, learn, season
from canopyflow.plans.clean import Steps
from canopyflow.plans.cycle import sync
from canopyflow.plans.store import ModelStore
from canopyflow.session import materialise
from canopyflow.sources import documents, tables


def check_freq(freq_min: int) -> int:
    if freq_min <= 0 or freq_min > C.FREQ_MIN or C.FREQ_MIN % freq_min:
        raise ValueError(f"the frequency must divide {C.FREQ_MIN} minutes")
    return freq_min


def train_task(frame: DataFrame, task: C.Task, freq_min: int, specs: Sequence[learn.Spec], lags: int | None = None, threads: int = 8) -> list[learn.Fitted]:
    """All models of a task on its training frame."""
    frame = materialise(frame)
    cols = features.model_columns(task, freq_min, lags)
    return learn.grid_search(frame.where("is_train").drop("is_train"), frame.where("NOT is_train").drop("is_train"), specs, cols, list(task.features),
                             task.target, learn.folds_for(freq_min), threads)


def retrain(spark: SparkSession, raw_path: str, clean_path: str, model_path: str, freq_min: int = C.FREQ_MIN, tasks: Mapping[str, C.Task] = C.TASKS,
            boards: Sequence[str] | None = None, specs: Sequence[learn.Spec] | None = None,
            steps: Steps = MappingProxyType({}), archive_path: str | None = None, now: datetime | None = None) -> DataFrame:
    """Bring the clean table up to date, fit the season models, search every task's models, store reports and put the winners in force.

    The clean table is brought up to date as ``cycle.sync`` does, from the days it needs and with archived forecasts copied back if
    ``archive_path`` and ``now`` are given. ``boards`` limits the training to some boards. Returns the reports.
    """
    check_freq(freq_min)
    sync(spark, raw_path, clean_path, freq_min, archive_path, now, steps=steps)
    clean = filter_fields(tables.read_table(spark, clean_path), "pred", negate=True)
    if boards is not None:
        clean = clean.where(clean.id_board.isin(list(boards)))
    wide = materialise(pivot_fields(clean))
    slicing = sl.fit(wide, ["id_board"])
    season_models, season_errors = season.season_fit(wide, freq_min)
    folder = f"{model_path.rstrip('/')}/{freq_min}m"
    season_errors.write.mode("overwrite").parquet(f"{folder}/season_errors")
    winners, reports = {}, None
    for name, task in tasks.items():
        fitted = train_task(features.training_frame(wide, slicing, task, freq_min), task, freq_min, specs or learn.model_grid(freq_min))
        winners[name] = learn.winner(fitted)
        rows = learn.report_frame(spark, name, fitted)
        reports = rows if reports is None else reports.unionByName(rows)
    documents.write_reports(reports, f"{folder}/reports")
    ModelStore(spark, model_path).save(freq_min, season_models, winners, tasks)
    return reports
