"""The recurring jobs over stored tables: bring the clean table up to date, forecast, store."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators.aggregates import max_time
from canopyflow.operators.filters import filter_fields
from canopyflow.operators.joins import reintegrate
from canopyflow.operators.reshape import pivot_fields
from canopyflow.plans import forecast
from canopyflow.plans.clean import sync_clean
from canopyflow.plans.store import ModelStore
from canopyflow.session import materialise
from canopyflow.sources import tables


def newer_raw(spark: SparkSession, raw_path: str, clean: DataFrame, halo_min: int = C.OVERLAP_MIN) -> DataFrame:
    """Raw points that can give new clean ones: from the least of the boards' newest clean stamps on, and all points of boards that
    have no clean point, however old they are. The stamp reaches the scan as a literal; of older days only the boards' names are read."""
    marks = materialise(max_time(filter_fields(clean, "pred", negate=True), ["id_board"]))
    least = marks.agg(F.min("max_time")).first()[0]  # one row
    if least is None:
        return tables.read_table(spark, raw_path)
    recent = tables.read_table(spark, raw_path, since=str(least - timedelta(minutes=halo_min)))
    boards = tables.read_table(spark, raw_path).where("id_board is not null").select("id_board").distinct()
    unseen = materialise(boards.join(marks, "id_board", "left_anti"))
    if unseen.isEmpty():
        return recent
    return recent.join(unseen, "id_board", "left_anti").unionByName(tables.read_table(spark, raw_path).join(unseen, "id_board", "left_semi"))


def sync(spark: SparkSession, raw_path: str, clean_path: str, freq_min: int = C.FREQ_MIN, archive_path: str | None = None,
         now: datetime | None = None, halo_min: int = C.OVERLAP_MIN, **kw) -> None:
    """Upsert new clean points, and archived forecasts newer than the stored ones, into the clean table.

    With ``now`` clean points older than the look-back are not looked at, so a board without newer ones is done whole again.
    """
    since = None if now is None else str(now - timedelta(days=C.CLEAN_LOOKBACK_DAYS))
    clean = tables.read_table(spark, clean_path, since=since)
    tables.write_points(sync_clean(newer_raw(spark, raw_path, clean, halo_min), clean, freq_min, halo_min=halo_min, **kw), clean_path)
    if archive_path is not None:
        if now is None:
            raise ValueError("forecasts are copied back relative to a time: give now")
        earliest = str(now - timedelta(days=C.CLEAN_LOOKBACK_DAYS, minutes=C.OVERLAP_MIN))
        archive = tables.read_table(spark, archive_path, since=earliest)
        fresh = reintegrate(archive, tables.read_table(spark, clean_path, since=since), f"{freq_min}m", F.lit(now))
        tables.write_points(tables.as_points(fresh), clean_path)


def run_forecasts(spark: SparkSession, clean_path: str, archive_path: str, model_path: str, freq_min: int, now: datetime, **kw) -> DataFrame:
    """Forecast every board by every group and task from the last week of the clean table, and save to the clean and the archive table.

    Models are those in force at ``model_path``; nothing of the training run has to be at hand. Returns the saved points; each carries its
    source.
    """
    trained = ModelStore(spark, model_path).load(freq_min)
    week = str(now - timedelta(days=C.FORECAST_LOOKBACK_DAYS))
    measured = filter_fields(tables.read_table(spark, clean_path, since=week), "pred", negate=True)
    wide = materialise(pivot_fields(measured))
    scored = forecast.score_all(wide, trained.season, trained.models, trained.mae, freq_min, now=now, **kw)
    return tables.save_predictions(forecast.prediction_columns(scored, "model_source"), clean_path, archive_path, None, freq_min)
