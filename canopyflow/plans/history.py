"""History of boards: windowed means as a wide frame, re-anchored for boards that lag."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.functions.climate import to_local, with_vpd
from canopyflow.operators.aggregates import bin_start
from canopyflow.sources.tables import read_table


def oldest(now: Column, hours_past: float) -> Column:
    """Nothing before this decides on an anchor."""
    return now - F.expr(f"INTERVAL {int(max(C.STALE_LOOKBACK_DAYS * 24, hours_past) * 3600)} SECONDS")


def anchors(points: DataFrame, now: Column, hours_past: float, hours_future: float = 3) -> DataFrame:
    """Per board: ``now`` when it has points around it, else its newest stamp of the last 180 days, and a stale flag."""
    hour = lambda h: F.expr(f"INTERVAL {int(h * 3600)} SECONDS")
    t = F.col("_time")
    points = points.where(t >= oldest(now, hours_past))
    recent = F.max(F.when((t >= now - hour(hours_past)) & (t < now + hour(hours_future)), True))
    newest = F.max(F.when(t >= now - F.expr(f"INTERVAL {C.STALE_LOOKBACK_DAYS} DAYS"), t))
    per = points.groupBy("id_board").agg(recent.alias("_recent"), newest.alias("_newest"))
    per = per.where(F.col("_newest").isNotNull())
    anchor = F.when(F.col("_recent"), now).otherwise(F.col("_newest"))
    return per.select("id_board", (anchor - hour(hours_past)).alias("_start"), (anchor + hour(hours_future)).alias("_stop"),
                      (now - F.col("_newest") > hour(hours_past)).alias("is_stale"))


def history_view(points: DataFrame, now: Column, hours_past: float, hours_future: float = 3, every_min: int = C.FREQ_MIN,
                 fields: Sequence[str] = (*C.FIELDS, *C.PRED_FIELDS), zone: str = C.LOCAL_ZONE) -> DataFrame:
    """Mean of each field per window, stamped with the window's end (cut at the end of the range), plus deficits.

    Means and pivot are one aggregation. The anchors are one row per board; the join strategy follows their size.
    """
    earliest = oldest(now, hours_past) - F.expr(f"INTERVAL {int(hours_past * 3600)} SECONDS")  # pushed into the scan, as `now` is a literal
    near = points.where(F.col("_time") >= earliest).join(anchors(points, now, hours_past, hours_future), "id_board")
    near = near.where((F.col("_time") >= F.col("_start")) & (F.col("_time") < F.col("_stop")))
    end = F.timestamp_micros(F.unix_micros(bin_start("_time", every_min)) + F.lit(every_min * 60_000_000))
    means = near.groupBy("id_board", F.least(end, F.col("_stop")).alias("_time"), "is_stale").agg(
        *[F.avg(F.when(F.col("_field") == f, F.col("_value"))).alias(f) for f in fields])
    return with_vpd(means.withColumn("local_time", to_local("_time", zone)))


def stored_history(spark: SparkSession, path: str, now: datetime, hours_past: float, **kw) -> DataFrame:
    """``history_view`` of a stored point table: only the days that can count are read."""
    since = now - timedelta(hours=max(C.STALE_LOOKBACK_DAYS * 24, hours_past) + hours_past)
    return history_view(read_table(spark, path, since=str(since)), F.lit(now), hours_past, **kw)
