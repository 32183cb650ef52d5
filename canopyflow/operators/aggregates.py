"""Aggregations. Everything hash-aggregates with partial aggregation; ordered statistics use sliced ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflow.config import SEASON_SPLIT, TOP_MAX, TOP_SHARE
from canopyflow.functions.text import feature_label
from canopyflow.operators import slicing as sl


def bin_start(time: str | Column, minutes: float) -> Column:
    """Start of the epoch-aligned bin (so 6-minute bins are aligned to midnight)."""
    width = int(minutes * 60)
    t = F.col(time) if isinstance(time, str) else time
    return F.timestamp_seconds(F.floor(F.unix_seconds(t) / F.lit(width)) * F.lit(width))


def window_mean(df: DataFrame, minutes: int, keys: Sequence[str] = ("id_board", "_field"), stop: Column | None = None) -> DataFrame:
    """Mean per window that has rows, stamped with the window's end (cut at ``stop``)."""
    g = df.groupBy(*keys, F.window("_time", f"{minutes} minutes").alias("_w")).agg(F.avg("_value").alias("_value"))
    end = F.col("_w.end")
    return g.select(*keys, (F.least(end, stop) if stop is not None else end).alias("_time"), "_value")


def bin_means(df: DataFrame, cols: Sequence[str], minutes: int, key: str = "id_board") -> DataFrame:
    """Mean of each column per bin that has rows, stamped with the bin's start."""
    return df.groupBy(key, bin_start("_time", minutes).alias("_time")).agg(*[F.avg(c).alias(c) for c in cols])


def grid(bins: DataFrame, minutes: int, key: str = "id_board") -> DataFrame:
    """Every bin from each board's first to its last one, built a day at a time (no long arrays)."""
    ends = bins.groupBy(key).agg(F.min("_time").alias("_lo"), F.max("_time").alias("_hi"))
    day = F.expr("INTERVAL 1 DAY")
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    days = ends.withColumn("_from", F.explode(F.sequence("_lo", "_hi", day)))
    last = F.least(F.col("_hi"), F.col("_from") + day - step)
    return days.select(key, F.explode(F.sequence("_from", last, step)).alias("_time"))


def resample(df: DataFrame, cols: Sequence[str], minutes: int, key: str = "id_board") -> DataFrame:
    """Bin means on the full grid: empty bins are rows of nulls. ``minutes`` divides a day."""
    if 1440 % minutes:
        raise ValueError("the step must divide a day")
    bins = bin_means(df, cols, minutes, key)
    return grid(bins, minutes, key).join(bins, [key, "_time"], "left")


def max_time(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Newest stamp, over everything or per key."""
    return df.groupBy(*keys).agg(F.max("_time").alias("max_time"))


def last_per_series(df: DataFrame, keys: Sequence[str] = ("id_board", "_field")) -> DataFrame:
    """Newest non-null value per series."""
    have = df.where(F.col("_value").isNotNull())
    best = F.max(F.struct("_time", "seq", "_value"))
    return have.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b._time", "_b._value")


def tag_values(df: DataFrame, tag: str) -> DataFrame:
    return df.select(tag).where(F.col(tag).isNotNull()).distinct()


def burst_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Upper median of each burst: element floor(n/2) of the sorted samples.

    Equal samples are counted together, then counts per whole unit find the unit the median lies in; only the values of
    that unit are put in order. A burst far larger than meant is thus never sorted as a whole.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_unit", F.floor(value))
    w = Window.partitionBy(*keys)
    upto = Window.unboundedPreceding, Window.currentRow
    units = counts.groupBy(*keys, "_unit").agg(F.sum("_n").alias("_in")).select(
        *keys, "_unit", "_in", F.sum("_in").over(w.orderBy("_unit").rowsBetween(*upto)).alias("_end"), F.sum("_in").over(w).alias("samples"))
    middle = F.floor(F.col("samples") / 2)
    unit = units.where((F.col("_end") > middle) & (F.col("_end") - F.col("_in") <= middle))
    near = counts.join(unit, [*keys, "_unit"]).withColumn("_run", F.col("_end") - F.col("_in") + F.sum("_n").over(w.orderBy(value).rowsBetween(*upto)))
    return near.where(F.col("_run") > middle).groupBy(*keys).agg(F.min(value).alias("median"), F.max("samples").alias("samples"))


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R2 in one pass."""
    err = F.col(y) - F.col(p)
    return df.where(err.isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(err)).alias("MAE"), F.sqrt(F.avg(err * err)).alias("RMSE"),
        (F.lit(1.0) - F.sum(err * err) / F.nullif(F.count(err) * F.var_pop(y), F.lit(0.0))).alias("R_squared"),
        F.count(err).alias("n"),
    )


def gate(df: DataFrame, value: str, min_rows: int, by: Sequence[str] = ("id_board",)) -> DataFrame:
    """Per group: row count, distinct values and whether there is enough to learn from."""
    have = df.where(F.col(value).isNotNull())
    g = have.groupBy(*by).agg(F.count(value).alias("rows"), F.count_distinct(F.col(value)).alias("distinct_values"))
    return g.withColumn("enough", (F.col("rows") >= min_rows) & (F.col("distinct_values") > 1))


def quantile_time(df: DataFrame, slicing: sl.Slicing, q: float = SEASON_SPLIT, order: Sequence[str] = ("_time",)) -> DataFrame:
    """Linear-interpolated quantile of the stamps per key of ``slicing``, by exact distributed rank."""
    r = sl.ranked(df, slicing, order, "_rank", "_count")
    pos = F.lit(q) * (F.col("_count") - 1)
    low = F.floor(pos)
    us = F.unix_micros(slicing.time)
    near = r.where(F.col("_rank").between(low + 1, low + 2))
    return near.groupBy(*slicing.key).agg(
        F.min(us).alias("_lo"), F.max(us).alias("_hi"), F.max(pos - low).alias("_part"), F.max("_count").alias("n"),
    ).select(*slicing.key, F.timestamp_micros(F.floor(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).cast("long")).alias("split_time"), "n")


def quantile_split(df: DataFrame, slicing: sl.Slicing, q: float = SEASON_SPLIT, order: Sequence[str] = ("_time",)) -> DataFrame:
    """Mark rows up to the quantile stamp as training rows. One split row per key is joined back."""
    split = quantile_time(df, slicing, q, order)
    j = df.join(split, list(slicing.key)) if slicing.key else df.crossJoin(split)  # a single row without a key
    return j.withColumn("is_train", F.col(slicing.time) <= F.col("split_time"))


def best_model(reports: DataFrame) -> DataFrame:
    """Least MAE per task; equal errors go to the first name."""
    best = F.min(F.struct("MAE", "model_name"))
    return reports.where(F.col("MAE").isNotNull()).groupBy("task").agg(best.alias("_b")).select(
        "task", F.col("_b.model_name").alias("best_model"), F.col("_b.MAE").alias("MAE"))


def rank_features(df: DataFrame, by: Sequence[str] = ("task", "model_name")) -> DataFrame:
    """Importances in descending order of absolute value. A report holds one row per feature."""
    w = Window.partitionBy(*by).orderBy(F.abs("importance").desc(), F.col("feature"))
    return df.withColumn("rank", F.row_number().over(w))


def top_features(df: DataFrame, by: Sequence[str] = ("task", "model_name"), share: float = TOP_SHARE, most: int = TOP_MAX) -> DataFrame:
    """Strongest features until their share of the absolute total is reached, the rest summed as "Other"."""
    by = list(by)
    size = F.abs("importance")
    r = rank_features(df, by).withColumn("label", feature_label(F.col("feature")))
    w = Window.partitionBy(*by)
    r = r.withColumn("_all", F.sum(size).over(w)).where(F.col("_all") > 0)
    run = F.sum(size / F.col("_all")).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_top", (F.coalesce(run, F.lit(0.0)) < share) & (F.col("rank") <= most))
    r = r.withColumn("_named", F.max("_top").over(Window.partitionBy(*by, "label")))
    top = r.where("_top").select(*by, "rank", "label", "importance")
    other = r.where("NOT _named").groupBy(*by).agg(F.sum(size).alias("importance")).where(F.col("importance") > 0)
    return top.unionByName(other.select(*by, F.lit(most + 1).alias("rank"), F.lit("Other").alias("label"), "importance"))
