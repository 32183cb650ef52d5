"""Pivot, unpivot and nesting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow.config import FIELDS


def pivot_fields(df: DataFrame, fields: Sequence[str] = FIELDS, keys: Sequence[str] = ("id_board", "_time"), tie: str = "seq") -> DataFrame:
    """One row per key with a column per field, last value (by ``tie``) of each.

    Conditional aggregates over a fixed field list: one pass, partial aggregation, no scan for the field names.
    """
    def cell(f: str) -> Column:
        hit = (F.col("_field") == f) & F.col("_value").isNotNull()
        return F.max_by("_value", F.when(hit, F.col(tie))).alias(f)
    return df.groupBy(*keys).agg(*[cell(f) for f in fields])


def melt(df: DataFrame, ids: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Columns to (_field, _value) rows, nulls included."""
    fields = list(fields or [c for c in df.columns if c not in ids])
    return df.unpivot(list(ids), fields, "_field", "_value")


def to_points(df: DataFrame, ids: Sequence[str] = ("id_board", "_time"), fields: Sequence[str] | None = None) -> DataFrame:
    """One point per non-null field."""
    fields = list(fields or [c for c in df.columns if c not in ids])
    return melt(df, ids, fields).where(F.col("_value").isNotNull())


def field_index(df: DataFrame, field: str = "_field", out: str = "table") -> DataFrame:
    """0-based number of each field in name order.

    Every row is numbered by counting smaller names in the set of distinct names, which travels as one short
    array per row of the distinct set; the set of field names is bounded by the schema.
    """
    names = df.select(field).distinct()
    numbered = names.agg(F.sort_array(F.collect_set(field)).alias("_all")).select(F.posexplode("_all").alias(out, field))
    return df.join(numbered, field)


def metric_matrix(reports: DataFrame, key: str, models: Sequence[str]) -> DataFrame:
    """Task x model: test value and a text with train and test value, N/A where there is none."""
    train = f"train_{key}"
    test = F.format_string("Te: %.3f", key)
    text = (F.when(F.col(train).isNotNull() & F.col(key).isNotNull(), F.format_string("Tr: %.3f / Te: %.3f", train, key))
            .when(F.col(key).isNotNull(), test).otherwise("N/A"))
    cells = reports.withColumn("_text", text).groupBy("task")
    aggs = []
    for m in models:
        here = F.col("model_name") == m
        aggs.append(F.max(F.when(here, F.col(key))).alias(m))
        aggs.append(F.coalesce(F.max(F.when(here, F.col("_text"))), F.lit("N/A")).alias(f"{m}_text"))
    return cells.agg(*aggs)


def summary(reports: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per task a map model -> metrics. A task holds a handful of models (the grid's names)."""
    entry = F.struct("model_name", F.struct(*metrics).alias("metrics"))
    one = reports.groupBy("task", "model_name").agg(*[F.max(m).alias(m) for m in metrics])
    return one.groupBy("task").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("details"))


def series(time: str, value: str, digits: int = 4) -> Column:
    """Ordered array of {timestamp, value}, for groups already cut to a bounded number of rows."""
    point = F.struct(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.bround(value, digits).alias("value"))
    return F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), point)))


def forecast_document(history: DataFrame, forecast: DataFrame, freq_min: int) -> DataFrame:
    """One nested document per board from the bounded history tail and the forecast steps.

    A blended forecast (columns forecast_env, forecast_auto, weight_env, weight_auto) also says what was blended, and how.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in ("leaf_temp", "air_temp", "humidity", "vpd") if c in df.columns]
        return df.groupBy("id_board").agg(F.struct(*[series("_time", c).alias(c) for c in cols]).alias(name))
    both = side(history, "historical").join(side(forecast, "forecast"), "id_board", "left")

    def pair(c: str) -> Column:
        return F.struct(F.col(f"historical.{c}").alias("historical"), F.col(f"forecast.{c}").alias("forecast"))
    out = both.select(
        "id_board", F.lit(f"{freq_min}m").alias("frequency"), pair("leaf_temp").alias("leaf_temperature"),
        F.struct(*[F.struct(F.col(f"{s}.air_temp").alias("air_temp"), F.col(f"{s}.humidity").alias("humidity")).alias(s)
                   for s in ("historical", "forecast")]).alias("environmental_data"),
        pair("vpd").alias("vpd"),
    )
    if "forecast_env" not in forecast.columns:
        return out
    weights = F.struct(F.max("weight_auto").alias("autoregressive"), F.max("weight_env").alias("environmental"))
    details = forecast.groupBy("id_board").agg(F.struct(
        weights.alias("weights"), series("_time", "forecast_env").alias("forecast_env"), series("_time", "forecast_auto").alias("forecast_auto")).alias("ensemble_details"))
    return out.join(details, "id_board", "left")


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack by column name; a column missing in one frame is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
