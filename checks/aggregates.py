"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyflow.operators import aggregates as agg
from canopyflow.operators import reshape, slicing
from canopyflow.sources import events
from checks.basics import r
from checks.registry import query
from checks.scans import us

MIN = 60_000_000


@query("window_mean", f"""SELECT id_board, _field, least((epoch_us(_time) // {30 * MIN} + 1) * {30 * MIN}, epoch_us(TIMESTAMP '2024-01-30 23:50:00')) AS t_us, round(avg(_value), 9) AS _value
FROM points GROUP BY ALL""", "points")
def window_mean(spark, sf):
    d = agg.window_mean(events.points(spark, sf), 30, stop=F.lit("2024-01-30 23:50:00").cast("timestamp"))
    return d.select("id_board", "_field", us(), r("_value").alias("_value"))


@query("watermark_per_board", "SELECT id_board, epoch_us(max(_time)) AS t_us FROM points GROUP BY 1", "points")
def watermark_per_board(spark, sf):
    return agg.max_time(events.points(spark, sf), ["id_board"]).select("id_board", us("max_time"))


@query("last_per_series", "SELECT id_board, _field, epoch_us(max(_time)) AS t_us, arg_max(_value, _time) AS _value FROM points WHERE _value IS NOT NULL GROUP BY 1, 2", "points")
def last_per_series(spark, sf):
    return agg.last_per_series(events.points(spark, sf)).select("id_board", "_field", us(), "_value")


@query("tag_values", "SELECT DISTINCT id_board FROM points", "points")
def tag_values(spark, sf):
    return agg.tag_values(events.points(spark, sf), "id_board")


@query("burst_median", """SELECT node_id, hour_us, list_sort(list(value))[CAST(floor(count(value) / 2) AS BIGINT) + 1] AS median, count(value) AS samples
FROM (SELECT node_id, epoch_us(date_trunc('hour', _time)) AS hour_us, value FROM packets) GROUP BY 1, 2""", "packets")
def burst_median(spark, sf):
    p = events.packets(spark, sf).select("node_id", F.unix_micros(F.date_trunc("hour", "_time")).alias("hour_us"), "value")
    return agg.burst_median(p, ["node_id", "hour_us"], "value")


@query("regression_metrics", """SELECT event_type, round(avg(abs(value - k)), 9) AS MAE, round(sqrt(avg((value - k) * (value - k))), 9) AS RMSE,
 round(1 - sum((value - k) * (value - k)) / (count(*) * var_pop(value)), 9) AS R_squared, count(*) AS n FROM ev GROUP BY 1""")
def regression_metrics(spark, sf):
    d = agg.regression_metrics(events.events(spark, sf), "value", "k", ["event_type"])
    return d.select("event_type", *[r(c).alias(c) for c in ("MAE", "RMSE", "R_squared")], "n")


@query("sufficiency_gate", """SELECT id_board, count(tds) AS rows, count(DISTINCT tds) AS distinct_values, count(tds) >= 100 AND count(DISTINCT tds) > 1 AS enough
FROM wide WHERE tds IS NOT NULL GROUP BY 1""", "wide")
def sufficiency_gate(spark, sf):
    return agg.gate(events.wide(spark, sf), "tds", 100)


@query("quantile_split", """SELECT seq, _field, epoch_us(_time) <= split AS is_train FROM points JOIN (
 SELECT _field, lo + (hi - lo) * (pos - floor(pos)) AS split FROM (
 SELECT _field, any_value(0.8 * (n - 1)) AS pos, min(t) AS lo, max(t) AS hi FROM (
 SELECT _field, epoch_us(_time) AS t, row_number() OVER (PARTITION BY _field ORDER BY _time, seq) AS rn, count(*) OVER (PARTITION BY _field) AS n FROM points)
 WHERE rn BETWEEN floor(0.8 * (n - 1)) + 1 AND floor(0.8 * (n - 1)) + 2 GROUP BY _field)) USING (_field)""", "points")
def quantile_split(spark, sf):
    p = events.points(spark, sf)
    s = slicing.fit(p, ["_field"])
    return agg.quantile_split(p, s, order=["_time", "seq"]).select("seq", "_field", "is_train")


def reports(spark, sf):
    e = events.events(spark, sf)
    return e.groupBy(F.col("event_type").alias("task"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_name")).agg(
        F.avg("value").alias("MAE"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("RMSE"), F.avg("k").alias("train_MAE"))


def importances(spark, sf):
    e = events.events(spark, sf)
    return e.groupBy(F.col("event_type").alias("task"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_name"),
                     F.concat(F.lit("poly__reading_"), (F.col("k").cast("long") % 17).cast("string")).alias("feature")).agg(
        (F.avg("value") - 24).alias("importance"))


@query("best_model", "SELECT task, arg_min(model_name, {'m': MAE, 'n': model_name}) AS best_model, round(min(MAE), 9) AS MAE FROM reports GROUP BY 1", "reports")
def best_model(spark, sf):
    return agg.best_model(reports(spark, sf)).select("task", "best_model", r("MAE").alias("MAE"))


@query("rank_features", """SELECT task, model_name, feature, round(importance, 9) AS importance, CAST(row_number() OVER (PARTITION BY task, model_name ORDER BY abs(importance) DESC, feature) AS INT) AS rank FROM importances""", "importances")
def rank_features(spark, sf):
    return agg.rank_features(importances(spark, sf)).withColumn("importance", r("importance"))


@query("top_features", """SELECT task, model_name, CAST(rank AS INT) AS rank, replace(feature, 'poly__', '') AS label, round(importance, 9) AS importance FROM ranked WHERE before < 0.75 AND rank <= 10
UNION ALL SELECT task, model_name, 11, 'Other', round(sum(abs(importance)), 9) FROM ranked WHERE NOT (before < 0.75 AND rank <= 10) GROUP BY 1, 2 HAVING sum(abs(importance)) > 0""", "importances",
       """ranked AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY task, model_name ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
 SELECT *, row_number() OVER (PARTITION BY task, model_name ORDER BY abs(importance) DESC, feature) AS rank, abs(importance) / sum(abs(importance)) OVER (PARTITION BY task, model_name) AS share FROM importances))""")
def top_features(spark, sf):
    return agg.top_features(importances(spark, sf)).withColumn("importance", r("importance"))


_MODELS = [f"m{i}" for i in range(6)]


@query("metric_matrix", "SELECT task, " + ", ".join(
    f"round(max(MAE) FILTER (WHERE model_name = '{m}'), 9) AS {m}, coalesce(max('Tr: ' || printf('%.3f', round(train_MAE, 3)) || ' / Te: ' || printf('%.3f', round(MAE, 3))) FILTER (WHERE model_name = '{m}'), 'N/A') AS {m}_text"
    for m in _MODELS) + " FROM reports GROUP BY task", "reports")
def metric_matrix(spark, sf):
    d = reshape.metric_matrix(reports(spark, sf), "MAE", _MODELS)
    return d.select("task", *[c for m in _MODELS for c in (r(m).alias(m), F.col(f"{m}_text"))])


_SHOWN = ("MAE", "RMSE", "train_MAE")


@query("nested_summary", f"""SELECT task, count(*) AS models, string_agg(model_name || '=' || {" || '/' || ".join(f"printf('%.3f', round({m}, 3))" for m in _SHOWN)}, ',' ORDER BY model_name) AS text
FROM reports GROUP BY 1""", "reports")
def nested_summary(spark, sf):
    d = reshape.summary(reports(spark, sf), _SHOWN)
    text = lambda e: F.concat_ws("/", *[F.format_string("%.3f", e["value"][m]) for m in _SHOWN])
    pairs = F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), text(e)))
    return d.select("task", F.size("details").cast("long").alias("models"), F.array_join(pairs, ",").alias("text"))
