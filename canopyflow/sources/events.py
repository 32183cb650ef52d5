"""Telemetry views over the ``events`` table.

``events`` is an entity-attribute-value stream: the event type names the field, ``value`` is its reading and
``props.k`` a second reading that is taken as soil moisture. Every view covers the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.config import FIELDS
from canopyflow.operators import slicing
from canopyflow.session import prepare

# fixed values: event type -> field
EVENT_FIELDS = {"view": "air_temp", "click": "humidity", "purchase": "tds", "signup": "leaf_temp", "error": "water_temp"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, event_type, value, k."""
    raw = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def board(user: str = "user_id"):
    return F.concat(F.lit("b"), (F.col(user) % 2).cast("string"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long points: seq, id_board, _time, _field, _value (two readings per event)."""
    e = events(spark, sf_dir)
    names = F.create_map(*[F.lit(x) for kv in EVENT_FIELDS.items() for x in kv])
    readings = F.array(
        F.struct(names[F.col("event_type")].alias("_field"), F.col("value").alias("_value")),
        F.struct(F.lit("soil_moisture").alias("_field"), F.col("k").alias("_value")),
    )
    return e.select(
        F.col("event_id").alias("seq"), board().alias("id_board"), F.col("ts").alias("_time"),
        F.inline(readings).alias("_field", "_value"),
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per board and time with a column per field.

    A point carries its own field name, so the pivot is a conditional aggregate over the two readings of an
    event: no row is duplicated before the shuffle.
    """
    e = events(spark, sf_dir)
    aggs = []
    for f in FIELDS:
        src = next((t for t, n in EVENT_FIELDS.items() if n == f), None)
        if f == "soil_moisture":
            aggs.append(F.max_by("k", F.when(F.col("k").isNotNull(), F.col("event_id"))).alias(f))
        elif src:
            hit = (F.col("event_type") == src) & F.col("value").isNotNull()
            aggs.append(F.max_by("value", F.when(hit, F.col("event_id"))).alias(f))
    out = e.groupBy(board().alias("id_board"), F.col("ts").alias("_time")).agg(*aggs)
    return out.select("id_board", "_time", *[
        F.col(f) if f in out.columns else F.lit(None).cast("double").alias(f) for f in FIELDS])


def board_slices(spark: SparkSession, sf_dir: str, max_rows: int | None = None) -> slicing.Slicing:
    """Slices of the board series, measured on the scan (an upper bound of the pivoted rows)."""
    e = events(spark, sf_dir).select(board().alias("id_board"), F.col("ts").alias("_time"))
    return slicing.fit(e, ["id_board"], "_time", max_rows)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event: seq, node_id, star_id, _time and the reading."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.concat(F.lit("n"), (F.col("user_id") % 20).cast("string")).alias("node_id"),
        F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("star_id"),
        F.col("ts").alias("_time"), "event_type", "value", "k",
    )


def node_slices(spark: SparkSession, sf_dir: str, max_rows: int | None = None) -> slicing.Slicing:
    return slicing.fit(packets(spark, sf_dir), ["node_id"], "_time", max_rows)
