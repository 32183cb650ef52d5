"""Raw series to a clean, evenly spaced table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import sequence as seq
from canopyflow.operators import slicing as sl
from canopyflow.operators.aggregates import max_time, resample
from canopyflow.operators.filters import filter_fields
from canopyflow.operators.gaussfill import gaussian_fill
from canopyflow.operators.reshape import pivot_fields, to_points
from canopyflow.session import materialise
from canopyflow.sources import tables

TDS_FLOOR, LEAF_STEPS, LEAF_FILL, ANOMALIES = "tds_floor", "leaf_steps", "leaf_fill", "anomalies"
#: the steps in order, as boards run them that are not named
ALL_STEPS = (TDS_FLOOR, LEAF_STEPS, LEAF_FILL, ANOMALIES)
#: what is given for boards that run fewer of them
Steps = Mapping[str, Sequence[str]]


def step_condition(step: str, steps: Steps) -> Column:
    """Whether a row's board runs a step; boards that are not named run them all."""
    without = [b for b, names in steps.items() if step not in names]
    return ~F.coalesce(F.col("id_board").isin(without), F.lit(False)) if without else F.lit(True)


def clean_series(df: DataFrame, slicing: sl.Slicing, steps: Steps = MappingProxyType({}),
                 cap_min: float = C.FILL_CAP_MIN, sigma_min: float = C.FILL_SIGMA_MIN) -> DataFrame:
    """Run every board's steps in one plan over all boards.

    Steps on different columns do not see each other, so their fills share one pass; the conductivity spikes are
    looked for after its first fill, which needs a second pass. Boards differ by a condition, not by a plan.
    """
    on = {s: step_condition(s, steps) for s in (TDS_FLOOR, LEAF_STEPS, LEAF_FILL, ANOMALIES)}
    low_tds = (F.col("tds") < C.TDS_MIN) & on[TDS_FLOOR]
    cold = (F.col("water_temp") < C.WATER_MIN) & on[ANOMALIES]
    d = df.withColumns({"tds": F.when(~F.coalesce(low_tds, F.lit(False)), F.col("tds")),
                        "water_temp": F.when(~F.coalesce(cold, F.lit(False)), F.col("water_temp"))})
    d = materialise(seq.leaf_weights(d, slicing))
    weight = F.when(on[LEAF_STEPS], F.col("leaf_weight")).otherwise(F.lit(1))
    d = gaussian_fill(d, slicing, {"tds": None, "leaf_temp": weight, "water_temp": None}, cap_min, sigma_min,
                      {"tds": on[TDS_FLOOR], "leaf_temp": on[LEAF_FILL], "water_temp": on[ANOMALIES]})
    d = materialise(d.drop("leaf_weight"))
    d = materialise(seq.spike_filter(d, slicing, "tds", when=on[ANOMALIES]))
    return gaussian_fill(d, slicing, {"tds": None}, cap_min, sigma_min, {"tds": on[ANOMALIES]})


def clean_grid(wide: DataFrame, slicing: sl.Slicing, freq_min: int = C.FREQ_MIN, steps: Steps = MappingProxyType({}),
               fields: Sequence[str] = C.FIELDS) -> DataFrame:
    """Cleaned, resampled to the grid and linearly filled over short gaps; rows without any value are left out."""
    fields = [f for f in fields if f in wide.columns]
    d = clean_series(wide.select("id_board", "_time", *fields), slicing, steps)
    g = materialise(resample(d, fields, freq_min))
    out = seq.interpolate(g, sl.fit(g, ["id_board"]), fields, freq_min)
    return materialise(out.na.drop("all", subset=fields))


def sync_clean(raw: DataFrame, clean: DataFrame, freq_min: int = C.FREQ_MIN, steps: Steps = MappingProxyType({}),
               global_watermark: bool = False, halo_min: int = C.OVERLAP_MIN) -> DataFrame:
    """New clean points: raw points from an hour before the newest clean stamp, cleaned, newer than that stamp.

    The stamp is each board's own; ``global_watermark`` takes one for all boards, which drops late rows of a lagging
    board. ``halo_min`` is how much context before the stamp the fills see. A board without clean points is done whole.
    """
    stored = filter_fields(clean, "pred", negate=True)
    marks = max_time(stored, [] if global_watermark else ["id_board"])
    if global_watermark:
        near = raw.crossJoin(F.broadcast(marks))  # one row
    else:
        near = raw.join(marks, "id_board", "left")
    back = F.expr(f"INTERVAL {halo_min} MINUTES")
    near = near.where(F.col("max_time").isNull() | (F.col("_time") >= F.col("max_time") - back))
    near = unify_points(near)
    keys = ["id_board", "_time", "max_time"]
    wide = materialise(pivot_fields(near, C.FIELDS, keys))
    done = clean_grid(wide.drop("max_time"), sl.fit(wide, ["id_board"]), freq_min, steps)
    per_board = wide.groupBy("id_board").agg(F.first("max_time").alias("max_time"))
    fresh = done.join(per_board, "id_board").where(F.col("max_time").isNull() | (F.col("_time") > F.col("max_time")))
    points = to_points(fresh.drop("max_time"))
    return tables.as_points(points.withColumn("seq", F.unix_micros("_time")))


def unify_points(points: DataFrame, aliases: Mapping[str, str] = C.FIELD_ALIASES) -> DataFrame:
    """Field names of long points under their stored spelling; a stored name wins over its alias at the same time."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    alias = known[F.col("_field")]
    # the pivot keeps the greatest seq, so an aliased point steps behind every point with the stored name
    return points.withColumns({"_field": F.coalesce(alias, F.col("_field")),
                               "seq": F.when(alias.isNotNull(), F.col("seq") - F.lit(1 << 62)).otherwise(F.col("seq"))})


