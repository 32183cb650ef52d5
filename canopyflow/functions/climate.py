"""Vapour pressure, cyclic time, time zones and stamps as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow.config import LEAF_PHYSICAL_MIN, LOCAL_ZONE


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def saturation_pressure(t: str | Column) -> Column:
    """Magnus form, kPa."""
    t = _col(t)
    return F.lit(0.61078) * F.exp(F.lit(17.27) * t / (t + F.lit(237.3)))


def vpd(leaf: str | Column, air: str | Column, rh: str | Column) -> Column:
    """Vapour-pressure deficit for scoring: never negative, 0 when it cannot be computed."""
    d = saturation_pressure(leaf) - saturation_pressure(air) * (_col(rh) / 100.0)
    return F.when(d.isNotNull() & ~F.isnan(d) & (d > 0), d).otherwise(F.lit(0.0))


def _floor_zero(d: Column) -> Column:
    """max(0, d) that keeps a missing value missing."""
    return F.when(d.isNull() | F.isnan(d), F.lit(None).cast("double")).when(d > 0, d).otherwise(F.lit(0.0))


def with_vpd(df: DataFrame) -> DataFrame:
    """Add vpd_air, vpd_leaf and vpd (and the _pred variants) where their inputs exist."""
    have, new = set(df.columns), {}
    for tail in ("", "_pred"):
        air, rh, leaf = f"air_temp{tail}", f"humidity{tail}", f"leaf_temp{tail}"
        if not {air, rh} <= have:
            continue
        actual = saturation_pressure(air) * (F.col(rh) / 100.0)
        new[f"vpd_air{tail}"] = _floor_zero(saturation_pressure(air) - actual)
        if leaf in have:
            new[f"vpd_leaf{tail}"] = F.when(
                (F.col(leaf) > LEAF_PHYSICAL_MIN) & ~F.isnan(leaf), _floor_zero(saturation_pressure(leaf) - actual))
        if not tail:
            new["vpd"] = new.get("vpd_leaf", new["vpd_air"])
    return df.select(*[c for c in df.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def vpd_air_forecast(air: str | Column, rh: str | Column) -> Column:
    """Deficit of the air alone for a forecast pair, 4 decimals."""
    d = saturation_pressure(air) * (F.lit(1.0) - _col(rh) / 100.0)
    return F.round(F.when(d > 0, d).when(d.isNotNull(), F.lit(0.0)), 4)


def time_features(time: str | Column = "_time") -> dict[str, Column]:
    """Minute of day on the unit circle."""
    minute = F.hour(time) * 60 + F.minute(time)
    angle = F.lit(2 * math.pi) * minute / F.lit(1440.0)
    return {"time_sin": F.sin(angle), "time_cos": F.cos(angle)}


def to_local(time: str | Column = "_time", zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(_col(time), zone)


def iso(time: str | Column = "_time") -> Column:
    """RFC 3339 with whole seconds."""
    return F.date_format(_col(time), "yyyy-MM-dd'T'HH:mm:ss'Z'")
