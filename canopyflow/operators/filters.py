"""Projections, filters and predicates. All are narrow: no shuffle, except the per-key ones named so."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflow.config import COMMAND_DURATION_MAX, COMMAND_VALUE_MAX, FIELD_ALIASES, FIELDS, PACKET_BYTES


def time_bounds(anchor: datetime, lookback: timedelta | None) -> tuple[datetime, datetime]:
    """[anchor - lookback, anchor); no lookback means since the epoch. The anchor is given, never the clock."""
    start = datetime(1970, 1, 1) if lookback is None else anchor - lookback
    return start, anchor


def scan_points(df: DataFrame, start: datetime | Column | None = None, stop: datetime | Column | None = None, time: str = "_time") -> DataFrame:
    """start <= time < stop; literal bounds are pushed into the Parquet scan."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
    if stop is not None:
        df = df.where(F.col(time) < F.lit(stop))
    return df


def unify_aliases(df: DataFrame, aliases: Mapping[str, str] = FIELD_ALIASES) -> DataFrame:
    """Stored name where it has a value, else the alternative spelling; the latter is dropped."""
    have = [a for a in aliases if a in df.columns]
    if not have:
        return df
    new = {aliases[a]: F.coalesce(*[F.col(c) for c in (aliases[a], a) if c in df.columns]) for a in have}
    keep = [F.col(c) for c in df.columns if c not in have and c not in new]
    return df.select(*keep, *[c.alias(n) for n, c in new.items()])


def filter_fields(df: DataFrame, pattern: str, negate: bool = False, field: str = "_field") -> DataFrame:
    hit = F.col(field).rlike(pattern)
    return df.where(~hit if negate else hit)


def filter_tag(df: DataFrame, tag: str, value: str) -> DataFrame:
    return df.where(F.col(tag) == F.lit(value))


def keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def isolate(df: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame | None, list[str]]:
    """The wanted columns that exist, and the names that do not; no frame when the target is missing."""
    wanted = [*features, target]
    missing = [c for c in wanted if c not in df.columns]
    if target in missing:
        return None, missing
    other = [c for c in ("id_board", "_time") if c in df.columns]
    return df.select(*other, *[c for c in wanted if c not in missing]), missing


def numeric_fields(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Text to number for the known fields; what is no number, or NaN, is missing."""
    def num(c: str) -> Column:
        v = F.col(c).try_cast("double")
        return F.when(~F.isnan(v), v)
    return df.select(*[num(c).alias(c) if c in fields else F.col(c) for c in df.columns])


def required(col: str) -> Column:
    """False for a missing, empty or zero key."""
    text = F.col(col).cast("string")
    return F.coalesce((text != "") & (text != "0"), F.lit(False))


def require(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows."""
    ok = required(col)
    return df.where(ok), df.where(~ok)


def valid_packets(df: DataFrame, data: str = "data") -> DataFrame:
    """Full-size packets that carry a time or a node: an all-zero head is a hub without data."""
    head = F.hex(F.substring(F.col(data), 1, 8))
    return df.where((F.octet_length(data) == PACKET_BYTES) & (head != "0" * 16))


def split_sync(df: DataFrame, flag: str = "sync") -> tuple[DataFrame, DataFrame]:
    """(telemetry, clock requests): a set flag marks a request, which is answered and not stored."""
    is_sync = required(flag)
    return df.where(~is_sync), df.where(is_sync)


def with_indoor(df: DataFrame, places: Mapping[str, int]) -> DataFrame:
    """1 for boards that stand indoors, by ``places``; 0 for all others."""
    if not places:
        return df.withColumn("is_indoor", F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])
    return df.withColumn("is_indoor", F.coalesce(F.element_at(table, F.col("id_board")), F.lit(0)))


def drop_nulls(df: DataFrame, subset: Sequence[str], how: str = "any") -> DataFrame:
    return df.na.drop(how, subset=list(subset))


def dedupe_last(df: DataFrame, key: Sequence[str], tie: str) -> DataFrame:
    """The row with the greatest ``tie`` per key. A partial aggregate: copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.col(tie))
    return df.groupBy(*key).agg(best.alias("_b")).select(*[F.col(c) if c in key else F.col("_b")[c].alias(c) for c in df.columns])


def override_latest(df: DataFrame, values: Mapping[str, float | None], key: str = "id_board", time: str = "_time") -> DataFrame:
    """Given, non-null values replace the columns of each board's newest row; unknown names are ignored."""
    newest = df.groupBy(key).agg(F.max(time).alias("_newest"))
    hit = F.col(time) == F.col("_newest")
    given = {n: v for n, v in values.items() if v is not None and n in df.columns}
    j = df.join(newest, key)
    return j.select(*[F.when(hit, F.lit(float(given[c]))).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in df.columns])


def round_cols(df: DataFrame, cols: Sequence[str], digits: int) -> DataFrame:
    return df.select(*[F.bround(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _clamp(c: Column, top: int) -> Column:
    v = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.when(F.isnan(v), F.lit(0.0)).otherwise(v)))


def clamp_command(df: DataFrame, value: str = "value", duration: str = "duration_s") -> DataFrame:
    """Value in [0, 255], duration in [0, 300]; what is no number counts as 0."""
    return df.withColumns({value: _clamp(F.col(value), COMMAND_VALUE_MAX), duration: _clamp(F.col(duration), COMMAND_DURATION_MAX)})


def active_boards(df: DataFrame, boards: Sequence[str]) -> DataFrame:
    return df.where(F.col("id_board").isin(list(boards)))


def tail(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest n rows per group. Spark keeps n rows per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_per(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key, as a partial aggregate."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_b")).select(*[F.col(c) if c in key else F.col("_b")[c].alias(c) for c in df.columns])
