"""Parsers of operator input and labels of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow.config import COMMAND_VALUE_MAX, ENV_FEATURES

# fixed values: label rules
LABEL_PREFIXES = ("remainder__", "poly__", "regressor__")
LABEL_MAX = 30
PARAMS_MAX = 120
ACTUATOR_MAX = 4
_LEADING_NUMBER = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def number(text: Column) -> Column:
    """A number with a decimal point or comma; null when the text is no number."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def leading_number(text: Column) -> Column:
    """The number a text begins with (decimal point or comma), null when it begins with none."""
    dotted = F.regexp_replace(text, "^([^,]*),", "$1.")  # only the first comma is a decimal mark
    return F.regexp_extract(dotted, _LEADING_NUMBER, 1).try_cast("double")


def parse_fallback(df: DataFrame, line: str = "line") -> DataFrame:
    """``board/temp/id`` lines to board, temp, reading_id; ``ok`` is false for any other line."""
    parts = F.split(F.rtrim(line), "/", -1)
    ok = F.size(parts) == 3
    return df.select(
        "*", ok.alias("ok"),
        F.when(ok, parts[0]).alias("board"),
        F.when(ok, leading_number(parts[1])).alias("temp"),
        F.when(ok, F.trim(parts[2])).alias("reading_id"),
    )


def parse_values(df: DataFrame, line: str = "line", names: list[str] = ENV_FEATURES) -> DataFrame:
    """White-space separated numbers, one per name; ``ok`` is false unless all are there."""
    parts = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    values = F.transform(parts, number)
    ok = (F.size(parts) == len(names)) & F.forall(values, lambda v: v.isNotNull())
    return df.select("*", ok.alias("ok"), *[F.when(ok, F.get(values, F.lit(i))).alias(n) for i, n in enumerate(names)])


def parse_action(df: DataFrame, line: str = "line") -> DataFrame:
    """``actuator value duration`` to act, val, dur; ``ok`` is false when a rule is broken."""
    parts = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    act = F.lower(F.get(parts, F.lit(0)))
    val, dur = (F.when(F.get(parts, F.lit(i)).rlike(r"^[-+]?\d+$"), F.get(parts, F.lit(i)).try_cast("int")) for i in (1, 2))
    ok = F.coalesce(
        (F.size(parts) == 3) & (F.length(act) <= ACTUATOR_MAX) & val.between(0, COMMAND_VALUE_MAX) & (dur >= 0), F.lit(False))
    return df.select("*", ok.alias("ok"), F.when(ok, act).alias("act"), F.when(ok, val).alias("val"), F.when(ok, dur).alias("dur"))


def _shorten(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def feature_label(name: Column) -> Column:
    for p in LABEL_PREFIXES:
        name = F.replace(name, F.lit(p), F.lit(""))
    return _shorten(name, LABEL_MAX)


def params_text(params: Column) -> Column:
    """A parameter map as ``name:value`` text, name without its step prefix, cut to the table width."""
    pairs = F.transform(
        F.map_entries(params),
        lambda e: F.concat_ws(":", F.element_at(F.split(e["key"], "__"), -1), e["value"]),
    )
    return _shorten(F.array_join(pairs, ", "), PARAMS_MAX)
