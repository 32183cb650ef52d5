"""Ordered operators: fills, lags, runs, splits and rules over series cut in slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import slicing as sl
from canopyflow.operators.slicing import SLICE, Slicing

MINUTE_US = 60_000_000
TIME = ("_time",)


def _us(c: str | Column) -> Column:
    return F.unix_micros(c)


def minutes_us(minutes: float) -> Column:
    return F.lit(int(round(minutes * MINUTE_US)))


def lag_features(df: DataFrame, slicing: Slicing, cols: Sequence[str], lags: int, freq_min: float, order: Sequence[str] = TIME) -> DataFrame:
    """Value i rows ago for i = 1..lags, null when that row is more than 1.5 * i steps away."""
    d = sl.row_halo(slicing.assign(df), slicing, order, before=lags)
    w = slicing.window(*order)
    age = _us(slicing.time)
    near = {i: (age - F.lag(age, i).over(w)) <= minutes_us(freq_min * i * C.GAP_FACTOR) for i in range(1, lags + 1)}
    made = [F.when(near[i], F.lag(c, i).over(w)).alias(f"{c}_lag_{i}") for c in cols for i in near]
    return sl.drop_halo(d.select("*", *made)).drop(SLICE)


def diff_features(df: DataFrame, slicing: Slicing, cols: Sequence[str], freq_min: float, order: Sequence[str] = TIME) -> DataFrame:
    """Forward-filled value minus the forward-filled value of the row before; null after a gap."""
    d = sl.known(df, slicing, order,
                 last={f"_now_{c}": F.col(c) for c in cols},
                 before={"_t0": F.col(slicing.time), **{f"_old_{c}": F.col(c) for c in cols}})
    near = (_us(slicing.time) - _us("_t0")) <= minutes_us(freq_min * C.GAP_FACTOR)
    return d.select(*df.columns, *[F.when(near, F.col(f"_now_{c}") - F.col(f"_old_{c}")).alias(f"{c}_diff") for c in cols])


def fill(df: DataFrame, slicing: Slicing, cols: Sequence[str], forward: bool = True, backward: bool = False, zero: bool = False,
         order: Sequence[str] = TIME) -> DataFrame:
    """Last known value, else the next one, else 0, as asked for."""
    d = sl.known(df, slicing, order,
                 last={f"_f_{c}": F.col(c) for c in cols} if forward else None,
                 following={f"_b_{c}": F.col(c) for c in cols} if backward else None)

    def filled(c: str) -> Column:
        parts = [F.col(c)] + [F.col(f"_{k}_{c}") for k, on in (("f", forward), ("b", backward)) if on]
        return F.coalesce(*parts, *([F.lit(0.0)] if zero else []))
    return d.select(*[filled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def spike_filter(df: DataFrame, slicing: Slicing, col: str = "tds", ratio: float = C.SPIKE_RATIO, when: Column | None = None,
                 order: Sequence[str] = TIME) -> DataFrame:
    """Null where a value leaves [median / ratio, median * ratio] of the rows around it (5 before to 4 after)."""
    before, after = C.SPIKE_ROWS_BEFORE, C.SPIKE_ROWS_AFTER
    d = sl.row_halo(slicing.assign(df), slicing, order, before, after)
    mid = F.percentile(F.col(col), F.lit(0.5)).over(slicing.window(*order).rowsBetween(-before, after))
    d = sl.drop_halo(d.withColumn("_mid", mid))
    spike = (F.col(col) > F.col("_mid") * ratio) | (F.col(col) < F.col("_mid") * (1 / ratio))
    if when is not None:
        spike = spike & when
    return d.withColumn(col, F.when(~F.coalesce(spike, F.lit(False)), F.col(col))).drop("_mid", SLICE)


def sessions(df: DataFrame, slicing: Slicing, gap_min: float = C.LEAF_BLOCK_GAP_MIN, order: Sequence[str] = TIME, out: str = "block_id") -> DataFrame:
    """0-based block number per series; a step longer than ``gap_min`` begins a new block."""
    d = slicing.assign(df)
    w = slicing.window(*order)
    t = _us(slicing.time)
    limit = minutes_us(gap_min)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_cut", F.when(t - F.lag(t).over(w) > limit, 1).otherwise(0))
    d = d.withColumn("_cuts", F.sum("_cut").over(upto))

    def scan(s: DataFrame) -> DataFrame:
        step = F.col("_first") - F.lag("_last").over(slicing._slices(F.col(SLICE).asc()))
        s = s.withColumn("_turn", F.when(step > limit, 1).otherwise(0))
        done = F.coalesce(F.sum(F.col("_inner") + F.col("_turn")).over(slicing.across()), F.lit(0))
        return s.select(*slicing.key, SLICE, (done + F.col("_turn")).alias("_blocks_in"))

    d = sl.link(d, slicing, {"_first": F.min(t), "_last": F.max(t), "_inner": F.sum("_cut")}, scan)
    return d.withColumn(out, F.col("_blocks_in") + F.col("_cuts")).drop("_cut", "_cuts", "_blocks_in", SLICE)


def leaf_weights(df: DataFrame, slicing: Slicing, col: str = C.TARGET, gap_min: float = C.LEAF_BLOCK_GAP_MIN, out: str = "leaf_weight",
                 order: Sequence[str] = TIME) -> DataFrame:
    """2 where the value steps or a block begins, 1 where it repeats the last known value or is missing."""
    d = sl.known(df, slicing, order, before={"_t0": F.col(slicing.time), "_v0": F.col(col)})
    new_block = F.col("_t0").isNull() | ((_us(slicing.time) - _us("_t0")) > minutes_us(gap_min))
    same = F.col(col) == F.col("_v0")
    weight = (F.when(F.col(col).isNull(), 1).when(new_block, 2).when(F.coalesce(same, F.lit(False)), 1).otherwise(2))
    return d.withColumn(out, weight).drop("_t0", "_v0")


def every_nth(df: DataFrame, slicing: Slicing, condition: Column, patience: int, order: Sequence[str]) -> DataFrame:
    """Rows at which ``condition`` has held for the n-th time since it failed or fired last.

    A row where the condition is null neither counts nor resets.
    """
    holds = F.coalesce(condition, F.lit(False))
    d = sl.run_position(df, slicing, order, holds, breaks=~condition)
    return d.where(holds & (F.col("run_pos") % patience == 0)).drop("run_pos")


def moisture_alerts(df: DataFrame, slicing: Slicing, col: str = "soil_moisture", threshold: float = C.SOIL_LOW, patience: int = C.SOIL_PATIENCE,
                    order: Sequence[str] = ("_time", "seq")) -> DataFrame:
    """The pump command fired by every fifth low reading in a row."""
    act, val, dur = C.PUMP
    fired = every_nth(df, slicing, F.col(col) < threshold, patience, order)
    return fired.select(*slicing.key, *order, F.col(col), F.lit(act).alias("act"), F.lit(val).alias("val"), F.lit(dur).alias("dur"))


def apply_fallback(df: DataFrame, slicing: Slicing, leaf: str = C.TARGET, temp: str = "temp", reading: str = "reading_id",
                   uses: int = C.READING_USES, order: Sequence[str] = ("_time", "seq")) -> DataFrame:
    """Replace a missing or implausible leaf temperature by the operator's reading, at most ``uses`` times per reading.

    Adds ``use_no`` (1-based use of the reading, null where none is needed), ``leaf_source`` and the alert level.
    A reading that comes back after another one counts from the start. Once used up, the value stays as it was;
    an implausible value without any reading to replace it is cleared.
    """
    needs = F.col(leaf).isNull() | (F.col(leaf) < C.LEAF_MIN_VALID)
    attempt = needs & F.col(reading).isNotNull()
    tries = sl.run_position(df.where(attempt), slicing, order, F.lit(True), changes=F.col(reading), out="use_no")
    rest = df.where(~attempt).withColumn("use_no", F.lit(None).cast("long"))
    d = tries.unionByName(rest)
    used, spent = F.col("use_no") <= uses, F.col("use_no") > uses
    source = (F.when(used, "reading").when(spent, "exhausted").when(needs, "none").otherwise("sensor"))
    return d.withColumns({
        "leaf_source": source,
        "alert_level": alert_level(F.col("use_no"), uses),
        leaf: F.when(used, F.col(temp)).when(source != "none", F.col(leaf)),
    })


def alert_level(use_no: Column, uses: int = C.READING_USES) -> Column:
    """1, 2, 3 at the first, seventh and thirteenth use, 5 once the reading is used up."""
    done = use_no - 1
    return (F.when(use_no > uses, C.EXHAUSTED_ALERT)
            .when(done % C.ALERT_EVERY == 0, (done / C.ALERT_EVERY).cast("int") + 1))


def fallback_alerts(df: DataFrame) -> DataFrame:
    return df.where(F.col("alert_level").isNotNull())


def topology_changes(df: DataFrame, slicing: Slicing, hub: str = "star_id", order: Sequence[str] = ("_time", "seq")) -> DataFrame:
    """Rows at which a node reports another hub than before (its first row included)."""
    d = sl.known(df, slicing, order, before={"previous": F.struct(F.col(hub).alias("hub"))})
    d = d.withColumn("previous", F.col("previous.hub"))
    return d.where(~F.col(hub).eqNullSafe(F.col("previous")))


def fraction_split(df: DataFrame, slicing: Slicing, share: float = C.TRAIN_SHARE, order: Sequence[str] = TIME) -> DataFrame:
    """The first int(share * n) rows of each series are training rows."""
    d = sl.ranked(df, slicing, order, "_rank", "_count")
    return d.withColumn("is_train", F.col("_rank") <= F.floor(F.col("_count") * share)).drop("_rank", "_count")


def ts_folds(df: DataFrame, slicing: Slicing, folds: int, order: Sequence[str] = ("_time", "id_board")) -> DataFrame:
    """Expanding folds over the global time order: one row per row and fold it takes part in.

    Test blocks hold n // (k + 1) rows at the end, everything before a block trains for it.
    """
    d = sl.ranked(df, slicing, order, "_rank", "_count")
    block = F.floor(F.col("_count") / (folds + 1))
    begins = [F.col("_count") - block * (folds - i) for i in range(folds)]
    roles = F.array(*[
        F.struct(F.lit(i).alias("fold"),
                 F.when(F.col("_rank") <= b, F.lit("train")).when(F.col("_rank") <= b + block, F.lit("test")).alias("role"))
        for i, b in enumerate(begins)])
    return d.select(*df.columns, F.inline(roles).alias("fold", "role")).where(F.col("role").isNotNull())


def _ends() -> dict:
    return {"_lo": (F.min("_time"), F.min), "_hi": (F.max("_time"), F.max)}


def _grid_marks(df: DataFrame, slicing: Slicing, cols: Sequence[str]) -> DataFrame:
    """Nearest known value on both sides of each grid row, and the ends of its series."""
    def seen(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_time").alias("t"), F.col(c).alias("v")))
    return sl.known(df, slicing, TIME, before={f"_p_{c}": seen(c) for c in cols}, after={f"_n_{c}": seen(c) for c in cols}, totals=_ends())


def _run(c: str, minutes: int) -> Column:
    """Nulls in the run a null grid row belongs to."""
    step = F.lit(minutes * MINUTE_US)
    begin = F.coalesce(_us(F.col(f"_p_{c}.t")), _us("_lo") - step)
    end = F.coalesce(_us(F.col(f"_n_{c}.t")), _us("_hi") + step)
    return F.call_function("div", end - begin, step) - 1


def gap_size(df: DataFrame, slicing: Slicing, col: str, minutes: int) -> DataFrame:
    """Length in grid steps of the null run a row belongs to, 0 for a known value."""
    d = _grid_marks(df, slicing, [col])
    return d.select(*df.columns, F.when(F.col(col).isNull(), _run(col, minutes)).otherwise(F.lit(0)).cast("long").alias("gap"))


def interpolate(df: DataFrame, slicing: Slicing, cols: Sequence[str], minutes: int, cap: int | None = None) -> DataFrame:
    """Linear on grid steps for null runs of at most ``cap`` steps; a leading run stays null, a trailing one repeats."""
    cap = max(1, int(C.FILL_CAP_MIN / minutes)) if cap is None else cap
    d = _grid_marks(df, slicing, cols)

    def filled(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        share = (_us("_time") - _us(p["t"])) / (_us(n["t"]) - _us(p["t"]))
        line = F.when(n.isNull(), p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * share)
        return F.when(F.col(c).isNotNull(), F.col(c)).when(_run(c, minutes) <= cap, line)
    return d.select(*[filled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def range_rules(df: DataFrame, when: Column | None = None, water_min: float = C.WATER_MIN, tds_min: float = C.TDS_MIN) -> DataFrame:
    """Implausibly cold water and low dissolved solids become missing."""
    on = F.lit(True) if when is None else when
    rules = {c: F.when(~((F.col(c) < low) & on), F.col(c)) for c, low in (("water_temp", water_min), ("tds", tds_min)) if c in df.columns}
    return df.withColumns(rules)


def future_grid(df: DataFrame, freq_min: int, steps: int, key: str = "id_board") -> DataFrame:
    """The next ``steps`` stamps after each board's newest row."""
    last = df.groupBy(key).agg(F.max("_time").alias("_last"))
    step = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    return last.select(key, "_last", step).select(
        key, "step", F.timestamp_micros(_us("_last") + F.col("step").cast("long") * F.lit(freq_min * MINUTE_US)).alias("_time"))


def horizon(df: DataFrame, hours: float = 2.0, keys: Sequence[str] = ("id_board",)) -> DataFrame:
    """Points up to ``hours`` after each series' first one."""
    first = df.groupBy(*keys).agg(F.min("_time").alias("_first"))
    j = df.join(first, list(keys))
    return j.where(_us("_time") <= _us("_first") + minutes_us(hours * 60)).drop("_first")
