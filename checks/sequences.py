"""Ordered operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import aggregates as agg
from canopyflow.operators import filters, slicing
from canopyflow.operators import joins
from canopyflow.operators import sequence as seq
from canopyflow.plans import history
from canopyflow.session import materialise
from canopyflow.sources import events
from checks.basics import r
from checks.registry import query
from checks.scans import us

MIN = 60_000_000
W = "WINDOW w AS (PARTITION BY id_board ORDER BY _time)"
UPTO = "(PARTITION BY id_board ORDER BY _time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = "(PARTITION BY id_board ORDER BY _time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
FROM = "(PARTITION BY id_board ORDER BY _time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

_LAGS = ",\n ".join(
    f"CASE WHEN epoch_us(_time) - lag(epoch_us(_time), {i}) OVER w <= {i * 9 * MIN} THEN lag({c}, {i}) OVER w END AS {c}_lag_{i}"
    for c in ("air_temp", "soil_moisture") for i in range(1, 7))


@query("lag_features", f"SELECT id_board, epoch_us(_time) AS t_us, {_LAGS} FROM wide {W}", "wide")
def lag_features(spark, sf):
    w = events.wide(spark, sf).select("id_board", "_time", "air_temp", "soil_moisture")
    d = seq.lag_features(w, events.board_slices(spark, sf), ["air_temp", "soil_moisture"], 6, 6)
    return d.withColumn("t_us", F.unix_micros("_time")).drop("_time", "air_temp", "soil_moisture")


def _diff(c: str) -> str:
    return (f"CASE WHEN epoch_us(_time) - lag(epoch_us(_time)) OVER w <= 9 * {MIN} THEN round("
            f"last_value({c} IGNORE NULLS) OVER {UPTO} - last_value({c} IGNORE NULLS) OVER {BEFORE}, 9) END AS {c}_diff")


@query("diff_features", f"SELECT id_board, epoch_us(_time) AS t_us, {_diff('air_temp')}, {_diff('tds')} FROM wide {W}", "wide")
def diff_features(spark, sf):
    w = events.wide(spark, sf).select("id_board", "_time", "air_temp", "tds")
    d = seq.diff_features(w, events.board_slices(spark, sf), ["air_temp", "tds"], 6)
    return d.select("id_board", us(), r("air_temp_diff").alias("air_temp_diff"), r("tds_diff").alias("tds_diff"))


@query("forward_fill", f"""SELECT id_board, epoch_us(_time) AS t_us, last_value(leaf_temp IGNORE NULLS) OVER {UPTO} AS leaf_temp FROM wide""", "wide")
def forward_fill(spark, sf):
    w = events.wide(spark, sf).select("id_board", "_time", "leaf_temp")
    return seq.fill(w, events.board_slices(spark, sf), ["leaf_temp"]).select("id_board", us(), "leaf_temp")


@query("fill_both_ways", f"""SELECT id_board, epoch_us(_time) AS t_us, coalesce(last_value(leaf_temp IGNORE NULLS) OVER {UPTO}, first_value(leaf_temp IGNORE NULLS) OVER {FROM}, 0) AS leaf_temp,
 coalesce(pressure, 0.0) AS pressure FROM wide""", "wide")
def fill_both_ways(spark, sf):
    w = events.wide(spark, sf).select("id_board", "_time", "leaf_temp", "pressure")
    return seq.fill(w, events.board_slices(spark, sf), ["leaf_temp", "pressure"], backward=True, zero=True).select("id_board", us(), "leaf_temp", "pressure")


@query("spike_filter", """SELECT id_board, epoch_us(_time) AS t_us, CASE WHEN NOT coalesce(tds > m * 1.3 OR tds < m * (1 / 1.3), false) THEN tds END AS tds FROM (
 SELECT *, median(tds) OVER (PARTITION BY id_board ORDER BY _time ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m FROM wide)""", "wide")
def spike_filter(spark, sf):
    w = events.wide(spark, sf).select("id_board", "_time", "tds")
    return seq.spike_filter(w, events.board_slices(spark, sf)).select("id_board", us(), "tds")


@query("sessions", f"""SELECT id_board, epoch_us(_time) AS t_us, CAST(sum(c) OVER {UPTO} AS BIGINT) AS block_id FROM (
 SELECT *, CASE WHEN epoch_us(_time) - lag(epoch_us(_time)) OVER w > 12 * {MIN} THEN 1 ELSE 0 END AS c FROM wide {W})""", "wide")
def sessions(spark, sf):
    w = events.wide(spark, sf).select("id_board", "_time")
    return seq.sessions(w, events.board_slices(spark, sf)).select("id_board", us(), "block_id")


@query("leaf_weights", f"""SELECT id_board, epoch_us(_time) AS t_us, CASE WHEN leaf IS NULL THEN 1 WHEN pt IS NULL OR epoch_us(_time) - pt > 12 * {MIN} THEN 2
 WHEN leaf = pv THEN 1 ELSE 2 END AS leaf_weight FROM (
 SELECT *, lag(epoch_us(_time)) OVER w AS pt, last_value(leaf IGNORE NULLS) OVER {BEFORE} AS pv FROM (SELECT *, round(leaf_temp / 25) AS leaf FROM wide) {W})""", "wide")
def leaf_weights(spark, sf):
    w = events.wide(spark, sf).select("id_board", "_time", F.round(F.col("leaf_temp") / 25).alias("leaf_temp"))
    return seq.leaf_weights(w, events.board_slices(spark, sf)).select("id_board", us(), "leaf_weight")


NB = "(PARTITION BY node_id ORDER BY _time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("moisture_alerts", f"""SELECT node_id, seq, epoch_us(_time) AS t_us, k AS soil_moisture, 'pump' AS act, 255 AS val, 60 AS dur FROM (
 SELECT *, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY node_id, island ORDER BY _time, seq) AS n FROM (
 SELECT *, k < 70 AS low, sum(CASE WHEN k >= 70 THEN 1 ELSE 0 END) OVER {NB} AS island FROM packets)) WHERE low AND n % 5 = 0""", "packets")
def moisture_alerts(spark, sf):
    p = events.packets(spark, sf).select("node_id", "_time", "seq", F.col("k").alias("soil_moisture"))
    return seq.moisture_alerts(p, events.node_slices(spark, sf)).withColumn("t_us", F.unix_micros("_time")).drop("_time")


def leaf_packets(spark, sf):
    """Packets of boards: the sign-up value is the leaf sensor, an error row is an operator's reading."""
    e = events.events(spark, sf)
    tel = e.select("event_id", events.board().alias("id_board"), F.col("ts").alias("_time"), F.col("event_id").alias("seq"),
                   F.when(F.col("event_type") == "signup", F.col("value")).alias("leaf_temp"))
    readings = e.where(F.col("event_type") == "error").select(
        events.board().alias("id_board"), F.col("ts").alias("_time"), F.col("event_id").alias("seq"), F.col("value").alias("temp"),
        F.concat(F.lit("R"), F.col("k").cast("long").cast("string")).alias("reading_id"))
    return tel.drop("event_id"), readings


_READ = """tel AS (SELECT event_id AS seq, 'b' || (user_id % 2) AS id_board, ts AS _time, CASE WHEN event_type = 'signup' THEN value END AS leaf,
  last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER a AS temp,
  last_value(CASE WHEN event_type = 'error' THEN 'R' || CAST(k AS BIGINT) END IGNORE NULLS) OVER a AS rid FROM ev
  WINDOW a AS (PARTITION BY user_id % 2 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 tries AS (SELECT *, row_number() OVER (PARTITION BY id_board, island ORDER BY _time, seq) AS use_no FROM (
  SELECT *, sum(CASE WHEN rid = prev THEN 0 ELSE 1 END) OVER (PARTITION BY id_board ORDER BY _time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
  SELECT *, lag(rid) OVER (PARTITION BY id_board ORDER BY _time, seq) AS prev FROM tel WHERE (leaf IS NULL OR leaf < 5) AND rid IS NOT NULL))),
 applied AS (SELECT tel.id_board, tel.seq, tel._time, tel.leaf, tel.temp, tel.rid, use_no,
  CASE WHEN use_no > 14 THEN 5 WHEN (use_no - 1) % 6 = 0 THEN (use_no - 1) // 6 + 1 END AS level FROM tel LEFT JOIN tries USING (seq))"""


@query("fallback_lookup", "SELECT seq, leaf AS leaf_temp, temp, rid AS reading_id FROM tel", "ev", _READ)
def fallback_lookup(spark, sf):
    tel, readings = leaf_packets(spark, sf)
    return joins.fallback_lookup(tel, readings, events.board_slices(spark, sf)).select("seq", "leaf_temp", "temp", "reading_id")


def _applied(spark, sf):
    tel, readings = leaf_packets(spark, sf)
    s = events.board_slices(spark, sf)
    return seq.apply_fallback(joins.fallback_lookup(tel, readings, s), s)


@query("apply_fallback", """SELECT seq, CASE WHEN use_no <= 14 THEN temp WHEN use_no IS NULL AND leaf < 5 THEN NULL ELSE leaf END AS leaf_temp, use_no,
 CASE WHEN use_no <= 14 THEN 'reading' WHEN use_no > 14 THEN 'exhausted' WHEN leaf IS NULL OR leaf < 5 THEN 'none' ELSE 'sensor' END AS leaf_source FROM applied""", "ev", _READ)
def apply_fallback(spark, sf):
    return _applied(spark, sf).select("seq", "leaf_temp", "use_no", "leaf_source")


@query("fallback_alerts", "SELECT id_board, seq, rid AS reading_id, CAST(level AS INT) AS alert_level FROM applied WHERE level IS NOT NULL", "ev", _READ)
def fallback_alerts(spark, sf):
    return seq.fallback_alerts(_applied(spark, sf)).select("id_board", "seq", "reading_id", "alert_level")


@query("topology_changes", """SELECT node_id, star_id, previous, seq, epoch_us(_time) AS t_us FROM (
 SELECT *, lag(star_id) OVER (PARTITION BY node_id ORDER BY _time, seq) AS previous FROM packets) WHERE previous IS DISTINCT FROM star_id""", "packets")
def topology_changes(spark, sf):
    p = events.packets(spark, sf).select("node_id", "star_id", "_time", "seq")
    return seq.topology_changes(p, events.node_slices(spark, sf)).withColumn("t_us", F.unix_micros("_time")).drop("_time")


@query("tail_per_board", """SELECT id_board, epoch_us(_time) AS t_us, soil_moisture FROM wide
QUALIFY row_number() OVER (PARTITION BY id_board ORDER BY _time DESC) <= 35""", "wide")
def tail_per_board(spark, sf):
    """History rows a forecast needs (a top-n report)."""
    return filters.tail(events.wide(spark, sf), 35, ["id_board"], ["_time"]).select("id_board", us(), "soil_moisture")


@query("fraction_split", """SELECT id_board, epoch_us(_time) AS t_us, row_number() OVER (PARTITION BY id_board ORDER BY _time)
 <= floor(count(*) OVER (PARTITION BY id_board) * 0.9) AS is_train FROM wide""", "wide")
def fraction_split(spark, sf):
    w = events.wide(spark, sf).select("id_board", "_time")
    return seq.fraction_split(w, events.board_slices(spark, sf)).select("id_board", us(), "is_train")


@query("ts_folds", """SELECT id_board, epoch_us(_time) AS t_us, fold, CASE WHEN rn <= n - b * (3 - fold) THEN 'train' ELSE 'test' END AS role FROM (
 SELECT *, row_number() OVER (ORDER BY _time, id_board) AS rn, count(*) OVER () AS n, count(*) OVER () // 4 AS b FROM wide), (VALUES (0), (1), (2)) f(fold)
 WHERE rn <= n - b * (3 - fold) + b""", "wide")
def ts_folds(spark, sf):
    w = events.wide(spark, sf).select("id_board", "_time")
    s = slicing.fit(w, [])
    return seq.ts_folds(w, s, 3).select("id_board", us(), "fold", "role")


#: the measures that events has
SIX = [f for f in C.FIELDS if f in (*events.EVENT_FIELDS.values(), "soil_moisture")]
GRID = f"""bins AS (SELECT id_board, time_bucket(INTERVAL '60 minutes', _time) AS _time, {', '.join(f'avg({c}) AS {c}' for c in SIX)} FROM wide GROUP BY 1, 2),
 grid AS (SELECT id_board, unnest(generate_series(min(_time), max(_time), INTERVAL '60 minutes')) AS _time FROM bins GROUP BY id_board),
 g AS (SELECT id_board, _time, {', '.join(SIX)} FROM grid LEFT JOIN bins USING (id_board, _time))"""


def _grid(spark, sf):
    return agg.resample(events.wide(spark, sf), SIX, 60)


def _rounded(cols) -> str:
    return ", ".join(f"round({c}, 9) AS {n}" for n, c in cols.items())


@query("resample", f"SELECT id_board, epoch_us(_time) AS t_us, {_rounded({c: c for c in SIX})} FROM g", "wide", GRID)
def resample(spark, sf):
    return _grid(spark, sf).select("id_board", us(), *[r(c).alias(c) for c in SIX])


@query("gap_size", " UNION ALL ".join(f"""SELECT id_board, '{c}' AS _field, epoch_us(_time) AS t_us,
 CASE WHEN {c} IS NULL THEN sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id_board, run) ELSE 0 END::BIGINT AS gap FROM (SELECT *, count({c}) OVER {UPTO} AS run FROM g)""" for c in SIX), "wide", GRID)
def gap_size(spark, sf):
    grid, slices = materialise(_grid(spark, sf)), events.board_slices(spark, sf)
    sizes = [seq.gap_size(grid, slices, c, 60).select("id_board", F.lit(c).alias("_field"), us(), "gap") for c in SIX]
    return reduce(lambda a, b: a.unionByName(b), sizes)


def _line(c: str) -> str:
    return f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN gap_{c} > 1 THEN NULL WHEN nt_{c} IS NULL THEN pv_{c}
      ELSE pv_{c} + (nv_{c} - pv_{c}) * (epoch_us(_time) - pt_{c}) / (nt_{c} - pt_{c}) END"""


def _marks(c: str) -> str:
    t = f"CASE WHEN {c} IS NOT NULL THEN epoch_us(_time) END"
    return f"""last_value({c} IGNORE NULLS) OVER {UPTO} AS pv_{c}, last_value({t} IGNORE NULLS) OVER {UPTO} AS pt_{c},
      first_value({c} IGNORE NULLS) OVER {FROM} AS nv_{c}, first_value({t} IGNORE NULLS) OVER {FROM} AS nt_{c}, count({c}) OVER {UPTO} AS run_{c}"""


@query("interpolate", f"""SELECT id_board, epoch_us(_time) AS t_us, {_rounded({c: _line(c) for c in SIX})} FROM (
 SELECT *, {', '.join(f'sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id_board, run_{c}) AS gap_{c}' for c in SIX)} FROM (
 SELECT *, {', '.join(map(_marks, SIX))} FROM g))""", "wide", GRID)
def interpolate(spark, sf):
    d = seq.interpolate(_grid(spark, sf), events.board_slices(spark, sf), SIX, 60)
    return d.select("id_board", us(), *[r(c).alias(c) for c in SIX])


@query("range_rules", """SELECT id_board, epoch_us(_time) AS t_us, CASE WHEN NOT water_temp < 10 THEN water_temp END AS water_temp,
 CASE WHEN NOT tds < 30 THEN tds END AS tds FROM wide""", "wide")
def range_rules(spark, sf):
    return seq.range_rules(events.wide(spark, sf)).select("id_board", us(), "water_temp", "tds")


@query("future_grid", f"""SELECT id_board, step, epoch_us(last) + step::BIGINT * {6 * MIN} AS t_us FROM (SELECT id_board, max(_time) AS last FROM points GROUP BY 1),
 (SELECT unnest(range(1, 31))::INT AS step)""", "points")
def future_grid(spark, sf):
    return seq.future_grid(events.points(spark, sf), 6, 30).select("id_board", "step", us())


@query("horizon_cut", f"""SELECT id_board, _field, seq FROM points QUALIFY epoch_us(_time) <= min(epoch_us(_time)) OVER (PARTITION BY id_board, _field) + 20::BIGINT * 24 * 60 * {MIN}""", "points")
def horizon_cut(spark, sf):
    return seq.horizon(events.points(spark, sf), 20 * 24, ["id_board", "_field"]).select("id_board", "_field", "seq")


def _history_sql(hours: int) -> str:
    def vp(c):
        return f"0.61078 * exp(17.27 * {c} / ({c} + 237.3))"
    return f"""SELECT id_board, t_us, strftime((make_timestamp(t_us) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome', '%Y-%m-%d %H:%M:%S') AS local_time, is_stale,
 round(air_temp, 9) AS air_temp, round(humidity, 9) AS humidity, round(leaf_temp, 9) AS leaf_temp, round(soil_moisture, 9) AS soil_moisture,
 round(CASE WHEN a > 0 THEN a WHEN a IS NOT NULL THEN 0 END, 9) AS vpd_air, round(CASE WHEN leaf_temp > -20 THEN CASE WHEN l > 0 THEN l WHEN l IS NOT NULL THEN 0 END END, 9) AS vpd FROM (
 SELECT *, {vp('air_temp')} * (1 - humidity / 100.0) AS a, {vp('leaf_temp')} - {vp('air_temp')} * humidity / 100.0 AS l FROM (
 SELECT id_board, is_stale, least((epoch_us(_time) // {6 * MIN} + 1) * {6 * MIN}, epoch_us(stop)) AS t_us, avg(_value) FILTER (WHERE _field = 'air_temp') AS air_temp,
  avg(_value) FILTER (WHERE _field = 'humidity') AS humidity, avg(_value) FILTER (WHERE _field = 'leaf_temp') AS leaf_temp,
  avg(_value) FILTER (WHERE _field = 'soil_moisture') AS soil_moisture FROM points JOIN (
  SELECT id_board, anchor - INTERVAL {hours} HOUR AS start, anchor + INTERVAL 3 HOUR AS stop, TIMESTAMP '2024-02-01' - newest > INTERVAL {hours} HOUR AS is_stale FROM (
   SELECT id_board, max(_time) AS newest, CASE WHEN bool_or(_time >= TIMESTAMP '2024-02-01' - INTERVAL {hours} HOUR AND _time < TIMESTAMP '2024-02-01' + INTERVAL 3 HOUR)
    THEN TIMESTAMP '2024-02-01' ELSE max(_time) END AS anchor FROM points GROUP BY id_board)) USING (id_board)
  WHERE _time >= start AND _time < stop GROUP BY ALL))"""


def _history(spark, sf, hours):
    d = history.history_view(events.points(spark, sf), F.lit("2024-02-01").cast("timestamp"), hours)
    return d.select("id_board", us(), F.date_format("local_time", "yyyy-MM-dd HH:mm:ss").alias("local_time"), "is_stale", *[
        r(c).alias(c) for c in ("air_temp", "humidity", "leaf_temp", "soil_moisture", "vpd_air", "vpd")])


@query("history_view", _history_sql(744), "points")
def history_view(spark, sf):
    return _history(spark, sf, 744)


@query("history_reanchored", _history_sql(24), "points")
def history_reanchored(spark, sf):
    """No board has data in the last day, so each shows the day before its newest stamp."""
    return _history(spark, sf, 24)
