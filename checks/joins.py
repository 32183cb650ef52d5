"""Lookups, interval joins and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import filters, joins
from canopyflow.operators import sequence as seq
from canopyflow.sources import events
from checks.basics import r
from checks.registry import query
from checks.scans import us

HOUR = 3_600_000_000


def topology(spark, sf):
    """The newest hub of each node; nodes that have moved to hub h3 are unknown."""
    latest = filters.latest_per(events.packets(spark, sf).select("node_id", "star_id", "_time", "seq"), ["node_id"], ["_time", "seq"])
    return latest.where(F.col("star_id") != "h3").select("node_id", "star_id")


_TOPO = """topo AS (SELECT node_id, star_id FROM (SELECT node_id, arg_max(star_id, {'t': _time, 's': seq}) AS star_id FROM packets GROUP BY 1) WHERE star_id <> 'h3')"""


def commands(spark, sf):
    p = events.packets(spark, sf)
    return p.where(F.col("event_type") == "purchase").select("node_id", "_time", "seq", F.col("k").alias("val"))


def acks(spark, sf):
    return events.packets(spark, sf).where(F.col("event_type") == "signup").select("node_id", "_time", "seq")


@query("route_commands", "SELECT seq, node_id, star_id FROM packets_c LEFT JOIN topo USING (node_id)", "packets",
       _TOPO + ", packets_c AS (SELECT seq, node_id FROM packets WHERE event_type = 'purchase')")
def route_commands(spark, sf):
    good, bad = joins.route_commands(commands(spark, sf), topology(spark, sf))
    return good.select("seq", "node_id", "star_id").unionByName(bad.select("seq", "node_id"), allowMissingColumns=True)


@query("available_boards", "SELECT DISTINCT node_id AS id_board FROM packets WHERE node_id IN (SELECT node_id FROM topo) ORDER BY 1", "packets", _TOPO)
def available_boards(spark, sf):
    p = events.packets(spark, sf).select(F.col("node_id").alias("id_board"))
    return joins.available_boards(p, topology(spark, sf))


_OUT = f"""cmd AS (SELECT node_id, seq, epoch_us(_time) AS t, lead(epoch_us(_time)) OVER (PARTITION BY node_id ORDER BY _time, seq) AS nxt FROM packets WHERE event_type = 'purchase'),
 outc AS (SELECT c.node_id, c.seq, c.t, min(epoch_us(a._time)) AS ack, least(c.t + 9 * {HOUR}, c.nxt) AS lim, any_value(c.nxt) AS nxt FROM cmd c LEFT JOIN packets a
  ON a.event_type = 'signup' AND a.node_id = c.node_id AND epoch_us(a._time) > c.t AND epoch_us(a._time) < least(c.t + 9 * {HOUR}, c.nxt) GROUP BY c.node_id, c.seq, c.t, c.nxt),
 ended AS (SELECT *, coalesce(ack, lim) AS end_us, CASE WHEN ack IS NOT NULL THEN 'acked' WHEN nxt < t + 9 * {HOUR} THEN 'replaced' ELSE 'failed' END AS status FROM outc)"""


def _outcomes(spark, sf):
    return joins.command_outcomes(commands(spark, sf), acks(spark, sf), events.node_slices(spark, sf), 9 * HOUR)


@query("command_outcomes", "SELECT node_id, seq, t AS t_us, end_us, status FROM ended", "packets", _OUT)
def command_outcomes(spark, sf):
    return _outcomes(spark, sf).select("node_id", "seq", us(), us("end_time").alias("end_us"), "status")


@query("retry_events", f"""SELECT node_id, seq, CAST(a AS INT) AS attempt, t + (a - 1) * 3 * {HOUR} AS send_us FROM ended, (VALUES (1), (2), (3)) v(a)
WHERE a = 1 OR t + (a - 1) * 3 * {HOUR} < end_us""", "packets", _OUT)
def retry_events(spark, sf):
    d = joins.retry_events(_outcomes(spark, sf), events.node_slices(spark, sf), 3 * HOUR)
    return d.select("node_id", "seq", "attempt", us("send_time").alias("send_us"))


@query("dispatch", """SELECT c.node_id, c.seq, CASE WHEN c.nxt IS NULL OR p.t <= c.nxt THEN p.t END AS sent_us, CASE WHEN c.nxt IS NULL OR p.t <= c.nxt THEN p.seq END AS packet_seq FROM cmd c
 ASOF LEFT JOIN (SELECT node_id, seq, epoch_us(_time) AS t FROM packets WHERE event_type <> 'purchase') p ON p.node_id = c.node_id AND p.t > c.t""", "packets",
       """cmd AS (SELECT node_id, seq, epoch_us(_time) AS t, lead(epoch_us(_time)) OVER (PARTITION BY node_id ORDER BY _time, seq) AS nxt FROM packets WHERE event_type = 'purchase')""")
def dispatch(spark, sf):
    pk = events.packets(spark, sf).where(F.col("event_type") != "purchase").select("node_id", "_time", "seq")
    d = joins.dispatch(commands(spark, sf), pk, events.node_slices(spark, sf))
    return d.select("node_id", "seq", us("sent_time").alias("sent_us"), "packet_seq")


@query("routable", """SELECT c.seq, c.star_id FROM packets c JOIN (SELECT star_id, min(_time) AS seen FROM packets WHERE event_type = 'view' GROUP BY 1) f USING (star_id)
WHERE c.event_type = 'purchase' AND f.seen <= c._time""", "packets")
def routable(spark, sf):
    p = events.packets(spark, sf)
    return joins.routable(p.where(F.col("event_type") == "purchase"), p.where(F.col("event_type") == "view")).select("seq", "star_id")


def _forecast(spark, sf, column: str, steps_column: str):
    """A forecast-like series per node: one value per day of the month."""
    p = events.packets(spark, sf)
    return p.groupBy("node_id", F.dayofmonth("_time").alias("step")).agg(F.avg(column).alias(steps_column))


@query("align_forecasts", """SELECT node_id, step, round(a.v, 9) AS auto, round(b.v, 9) AS env FROM (
  SELECT node_id, day(_time)::INT AS step, avg(value) AS v FROM packets GROUP BY 1, 2) a JOIN (
  SELECT node_id, day(_time)::INT AS step, avg(k) AS v FROM packets WHERE event_type = 'view' GROUP BY 1, 2) b USING (node_id, step)""", "packets")
def align_forecasts(spark, sf):
    p = events.packets(spark, sf)
    a = _forecast(spark, sf, "value", "auto")
    b = p.where(F.col("event_type") == "view").groupBy("node_id", F.dayofmonth("_time").alias("step")).agg(F.avg("k").alias("env"))
    return joins.align(a, b, ("node_id", "step")).select("node_id", "step", r("auto").alias("auto"), r("env").alias("env"))


_TASKS = " UNION ALL ".join(
    f"SELECT '{t.name}' AS task, '{t.target}' AS target, {len(t.features)} AS n_features, {str(t.use_lags).lower()} AS use_lags, {t.lags()} AS lags" for t in C.TASKS.values())


@query("with_config", f"SELECT event_id, task, target, n_features, use_lags, lags FROM (SELECT event_id, 't' || (user_id % 10) AS task FROM ev) LEFT JOIN ({_TASKS}) USING (task)")
def with_config(spark, sf):
    e = events.events(spark, sf).select("event_id", F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("task"))
    return joins.with_config(e).select("event_id", "task", "target", F.when(F.col("features").isNotNull(), F.size("features")).alias("n_features"), "use_lags", "lags")


@query("missing_models", """SELECT freq, task FROM (SELECT DISTINCT user_id AS task FROM ev), (VALUES (1), (2), (3), (6)) f(freq)
WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.event_type = 'signup' AND e.user_id = task AND CAST(e.k AS BIGINT) % 7 = freq)""")
def missing_models(spark, sf):
    e = events.events(spark, sf)
    stored = e.where(F.col("event_type") == "signup").select(F.col("user_id").alias("task"), (F.col("k").cast("int") % 7).alias("freq"))
    return joins.missing_models(e.select(F.col("user_id").alias("task")), stored, [1, 2, 3, 6])


@query("write_back", "SELECT id_board, epoch_us(_time) AS t_us, CASE WHEN air_temp IS NOT NULL THEN round(air_temp * 0.9 + 1, 9) ELSE leaf_temp END AS leaf_temp FROM wide", "wide")
def write_back(spark, sf):
    w = events.wide(spark, sf)
    return joins.write_back(w, r(F.col("air_temp") * 0.9 + 1), F.col("air_temp").isNotNull()).select("id_board", us(), "leaf_temp")


@query("boards_in_both", "SELECT DISTINCT node_id FROM packets WHERE event_type = 'error' INTERSECT SELECT DISTINCT node_id FROM packets WHERE k > 95", "packets")
def boards_in_both(spark, sf):
    p = events.packets(spark, sf)
    return p.where(F.col("event_type") == "error").select("node_id").intersect(p.where(F.col("k") > 95).select("node_id"))
