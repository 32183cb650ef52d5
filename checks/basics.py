"""Projections, predicates, scalar functions, text and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.functions import calibrate, climate, text
from canopyflow.operators import filters, reshape
from canopyflow.sources import events, tables
from checks.registry import query
from checks.scans import us

R9 = 9


def r(c, digits=R9):
    return F.round(c, digits)


@query("unify_aliases", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN value WHEN user_id % 3 = 1 THEN k END AS tds,
 CASE WHEN user_id % 2 = 0 THEN k END AS leaf_temp FROM ev""")
def unify_aliases(spark, sf):
    e = events.events(spark, sf)
    turn = F.col("user_id") % 3
    return filters.unify_aliases(e.select(
        "event_id", F.when(turn == 0, F.col("value")).alias("tds"), F.when(turn <= 1, F.col("k")).alias("tds_value"),
        F.when(F.col("user_id") % 2 == 0, F.col("k")).alias("leaf_temperature")))


@query("filter_fields", "SELECT seq, _field FROM points WHERE regexp_matches(_field, 'temp')", "points")
def filter_fields(spark, sf):
    return filters.filter_fields(events.points(spark, sf), "temp").select("seq", "_field")


@query("filter_tag", "SELECT seq, _field, _value FROM points WHERE id_board = 'b1'", "points")
def filter_tag(spark, sf):
    return filters.filter_tag(events.points(spark, sf), "id_board", "b1").select("seq", "_field", "_value")


@query("keep_columns", "SELECT seq, _value FROM points", "points")
def keep_columns(spark, sf):
    return filters.keep(filters.drop(events.points(spark, sf), ["id_board"]), ["seq", "id_board", "_value"])


@query("isolate", "SELECT id_board, epoch_us(_time) AS t_us, air_temp, tds, leaf_temp FROM wide", "wide")
def isolate(spark, sf):
    d, missing = filters.isolate(events.wide(spark, sf), ["air_temp", "tds", "co2"], "leaf_temp")
    assert missing == ["co2"]
    return d.select("id_board", us(), "air_temp", "tds", "leaf_temp")


@query("numeric_fields", """SELECT event_id, CASE WHEN CAST(k AS BIGINT) % 4 IN (0, 3) THEN value END AS air_temp, k AS humidity FROM ev""")
def numeric_fields(spark, sf):
    kind = F.col("k").cast("long") % 4
    raw = F.when(kind == 0, F.col("value").cast("string")).when(kind == 1, F.lit("n/a")).when(kind == 2, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    return filters.numeric_fields(events.events(spark, sf).select("event_id", raw.alias("air_temp"), F.col("k").alias("humidity")))


@query("require_key", """SELECT event_id, CAST(k AS BIGINT) % 5 >= 3 AS accepted FROM ev""")
def require_key(spark, sf):
    kind = F.col("k").cast("long") % 5
    node = F.when(kind == 0, F.lit("")).when(kind == 1, F.lit("0")).when(kind >= 3, F.concat(F.col("user_id").cast("string"), F.lit("1")))
    e = events.events(spark, sf).select("event_id", node.alias("node_id"))
    return reshape.union_all(*[d.select("event_id", F.lit(a).alias("accepted")) for d, a in zip(filters.require(e, "node_id"), (True, False))])


@query("with_indoor", "SELECT seq, CASE id_board WHEN 'b1' THEN 1 ELSE 0 END AS is_indoor FROM points", "points")
def with_indoor(spark, sf):
    return filters.with_indoor(events.points(spark, sf), {"b1": 1}).select("seq", "is_indoor")


@query("drop_nulls", """SELECT id_board, epoch_us(_time) AS t_us, CAST(0 AS BOOLEAN) AS all_null FROM wide WHERE air_temp IS NOT NULL AND soil_moisture IS NOT NULL
 UNION ALL SELECT id_board, epoch_us(_time), CAST(1 AS BOOLEAN) FROM wide WHERE coalesce(leaf_temp, tds, humidity) IS NOT NULL""", "wide")
def drop_nulls(spark, sf):
    w = events.wide(spark, sf)
    return reshape.union_all(
        filters.drop_nulls(w, ["air_temp", "soil_moisture"]).select("id_board", us(), F.lit(False).alias("all_null")),
        filters.drop_nulls(w, ["leaf_temp", "tds", "humidity"], "all").select("id_board", us(), F.lit(True).alias("all_null")))


@query("dedupe_last", """SELECT id_board, _field, epoch_us(date_trunc('minute', _time)) AS t_us, max(seq) AS seq, arg_max({'v': _value}, seq).v AS _value FROM points
GROUP BY id_board, _field, date_trunc('minute', _time)""", "points")
def dedupe_last(spark, sf):
    p = events.points(spark, sf).withColumn("_time", F.date_trunc("minute", "_time"))
    return filters.dedupe_last(p, ["id_board", "_field", "_time"], "seq").select("id_board", "_field", us(), "seq", "_value")


@query("override_latest", """SELECT id_board, epoch_us(_time) AS t_us, CASE WHEN newest THEN 21.5 ELSE air_temp END AS air_temp, humidity,
 CASE WHEN newest THEN 80.0 ELSE soil_moisture END AS soil_moisture FROM (SELECT *, _time = max(_time) OVER (PARTITION BY id_board) AS newest FROM wide)""", "wide")
def override_latest(spark, sf):
    w = events.wide(spark, sf)
    d = filters.override_latest(w, {"air_temp": 21.5, "humidity": None, "soil_moisture": 80.0, "co2": 1.0})
    return d.select("id_board", us(), "air_temp", "humidity", "soil_moisture")


@query("round_cols", "SELECT event_id, round(sqrt(value), 3) AS value FROM ev")
def round_cols(spark, sf):
    return filters.round_cols(events.events(spark, sf).select("event_id", F.sqrt("value").alias("value")), ["value"], 3)


@query("clamp_command", """SELECT event_id, CASE WHEN CAST(k AS BIGINT) % 7 = 0 THEN 0.0 ELSE greatest(0.0, least(255.0, value * 10 - 30)) END AS value,
 greatest(0.0, least(300.0, k * 5 - 20)) AS duration_s FROM ev""")
def clamp_command(spark, sf):
    value = F.when(F.col("k").cast("long") % 7 == 0, F.lit("x")).otherwise((F.col("value") * 10 - 30).cast("string"))
    e = events.events(spark, sf).select("event_id", value.alias("value"), (F.col("k") * 5 - 20).cast("string").alias("duration_s"))
    return filters.clamp_command(e)


@query("active_boards", "SELECT seq, id_board FROM points WHERE id_board IN ('b0', 'b7')", "points")
def active_boards(spark, sf):
    return filters.active_boards(events.points(spark, sf), ["b0", "b7"]).select("seq", "id_board")


@query("parse_fallback", """SELECT event_id, CAST(k AS BIGINT) % 4 <> 0 AS ok, CASE WHEN CAST(k AS BIGINT) % 4 <> 0 THEN CAST(user_id AS VARCHAR) END AS board,
 CASE WHEN CAST(k AS BIGINT) % 4 <> 0 THEN value END AS temp, CASE WHEN CAST(k AS BIGINT) % 4 <> 0 THEN 'R' || CAST(k AS BIGINT) END AS reading_id FROM ev""")
def parse_fallback(spark, sf):
    """Lines with a decimal comma; a quarter lacks the third part."""
    temp = F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(","))
    head = F.concat_ws("/", F.col("user_id").cast("string"), temp)
    line = F.when(F.col("k").cast("long") % 4 == 0, head).otherwise(F.concat(head, F.lit("/ R"), F.col("k").cast("long").cast("string"), F.lit(" ")))
    return text.parse_fallback(events.events(spark, sf).select("event_id", line.alias("line"))).drop("line")


@query("parse_values", """SELECT event_id, CAST(k AS BIGINT) % 3 <> 0 AS ok, CASE WHEN CAST(k AS BIGINT) % 3 <> 0 THEN value END AS air_temp,
 CASE WHEN CAST(k AS BIGINT) % 3 <> 0 THEN k END AS light_lux FROM ev""")
def parse_values(spark, sf):
    v = F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(","))
    five = F.lit("50 1013,2 20 300 45")
    line = F.when(F.col("k").cast("long") % 3 == 0, F.concat_ws(" ", v, five)).otherwise(F.concat_ws("  ", v, five, F.col("k").cast("long").cast("string")))
    return text.parse_values(events.events(spark, sf).select("event_id", line.alias("line"))).select("event_id", "ok", "air_temp", "light_lux")


_ACT_OK = "CAST(k AS BIGINT) * 4 <= 255 AND CAST(floor(value) AS BIGINT) - 5 >= 0 AND user_id % 3 <> 0"


@query("parse_action", f"""SELECT event_id, {_ACT_OK} AS ok, CASE WHEN {_ACT_OK} THEN 'pump' END AS act, CASE WHEN {_ACT_OK} THEN CAST(k * 4 AS INT) END AS val,
 CASE WHEN {_ACT_OK} THEN CAST(floor(value) AS INT) - 5 END AS dur FROM ev""")
def parse_action(spark, sf):
    name = F.when(F.col("user_id") % 3 == 0, F.lit("sprinkler")).otherwise(F.lit("PUMP"))
    line = F.concat_ws(" ", name, (F.col("k").cast("long") * 4).cast("string"), (F.floor("value") - 5).cast("string"))
    return text.parse_action(events.events(spark, sf).select("event_id", line.alias("line"))).drop("line")


@query("decimal_comma", "SELECT event_id, value AS n, CASE WHEN user_id % 2 = 0 THEN value END AS strict FROM ev")
def decimal_comma(spark, sf):
    t = F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(","))
    loose = F.concat(F.lit(" "), t, F.lit("C"))
    strict = F.when(F.col("user_id") % 2 == 0, t).otherwise(loose)
    return events.events(spark, sf).select("event_id", text.leading_number(loose).alias("n"), text.number(strict).alias("strict"))


@query("pivot_fields", "SELECT id_board, epoch_us(_time) AS t_us, air_temp, humidity, water_temp, tds, soil_moisture, leaf_temp, pressure, light_lux FROM wide", "wide")
def pivot_fields(spark, sf):
    return reshape.pivot_fields(events.points(spark, sf)).withColumn("t_us", F.unix_micros("_time")).drop("_time")


@query("melt", """SELECT id_board, epoch_us(_time) AS t_us, f.name AS _field, f.v AS _value FROM wide,
 LATERAL (VALUES ('air_temp', air_temp), ('humidity', humidity), ('tds', tds)) f(name, v)""", "wide")
def melt(spark, sf):
    w = events.wide(spark, sf).select("id_board", us(), "air_temp", "humidity", "tds")
    return reshape.melt(w, ["id_board", "t_us"])


@query("to_points", "SELECT id_board, epoch_us(_time) AS t_us, _field, _value FROM points WHERE _value IS NOT NULL", "points")
def to_points(spark, sf):
    return reshape.to_points(events.wide(spark, sf)).select("id_board", us(), "_field", "_value")


SENT = ["air_temp", "humidity", "tds", "leaf_temp", "water_temp", "soil_moisture"]  # the fields that the points have


@query("regroup", f"""SELECT id_board, epoch_us(_time) AS t_us, {', '.join(f"arg_max(v, src) FILTER (WHERE _field = '{f}') AS {f}" for f in SENT)} FROM (
  SELECT id_board, _field, _time, _value + 1 AS v, 1 AS src FROM points UNION ALL
  SELECT id_board, _field, _time, _value, 0 FROM points) GROUP BY 1, 2""", "points")
def regroup(spark, sf):
    """Sources that differ in their tags fall into one row once the tags leave the key."""
    p = events.points(spark, sf)
    both = tables.as_points(p.withColumn("seq", F.lit(0))).unionByName(
        tables.as_points(p.withColumn("_value", F.col("_value") + 1).withColumn("seq", F.lit(1)), model_source="T5", freq="6m"))
    return reshape.pivot_fields(both, SENT).select("id_board", us(), *SENT)


@query("field_index", "SELECT seq, _field, dense_rank() OVER (ORDER BY _field) - 1 AS \"table\" FROM points", "points")
def field_index(spark, sf):
    return reshape.field_index(events.points(spark, sf)).select("seq", "_field", F.col("table").cast("long").alias("table"))


@query("union_all", "SELECT event_id, value, CAST(NULL AS DOUBLE) AS k FROM ev UNION ALL SELECT event_id, NULL, k FROM ev")
def union_all(spark, sf):
    e = events.events(spark, sf)
    return reshape.union_all(e.select("event_id", "value"), e.select("k", "event_id"))


@query("sort_series", "SELECT id_board, _field, epoch_us(_time) AS t_us, seq FROM points ORDER BY id_board, _field, _time", "points")
def sort_series(spark, sf):
    """A range sort: partitions are cut at sampled keys, so a large board spreads over many."""
    return events.points(spark, sf).orderBy("id_board", "_field", "_time", "seq").select("id_board", "_field", us(), "seq")


@query("vpd_scoring", """SELECT event_id, round(CASE WHEN d > 0 THEN d ELSE 0.0 END, 9) AS vpd FROM (
 SELECT event_id, 0.61078 * exp(17.27 * value / (value + 237.3)) - 0.61078 * exp(17.27 * k / (k + 237.3)) * 55 / 100.0 AS d FROM ev)""")
def vpd_scoring(spark, sf):
    return events.events(spark, sf).select("event_id", r(climate.vpd("value", "k", F.lit(55.0))).alias("vpd"))


_SVP = "0.61078 * exp(17.27 * {0} / ({0} + 237.3))"


@query("with_vpd", f"""SELECT event_id, round(CASE WHEN a > 0 THEN a WHEN a IS NOT NULL THEN 0.0 END, 9) AS vpd_air,
 round(CASE WHEN leaf > -20 THEN CASE WHEN l > 0 THEN l WHEN l IS NOT NULL THEN 0.0 END END, 9) AS vpd_leaf FROM (
 SELECT event_id, leaf, {_SVP.format('air')} * (1 - rh / 100.0) AS a, {_SVP.format('leaf')} - {_SVP.format('air')} * rh / 100.0 AS l FROM (
  SELECT event_id, value AS air, k AS rh, CASE WHEN user_id % 5 <> 0 THEN k - 25 END AS leaf FROM ev))""")
def with_vpd(spark, sf):
    e = events.events(spark, sf).select("event_id", F.col("value").alias("air_temp"), F.col("k").alias("humidity"),
                                        F.when(F.col("user_id") % 5 != 0, F.col("k") - 25).alias("leaf_temp"))
    return climate.with_vpd(e).select("event_id", r("vpd_air").alias("vpd_air"), r("vpd").alias("vpd_leaf"))


@query("vpd_air_forecast", f"""SELECT event_id, round(greatest(0, {_SVP.format('value')} * (1 - k / 100.0)), 4) AS vpd FROM ev""")
def vpd_air_forecast(spark, sf):
    return events.events(spark, sf).select("event_id", climate.vpd_air_forecast("value", "k").alias("vpd"))


@query("time_features", """SELECT event_id, round(sin(2 * pi() * m / 1440), 9) AS time_sin, round(cos(2 * pi() * m / 1440), 9) AS time_cos FROM (
 SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM ev)""")
def time_features(spark, sf):
    return events.events(spark, sf).select("event_id", *[r(c).alias(n) for n, c in climate.time_features("ts").items()])


@query("to_local", "SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome', '%Y-%m-%d %H:%M:%S') AS local_time FROM ev")
def to_local(spark, sf):
    return events.events(spark, sf).select("event_id", F.date_format(climate.to_local("ts"), "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query("calibrate_tds", """SELECT event_id, round((133.42 * v * v * v - 255.86 * v * v + 857.39 * v) * 0.5 * 1.1, 6) AS tds FROM (
 SELECT event_id, (k * 40) / 4095.0 * 3.3 / (1 + 0.02 * (value - 25)) AS v FROM ev)""")
def calibrate_tds(spark, sf):
    return events.events(spark, sf).select("event_id", r(calibrate.tds(F.col("k") * 40, F.col("value"), 1.1), 6).alias("tds"))


@query("calibrate_soil", """SELECT event_id, round(greatest(0, least(100, 100.0 * (3000 - k * 40) / (3000 - 1200))), 9) AS soil FROM ev""")
def calibrate_soil(spark, sf):
    return events.events(spark, sf).select("event_id", r(calibrate.soil(F.col("k") * 40, F.lit(3000.0), F.lit(1200.0))).alias("soil"))


@query("calibrate_lux", "SELECT event_id, round(k * 7 / CASE WHEN user_id % 2 = 1 THEN 2.4 ELSE 1.2 END, 9) AS lux FROM ev")
def calibrate_lux(spark, sf):
    return events.events(spark, sf).select("event_id", r(calibrate.lux(F.col("k") * 7, F.col("user_id") % 2 == 1)).alias("lux"))


@query("decode_aht", """SELECT event_id, round((user_id * 4099 + CAST(k AS BIGINT)) % 1048576 / 1048576.0 * 100, 9) AS humidity,
 round((event_id * 10007) % 1048576 / 1048576.0 * 200 - 50, 9) AS air_temp FROM ev""")
def decode_aht(spark, sf):
    h = (F.col("user_id") * 4099 + F.col("k").cast("long")) % 1048576
    t = (F.col("event_id") * 10007) % 1048576
    frame = F.unhex(F.concat(F.lit("1C"), F.lpad(F.hex(h * 1048576 + t), 10, "0")))
    hum, air = calibrate.aht(frame)
    return events.events(spark, sf).select("event_id", r(hum).alias("humidity"), r(air).alias("air_temp"))


# fixed values: the data sheet's example coefficients, T1 varied by device
BMP = {"T2": 26435, "T3": -1000, "P1": 36477, "P2": -10685, "P3": 3024, "P4": 2855, "P5": 140, "P6": -7, "P7": 15500, "P8": -14600, "P9": 6000}


@query("compensate_bmp", f"""SELECT event_id, ((f * 5 + 128) >> 8) / 100.0 AS bmp_temp, (((p + ((6000 * (p >> 13) * (p >> 13)) >> 25) + ((-14600 * p) >> 19)) >> 8) + 15500 * 16) / 256.0 AS pressure FROM (
 SELECT event_id, f, CAST(trunc(CAST(((1048576 - adc_p) * 2147483648 - v2) AS HUGEINT) * 3125 // s) AS BIGINT) AS p FROM (
 SELECT *, (((140737488355328 + ((x * x * 3024) >> 8) + x * -10685 * 4096)) * 36477) >> 33 AS s, x * x * -7 + x * 140 * 131072 + 2855 * 34359738368 AS v2 FROM (
 SELECT *, f - 128000 AS x FROM (
 SELECT *, ((((adc_t >> 3) - t1 * 2) * 26435) >> 11) + ((((((adc_t >> 4) - t1) * ((adc_t >> 4) - t1)) >> 12) * -1000) >> 14) AS f FROM (
 SELECT event_id, 519888 + CAST(k AS BIGINT) * 50 AS adc_t, 415148 + CAST(floor(value * 10) AS BIGINT) AS adc_p, 27504 + (user_id % 20) AS t1 FROM ev)))))""")
def compensate_bmp(spark, sf):
    e = events.events(spark, sf)
    raw = e.select("event_id", (F.col("user_id") % 20).alias("node_id"), (F.lit(519888) + F.col("k").cast("long") * 50).alias("adc_t"),
                   (F.lit(415148) + F.floor(F.col("value") * 10)).alias("adc_p"))
    calib = e.select((F.col("user_id") % 20).alias("node_id")).distinct().select(
        "node_id", (F.lit(27504) + F.col("node_id")).alias("T1"), *[F.lit(v).alias(n) for n, v in BMP.items()])
    return calibrate.compensate_bmp(raw, calib).select("event_id", "bmp_temp", "pressure")


@query("thermocouple", "SELECT event_id, round(value + (k - 50) * 0.0078125 / 0.041276, 9) AS leaf_temp FROM ev")
def thermocouple(spark, sf):
    return events.events(spark, sf).select("event_id", r(calibrate.leaf_from_thermocouple(F.col("k") - 50, F.col("value"))).alias("leaf_temp"))


@query("one_wire", """SELECT event_id, w / 16.0 AS temp, w / 16.0 BETWEEN -55 AND 125 AS in_range FROM (
 SELECT event_id, CASE WHEN u >= 32768 THEN u - 65536 ELSE u END AS w FROM (SELECT event_id, (event_id * 37 + user_id) % 65536 AS u FROM ev))""")
def one_wire(spark, sf):
    u = (F.col("event_id") * 37 + F.col("user_id")) % 65536
    temp, ok = calibrate.one_wire(F.floor(u / 256), u % 256)
    return events.events(spark, sf).select("event_id", temp.alias("temp"), ok.alias("in_range"))


@query("mac_id", "SELECT event_id, event_id * 65537 % 4294967296 AS node_id FROM ev")
def mac_id(spark, sf):
    h = F.lpad(F.hex(F.col("event_id") * 65537 % 4294967296), 8, "0")
    mac = F.concat(F.lit("AC:67:"), F.substring(h, 1, 2), F.lit(":"), F.substring(h, 3, 2), F.lit(":"), F.substring(h, 5, 2), F.lit(":"), F.substring(h, 7, 2))
    return events.events(spark, sf).select("event_id", calibrate.mac_id(mac).alias("node_id"))


@query("feature_label", """SELECT event_id, CASE WHEN length(n) > 30 THEN n[1:27] || '...' ELSE n END AS label FROM (
 SELECT event_id, event_type || '_' || repeat('x', CAST(k AS BIGINT) % 40) AS n FROM ev)""")
def feature_label(spark, sf):
    n = F.concat(F.lit("remainder__"), F.col("event_type"), F.lit("_"), F.expr("repeat('x', cast(k AS int) % 40)"))
    return events.events(spark, sf).select("event_id", text.feature_label(n).alias("label"))


@query("params_text", """SELECT event_id, CASE WHEN length(t) > 120 THEN t[1:117] || '...' ELSE t END AS params FROM (
 SELECT event_id, 'alpha:' || printf('%.2f', value) || ', kind:' || repeat(event_type, 1 + CAST(k AS BIGINT) % 20) AS t FROM ev)""")
def params_text(spark, sf):
    m = F.create_map(F.lit("regressor__alpha"), F.format_string("%.2f", "value"), F.lit("regressor__kind"),
                     F.expr("repeat(event_type, 1 + cast(k AS int) % 20)"))
    return events.events(spark, sf).select("event_id", text.params_text(m).alias("params"))
