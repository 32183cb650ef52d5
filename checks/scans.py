"""Sources and sinks."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.functions.climate import iso
from canopyflow.operators import aggregates as agg
from canopyflow.operators import filters, joins, reshape
from canopyflow.session import shared_dir
from canopyflow.sources import documents, dumps, events, packets, tables, uplink
from checks.registry import query


def us(c: str = "_time"):
    return F.unix_micros(c).alias("t_us")


def scratch(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/checks/{uuid.uuid4().hex}"


@query("scan_points", """SELECT seq, id_board, _field, _value, epoch_us(_time) AS t_us FROM points
WHERE _time >= TIMESTAMP '2024-01-02' AND _time < TIMESTAMP '2024-01-29'""", "points")
def scan_points(spark, sf):
    p = events.points(spark, sf)
    p = filters.scan_points(p, F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-29").cast("timestamp"))
    return p.select("seq", "id_board", "_field", "_value", us())


@query("time_bounds_lookback", """SELECT seq, _field, _value, epoch_us(_time) AS t_us FROM points
WHERE _time >= (SELECT max(ts) FROM ev) - INTERVAL 21 DAY AND _time < (SELECT max(ts) FROM ev)""", "points")
def time_bounds_lookback(spark, sf):
    """The three weeks before the newest point; the bounds are literals, so they reach the scan."""
    p = events.points(spark, sf)
    newest = p.agg(F.max("_time")).first()[0]  # one value
    return filters.scan_points(p, *filters.time_bounds(newest, timedelta(days=21))).select("seq", "_field", "_value", us())


def uplink_frames(spark, sf):
    """Radio frames of the events: a tenth broken, a tenth clock requests."""
    e = events.events(spark, sf)
    num = lambda c: F.format_string("%.2f", c)
    full = F.concat(
        F.lit('{"sid":'), (F.col("user_id") % 7).cast("string"), F.lit(',"ts":'), F.unix_seconds("ts").cast("string"),
        F.lit(',"id":'), F.col("user_id").cast("string"), F.lit(',"at":'), num("value"), F.lit(',"sm":'), num("k"),
        F.lit(',"rssi":'), F.col("k").cast("long").cast("string"), F.lit("}"))
    hello = F.concat(F.lit('{"sid":'), (F.col("user_id") % 7).cast("string"), F.lit(',"sync":1}'))
    kind = F.col("k").cast("long") % 10
    return e.select("event_id", F.when(kind == 0, F.lit('{"sid":')).when(kind == 1, hello).otherwise(full).alias("payload"))


_UP = "CAST(k AS BIGINT) % 10"


@query("decode_uplink", f"""SELECT event_id, user_id % 7 AS star_id,
 CASE WHEN {_UP} = 1 THEN NULL ELSE CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) END AS stamp,
 CASE WHEN {_UP} = 1 THEN NULL ELSE user_id END AS node_id, CASE WHEN {_UP} = 1 THEN NULL ELSE value END AS air_temp,
 CASE WHEN {_UP} = 1 THEN NULL ELSE k END AS soil_moisture, CASE WHEN {_UP} = 1 THEN '1' END AS sync,
 CASE WHEN {_UP} = 1 THEN NULL ELSE CAST(CAST(k AS BIGINT) AS VARCHAR) END AS rssi FROM ev WHERE {_UP} <> 0""")
def decode_uplink(spark, sf):
    good, _ = uplink.decode_uplink(uplink_frames(spark, sf))
    return good.select("event_id", "star_id", F.col("timestamp").alias("stamp"), "node_id", "air_temp", "soil_moisture", "sync",
                       F.col("extra")["rssi"].alias("rssi"))


@query("uplink_dead_letters", f"SELECT event_id, '{{\"sid\":' AS payload FROM ev WHERE {_UP} = 0")
def uplink_dead_letters(spark, sf):
    return uplink.decode_uplink(uplink_frames(spark, sf))[1]


@query("split_sync", f"""SELECT event_id, user_id % 7 AS star_id, {_UP} = 1 AS is_request FROM ev WHERE {_UP} <> 0""")
def split_sync(spark, sf):
    good, _ = uplink.decode_uplink(uplink_frames(spark, sf))
    tel, requests = filters.split_sync(good)
    return reshape.union_all(*[d.select("event_id", "star_id", F.lit(r).alias("is_request")) for d, r in ((tel, False), (requests, True))])


@query("sync_replies", f"""SELECT user_id % 7 AS star_id, '{{"sync":1,"sid":' || (user_id % 7) || ',"ts":1706745600}}' AS reply
FROM ev WHERE {_UP} = 1""")
def sync_replies(spark, sf):
    good, _ = uplink.decode_uplink(uplink_frames(spark, sf))
    return uplink.sync_replies(good, F.lit("2024-02-01").cast("timestamp"))


@query("encode_uplink", """SELECT event_id, '{"sid":' || (user_id % 7) || ',"ts":' || CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) || ',"id":' || user_id
 || ',"p":0.00,"wt":0.00,"lux":0.00,"tds":0.00,"sm":' || printf('%.2f', k) || ',"at":' || printf('%.2f', value)
 || ',"h":0.00,"lt":0.00}' AS payload FROM ev""")
def encode_uplink(spark, sf):
    e = events.events(spark, sf).select(
        "event_id", (F.col("user_id") % 7).alias("star_id"), F.unix_seconds("ts").alias("timestamp"), F.col("user_id").alias("node_id"),
        F.col("value").alias("air_temp"), F.col("k").alias("soil_moisture"),
        *[F.lit(None).cast("double").alias(c) for c in ("pressure", "water_temp", "light_lux", "tds", "humidity", "leaf_temp")])
    return e.select("event_id", uplink.encode_uplink().alias("payload"))


@query("encode_command", """SELECT event_id, '{"nid":' || user_id || ',"act":"pump","val":' || CAST(k AS BIGINT) || ',"dur":' || CAST(floor(value) AS BIGINT) || '}' AS payload,
 '{"ack":1,"nid":' || user_id || '}' AS ack FROM ev""")
def encode_command(spark, sf):
    e = events.events(spark, sf).select("event_id", F.col("user_id").alias("node_id"), F.lit("pump").alias("actuator"),
                                        F.col("k").alias("value"), F.floor("value").alias("duration_s"))
    return e.select("event_id", uplink.encode_command().alias("payload"), uplink.encode_ack().alias("ack"))


def packet_rows(spark, sf):
    e = events.events(spark, sf)
    return packets.encode_packets(e.select(
        "event_id", F.unix_seconds("ts").alias("timestamp"), F.col("user_id").alias("node_id"), F.col("value").alias("air_temp"),
        F.col("k").alias("soil_moisture")), ["event_id"])


@query("decode_packets", """SELECT event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS stamp, user_id AS node_id, value AS air_temp, k AS soil_moisture,
 CAST(0.0 AS DOUBLE) AS leaf_temp FROM ev""")
def decode_packets(spark, sf):
    d = packets.decode_packets(packet_rows(spark, sf))
    return d.select("event_id", F.col("timestamp").alias("stamp"), "node_id", "air_temp", "soil_moisture", "leaf_temp")


@query("decode_packet_blobs", """SELECT r, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS stamp, user_id AS node_id, value AS air_temp FROM ev, (VALUES (1), (2)) t(r)""")
def decode_packet_blobs(spark, sf):
    """Two records and a torn third in every blob."""
    blobs = packet_rows(spark, sf).select(F.concat("data", "data", F.substring("data", 1, 7)).alias("data"), "event_id")
    d = packets.decode_packets(blobs)
    w = F.row_number().over(Window.partitionBy("event_id").orderBy("timestamp"))
    return d.select(w.alias("r"), F.col("timestamp").alias("stamp"), "node_id", "air_temp")


@query("valid_packets", "SELECT event_id FROM ev WHERE CAST(k AS BIGINT) % 4 = 3")
def valid_packets(spark, sf):
    """A quarter each: empty, torn, zero head, good."""
    kind = F.col("k").cast("long") % 4
    zero = F.unhex(F.lit("00" * C.PACKET_BYTES))
    rows = packet_rows(spark, sf).join(events.events(spark, sf).select("event_id", "k"), "event_id")
    data = F.when(kind == 0, F.unhex(F.lit(""))).when(kind == 1, F.substring("data", 1, 33)).when(kind == 2, zero).otherwise(F.col("data"))
    return filters.valid_packets(rows.select("event_id", data.alias("data"))).select("event_id")


def dump_rows(spark, sf):
    e = events.events(spark, sf).withColumn("epoch", F.unix_seconds("ts"))
    given = {"air_temp": F.col("value"), "soil_moisture": F.col("k")}
    return e.select("event_id", dumps.local_stamp("epoch").alias("timestamp"), F.col("user_id").alias("node_id"),
                    *[given.get(c, F.lit(0.0)).alias(c) for c in C.PACKET_FIELDS[2:]])


@query("csv_dump_round_trip", """SELECT user_id AS node_id, value AS air_temp, k AS soil_moisture, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) * 1000000 AS t_us FROM ev""")
def csv_dump_round_trip(spark, sf):
    path = scratch(spark)
    dumps.write_dump_csv(dump_rows(spark, sf), path)
    return dumps.read_dump_csv(spark, path).select("node_id", "air_temp", "soil_moisture", us())


@query("annotated_csv_round_trip", """SELECT CAST(user_id AS VARCHAR) AS id_board, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) * 1000000 AS t_us, f.name AS _field,
 CAST(f.pos AS BIGINT) AS "table", CASE f.name WHEN 'air_temp' THEN value WHEN 'soil_moisture' THEN k ELSE 0.0 END AS _value, 'sensor_measurements' AS measurement
FROM ev, (VALUES ('air_temp', 0), ('humidity', 1), ('leaf_temp', 2), ('light_lux', 3), ('pressure', 4), ('soil_moisture', 5), ('tds_value', 6), ('water_temp', 7)) f(name, pos)""")
def annotated_csv_round_trip(spark, sf):
    path = scratch(spark)
    dump = dump_rows(spark, sf).withColumn("_time", F.to_timestamp("timestamp", dumps.STAMP))
    dumps.write_annotated_csv(dump, path, F.lit("2024-02-01").cast("timestamp"))
    d = dumps.read_annotated_csv(spark, path)
    return d.select("measurement", "id_board", "_field", "_value", "table", us())


def hourly(p, shift_min: int, add: float, seq: int):
    """Points on full hours: many share a key, so the later one has to win."""
    t = F.timestamp_micros(F.unix_micros("_time") + F.lit(shift_min * 60_000_000))
    return tables.as_points(p.withColumn("_time", F.date_trunc("hour", t)).withColumn("_value", F.col("_value") + add)
                            .withColumn("seq", F.col("seq") + seq))


_HOURLY = """h AS (SELECT id_board, _field, date_trunc('hour', _time) AS t, _value AS v, seq, 0 AS new FROM points
 UNION ALL SELECT id_board, _field, date_trunc('hour', _time + INTERVAL 30 MINUTE), _value + 1, seq, 1 FROM points)"""
_UPSERTED = """SELECT id_board, _field, epoch_us(t) AS t_us, round(arg_max(v, {'n': new, 's': seq}), 9) AS _value,
 arg_max(seq, {'n': new, 's': seq}) AS seq FROM h WHERE v IS NOT NULL GROUP BY id_board, _field, t"""


def _shown(df):
    return df.select("id_board", "_field", us(), F.round("_value", 9).alias("_value"), "seq")


@query("upsert_points", _UPSERTED, "points", _HOURLY)
def upsert_points(spark, sf):
    p = events.points(spark, sf)
    return _shown(joins.upsert_points(hourly(p, 0, 0.0, 0), hourly(p, 30, 1.0, 0)))


@query("merge_dumps", _UPSERTED, "points", _HOURLY)
def merge_dumps(spark, sf):
    p = events.points(spark, sf)
    return _shown(joins.merge_dumps(hourly(p, 0, 0.0, 0), hourly(p, 30, 1.0, 0)))


_DUMPED = "CAST(user_id AS VARCHAR) AS id_board, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) * 1000000 AS t_us"


@query("merge_dump_files", f"""SELECT id_board, _field, t_us, coalesce(max(v) FILTER (WHERE new), max(v)) AS _value FROM (
 SELECT {_DUMPED}, f.name AS _field, CASE f.name WHEN 'air_temp' THEN value + d.b::INT WHEN 'soil_moisture' THEN k ELSE 0.0 END AS v, d.b AS new
 FROM ev, (VALUES (false), (true)) d(b), (VALUES ('air_temp'), ('humidity'), ('leaf_temp'), ('light_lux'), ('pressure'), ('soil_moisture'), ('tds_value'), ('water_temp')) f(name)
 WHERE event_id % 3 <> d.b::INT) GROUP BY ALL""")
def merge_dump_files(spark, sf):
    """Two annotated dumps with common points, read, merged and written as a third."""
    paths, stop = [scratch(spark) for _ in range(3)], F.lit("2024-02-01").cast("timestamp")
    rows = dump_rows(spark, sf)
    for new, path in enumerate(paths[:2]):
        part = rows.where(F.col("event_id") % 3 != new).withColumn("air_temp", F.col("air_temp") + new)
        dumps.write_annotated_csv(part.withColumn("_time", F.to_timestamp("timestamp", dumps.STAMP)), path, stop, compression="gzip")
    dumps.merge_dumps(spark, *paths, stop, compression="gzip")
    return dumps.read_annotated_csv(spark, paths[2]).select("id_board", "_field", us(), "_value")


@query("upsert_table", _UPSERTED, "points", _HOURLY)
def upsert_table(spark, sf):
    """The same upsert through a versioned table: the second write adds a part, reading merges the two."""
    p, path = events.points(spark, sf), scratch(spark)
    tables.write_points(hourly(p, 0, 0.0, 0), path)
    tables.write_points(hourly(p, 30, 1.0, 0), path)
    return _shown(tables.read_table(spark, path))


def predictions(spark, sf):
    w = events.wide(spark, sf)
    return w.select("id_board", F.date_trunc("hour", "_time").alias("_time"), F.col("leaf_temp").alias("leaf_temp_pred"),
                    F.col("air_temp").alias("air_temp_pred")).groupBy("id_board", "_time").agg(
        F.avg("leaf_temp_pred").alias("leaf_temp_pred"), F.avg("air_temp_pred").alias("air_temp_pred"))


@query("save_predictions", """SELECT s.name AS stored_in, id_board, f.name AS _field, t_us, v AS _value, 'T5' AS model_source, '6m' AS freq FROM (
  SELECT id_board, epoch_us(date_trunc('hour', _time)) AS t_us, round(avg(leaf_temp), 9) AS l, round(avg(air_temp), 9) AS a FROM wide GROUP BY 1, 2) p,
  LATERAL (VALUES ('leaf_temp_pred', l), ('air_temp_pred', a)) f(name, v), (VALUES ('clean'), ('archive')) s(name) WHERE v IS NOT NULL""", "wide")
def save_predictions(spark, sf):
    clean, archive = scratch(spark), scratch(spark)
    tables.save_predictions(predictions(spark, sf), clean, archive, "T5", 6)
    return reshape.union_all(*[
        tables.read_table(spark, path).select(F.lit(name).alias("stored_in"), "id_board", "_field", us(), F.round("_value", 9).alias("_value"), "model_source", "freq")
        for name, path in (("clean", clean), ("archive", archive))])


@query("reintegrate", """SELECT id_board, _field, t_us, _value, freq FROM (
 SELECT id_board, _field, epoch_us(t) AS t_us, round(arg_max(v, {'n': new, 's': seq}), 9) AS _value, freq FROM (
   SELECT *, 0 AS new FROM stored UNION ALL
   SELECT *, 1 AS new FROM arch WHERE freq = '6m' AND _field LIKE '%pred' AND t >= (SELECT max(t) FROM stored) - INTERVAL 60 MINUTE)
 WHERE v IS NOT NULL GROUP BY id_board, _field, t, freq)""", "points",
       """arch AS (SELECT id_board, _field || '_pred' AS _field, _time AS t, _value AS v, seq, CASE WHEN seq % 2 = 0 THEN '6m' ELSE '60m' END AS freq FROM points
  WHERE _field IN ('leaf_temp', 'air_temp', 'humidity')),
 stored AS (SELECT id_board, _field, t, v - 1 AS v, seq, freq FROM arch WHERE t < TIMESTAMP '2024-01-16')""")
def reintegrate(spark, sf):
    p = events.points(spark, sf).where(F.col("_field").isin("leaf_temp", "air_temp", "humidity"))
    archive = tables.as_points(p.withColumn("_field", F.concat("_field", F.lit("_pred"))).withColumn(
        "freq", F.when(F.col("seq") % 2 == 0, "6m").otherwise("60m")))
    stored = archive.where(F.col("_time") < F.lit("2024-01-16").cast("timestamp")).withColumn("_value", F.col("_value") - 1)
    out = joins.upsert_points(stored, joins.reintegrate(archive, stored, "6m", F.lit("2024-02-01").cast("timestamp")))
    return out.select("id_board", "_field", us(), F.round("_value", 9).alias("_value"), "freq")


@query("ensure_table", "SELECT id_board, _field, count(*) AS n FROM points GROUP BY 1, 2", "points")
def ensure_table(spark, sf):
    """A table made when missing, filled and read through its name."""
    path, name = scratch(spark), f"points_{uuid.uuid4().hex}"
    tables.ensure_table(spark, name, path)
    tables.ensure_table(spark, name, path)
    points = tables.as_points(events.points(spark, sf))
    points.withColumn(tables.DAY, F.to_date("_time")).write.insertInto(name)
    return spark.table(name).groupBy("id_board", "_field").agg(F.count(F.lit(1)).alias("n"))


@query("latest_n_per_hub", f"""SELECT star_id, seq, epoch_us(_time) AS t_us FROM packets
QUALIFY row_number() OVER (PARTITION BY star_id ORDER BY _time DESC, seq DESC) <= {C.RING_RECORDS}""", "packets")
def latest_n_per_hub(spark, sf):
    """The ring of a hub: a top-n report per hub."""
    return filters.tail(events.packets(spark, sf), C.RING_RECORDS, ["star_id"], ["_time", "seq"]).select("star_id", "seq", us())


@query("latest_snapshot", """SELECT node_id, arg_max(seq, {'t': _time, 's': seq}) AS seq, arg_max(value, {'t': _time, 's': seq}) AS value, epoch_us(max(_time)) AS t_us
FROM packets GROUP BY node_id""", "packets")
def latest_snapshot(spark, sf):
    return filters.latest_per(events.packets(spark, sf), ["node_id"], ["_time", "seq"]).select("node_id", "seq", "value", us())


@query("topology_round_trip", """SELECT node_id, arg_max(star_id, {'t': _time, 's': seq}) AS star_id FROM packets GROUP BY node_id""", "packets")
def topology_round_trip(spark, sf):
    path = scratch(spark)
    documents.write_topology(filters.latest_per(events.packets(spark, sf), ["node_id"], ["_time", "seq"]), path, parts=4)
    return documents.read_topology(spark, path)


@query("iso_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM ev")
def iso_stamps(spark, sf):
    return events.events(spark, sf).select("event_id", iso("ts").alias("stamp"))


@query("max_time", "SELECT epoch_us(max(_time)) AS t_us FROM points WHERE NOT regexp_matches(_field, 'pred')", "points")
def max_time(spark, sf):
    return agg.max_time(filters.filter_fields(events.points(spark, sf), "pred", negate=True)).select(us("max_time"))
