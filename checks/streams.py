"""Streams over the events table, read as files and run until everything there is taken."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.session import materialise, prepare
from canopyflow.sources import events, packets, rings, tables
from canopyflow.streaming import controller, state, telemetry
from checks import joins, sequences
from checks.basics import r
from checks.registry import SQL, query
from checks.scans import packet_rows, scratch, us

MIN = 60_000_000
HOUR = 60 * MIN


def source(spark, sf):
    """The events table as a file stream with the columns of the packet view."""
    prepare(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(T.StructType(schema.fields)).option("pathGlobFilter", "events.parquet").parquet(sf)
    user = F.col("user_id")
    return raw.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("n"), (user % 20).cast("string")).alias("node_id"), F.concat(F.lit("h"), (user % 7).cast("string")).alias("star_id"),
        events.board().alias("id_board"), F.col("ts").cast("timestamp").alias("_time"), "event_type", "value", "user_id",
        F.get_json_object("props", "$.k").cast("double").alias("k"))


def taken(spark, df, mode="append"):
    """Run a stream into files and read them back."""
    out, marks = scratch(spark), scratch(spark)
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("stream_moisture")
def stream_moisture(spark, sf):
    p = source(spark, sf).select("node_id", "_time", "seq", F.col("k").alias("soil_moisture"))
    return taken(spark, state.stream_moisture(p)).withColumn("t_us", F.unix_micros("_time")).drop("_time")


SQL["stream_moisture"] = SQL["moisture_alerts"]  # the stream gives the rows of its batch twin


@query("stream_fallback")
def stream_fallback(spark, sf):
    """The reading in force is looked up in batch and stored; the stream counts its uses."""
    from canopyflow.operators.joins import fallback_lookup
    tel, readings = sequences.leaf_packets(spark, sf)
    path = scratch(spark)
    looked = fallback_lookup(tel, readings, events.board_slices(spark, sf))
    looked.write.parquet(path)
    stream = spark.readStream.schema(looked.schema).option("maxFilesPerTrigger", 1000).parquet(path)
    return taken(spark, state.stream_fallback(stream)).select("seq", "leaf_temp", "use_no", "leaf_source")


SQL["stream_fallback"] = SQL["apply_fallback"]


@query("stream_window_mean", f"""SELECT * FROM (SELECT id_board, _field, (epoch_us(_time) // {30 * MIN} + 1) * {30 * MIN} AS t_us, round(avg(_value), 9) AS _value FROM points GROUP BY 1, 2, 3)
WHERE t_us <= (SELECT epoch_ms(max(ts)) * 1000 - {10 * MIN} FROM ev)""", "points")
def stream_window_mean(spark, sf):
    s = source(spark, sf)
    names = F.create_map(*[F.lit(x) for kv in events.EVENT_FIELDS.items() for x in kv])
    readings = F.array(F.struct(names[F.col("event_type")].alias("_field"), F.col("value").alias("_value")),
                       F.struct(F.lit("soil_moisture").alias("_field"), F.col("k").alias("_value")))
    p = s.withWatermark("_time", "10 minutes").select("id_board", "_time", F.inline(readings).alias("_field", "_value"))
    return taken(spark, telemetry.stream_window_mean(p, 30)).select("id_board", "_field", us(), r("_value").alias("_value"))


@query("stream_dedupe_paths", "SELECT DISTINCT node_id, epoch_us(_time) AS t_us FROM packets", "packets")
def stream_dedupe_paths(spark, sf):
    """Every packet comes by both ways."""
    s = source(spark, sf).withWatermark("_time", "10 minutes").withColumn("path", F.explode(F.array(F.lit("radio"), F.lit("local"))))
    return taken(spark, telemetry.dedupe_paths(s.select("node_id", "_time", "path"))).select("node_id", us())


@query("stream_topology", "SELECT node_id, arg_max(star_id, {'t': _time, 's': seq}) AS star_id FROM packets GROUP BY node_id", "packets")
def stream_topology(spark, sf):
    path = scratch(spark)
    telemetry.stream_topology(source(spark, sf).select("node_id", "star_id", "_time", "seq"), path, scratch(spark)).awaitTermination()
    return telemetry.live_topology(spark, path).select("node_id", "star_id")


@query("stream_points", """SELECT id_board, _field, t_us, _value FROM (
 SELECT CAST(user_id AS VARCHAR) AS id_board, epoch_us(ts) // 1000000 * 1000000 AS t_us, max(value) AS a, max(k) AS s FROM ev WHERE CAST(k AS BIGINT) % 10 > 1 AND user_id <> 0 GROUP BY 1, 2),
 LATERAL (VALUES ('air_temp', a), ('soil_moisture', s)) f(_field, _value)""")
def stream_points(spark, sf):
    """Radio frames to stored points: decode, gates, event time, upsert."""
    s = source(spark, sf)
    num = lambda c: F.format_string("%.2f", c)
    full = F.concat(F.lit('{"sid":'), (F.col("user_id") % 7).cast("string"), F.lit(',"ts":'), F.unix_seconds("_time").cast("string"), F.lit(',"id":'),
                    F.col("user_id").cast("string"), F.lit(',"at":'), num("value"), F.lit(',"sm":'), num("k"), F.lit("}"))
    kind = F.col("k").cast("long") % 10
    frames = s.select(F.when(kind == 0, F.lit('{"sid":')).when(kind == 1, F.lit('{"sid":3,"sync":1}')).otherwise(full).alias("payload"))
    path = scratch(spark)
    telemetry.store_points(telemetry.telemetry_points(telemetry.telemetry_rows(frames)), path, scratch(spark)).awaitTermination()
    return tables.read_table(spark, path).select("id_board", "_field", us(), "_value")


@query("stream_commands", f"""SELECT node_id, seq, CAST(a AS INT) AS attempt, t // 1000 + (a - 1) * {3 * HOUR // 1000} AS at_ms FROM ended, (VALUES (1), (2), (3)) v(a)
WHERE a = 1 OR t + (a - 1) * 3 * {HOUR} < end_us""", "packets", joins._OUT)
def stream_commands(spark, sf):
    """All sends of commands; a late acknowledgement of another node moves the watermark past the last retries."""
    p = events.packets(spark, sf).where(F.col("event_type").isin("purchase", "signup"))
    d = p.select("node_id", "seq", "_time", (F.col("event_type") == "purchase").alias("is_command"))
    end = d.agg(F.max("_time").alias("_last")).select(F.lit("end").alias("node_id"), F.lit(0).cast("long").alias("seq"), (F.col("_last") + F.expr("INTERVAL 90 DAYS")).alias("_time"), F.lit(False).alias("is_command"))
    path = scratch(spark)
    d.unionByName(end).write.parquet(path)
    rows = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1000).parquet(path).withWatermark("_time", "1 hour")
    sent = taken(spark, state.stream_commands(rows, 3 * HOUR // 1000, time_mode="EventTime")).where("event = 'sent'")
    return sent.select("node_id", "seq", "attempt", "at_ms")


class Arrivals:
    """A frame that arrives as a stream, in four lots: in time order, but every third row a lot too late."""

    def __init__(self, spark, df, lo, hi):
        lot = F.floor((F.unix_micros("_time") - lo) * 4 / (hi - lo + 1)) + F.when(F.col("seq") % 3 == 0, 1).otherwise(0)
        self.spark, self.path, self.lots = spark, scratch(spark), materialise(df.withColumn("lot", F.least(lot, F.lit(3)).cast("int")), "lot")
        self.schema = df.schema

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def arrive(self, i):
        self.lots.where(F.col("lot") == i).drop("lot").write.mode("append").parquet(self.path)


def late_days(lo, hi):
    """More than two lots."""
    return max(20, (hi - lo) // (2 * 24 * HOUR) + 1)


def end_of(packets, late):
    """A packet of another board long after all others, so that the watermark passes those."""
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in packets.schema if f.name not in ("id_board", "_time", "seq")]
    end = packets.agg(F.max("_time").alias("_last")).select(F.lit("end").alias("id_board"), (F.col("_last") + F.expr(f"INTERVAL {late + 70} DAYS")).alias("_time"), F.lit(0).cast("long").alias("seq"), *rest)
    return packets.unionByName(end)


def controlled(spark, packets, readings, rules, run):
    """Let packets and readings arrive lot by lot; ``run`` starts the query that works them through."""
    t = F.unix_micros("_time")
    bounds = packets.agg(F.min(t), F.max(t)).first()  # one row
    late = late_days(*bounds)
    sources = [Arrivals(spark, d, *bounds) for d in (end_of(packets, late), readings) if d is not None]
    for i in range(4):
        for s in sources:
            s.arrive(i)
        run(controller.controlled(*[s.stream() for s in sources], rules=rules, lateness=f"{late} days")).awaitTermination()


def to_files(spark):
    out, marks = scratch(spark), scratch(spark)
    return out, lambda d: d.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out)


@query("stream_readings")
def stream_readings(spark, sf):
    """Readings in force and their uses, though packets and readings come out of order in several micro-batches."""
    tel, readings = sequences.leaf_packets(spark, sf)
    out, run = to_files(spark)
    controlled(spark, tel, readings, (), run)
    return spark.read.parquet(out).where("id_board <> 'end'").select("seq", "leaf_temp", "use_no", "leaf_source")


SQL["stream_readings"] = SQL["apply_fallback"]

RULES = (controller.LOW_MOISTURE,
         controller.Rule("hot_air", ("air_temp",), lambda p: p["air_temp"] > 30, 3, ("fan", 128, 30)),
         controller.Rule("damp_and_wet", ("humidity", "soil_moisture"), lambda p: (p["humidity"] > 20) & (p["soil_moisture"] >= 50), 2, ("fan", 255, 120)),
         controller.Rule("broken", ("soil_moisture",), lambda p: p["not a column"] > 0, 1, ("pump", 1, 1)))

_RULED = """r AS (SELECT id_board, seq, _time, 'low_soil_moisture' AS rule, soil < 70 AS holds, 5 AS patience FROM b WHERE soil IS NOT NULL
  UNION ALL SELECT id_board, seq, _time, 'hot_air', air > 30, 3 FROM b WHERE air IS NOT NULL
  UNION ALL SELECT id_board, seq, _time, 'damp_and_wet', humidity > 20 AND soil >= 50, 2 FROM b WHERE humidity IS NOT NULL AND soil IS NOT NULL),
 i AS (SELECT *, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY rule, id_board ORDER BY _time, seq ROWS UNBOUNDED PRECEDING) AS island FROM r),
 fired AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule, id_board, island ORDER BY _time, seq) AS n FROM i WHERE holds) WHERE n % patience = 0)"""
_BOARD_ROWS = """b AS (SELECT event_id AS seq, 'n' || (user_id % 20) AS id_board, ts AS _time, k AS soil, CASE WHEN event_type = 'view' THEN value END AS air,
  CASE WHEN event_type = 'click' THEN value END AS humidity FROM ev)"""


@query("stream_rules", "SELECT id_board, rule, seq, epoch_us(_time) AS t_us FROM fired", "ev", f"{_BOARD_ROWS}, {_RULED}")
def stream_rules(spark, sf):
    """Three rules and a broken one, for every node, over several micro-batches."""
    out, run = to_files(spark)
    controlled(spark, node_packets(spark, sf), None, RULES, run)
    return spark.read.parquet(out).select("id_board", F.explode("fired").alias("rule"), "seq", us())


def node_packets(spark, sf):
    p = events.packets(spark, sf)
    told = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    return p.select(F.col("node_id").alias("id_board"), "_time", "seq", "star_id", F.col("k").alias("soil_moisture"), told("view").alias("air_temp"),
                    told("click").alias("humidity"), told("signup").alias("leaf_temp"))


@query("stream_controller", """SELECT 'command' AS kind, id_board, rule AS name, epoch_us(_time) AS t_us, CASE WHEN rule = 'hot_air' THEN 128.0 ELSE 255.0 END AS value FROM fired
 UNION ALL SELECT 'point', id_board, f.name, epoch_us(_time), f.v FROM b JOIN leaf USING (seq),
  LATERAL (VALUES ('soil_moisture', soil), ('air_temp', air), ('humidity', humidity), ('leaf_temp', leaf_temp)) f(name, v) WHERE f.v IS NOT NULL
 UNION ALL SELECT 'hub', node_id, arg_max(star_id, {'t': _time, 's': seq}), epoch_us(max(_time)), NULL FROM packets GROUP BY node_id""", "ev packets",
       f"""{_BOARD_ROWS}, {_RULED}, {sequences._READ.replace("'b' || (user_id % 2)", "'n' || (user_id % 20)").replace("PARTITION BY user_id % 2", "PARTITION BY user_id % 20")},
 leaf AS (SELECT seq, CASE WHEN use_no <= 14 THEN temp WHEN use_no IS NULL AND leaf < 5 THEN NULL ELSE leaf END AS leaf_temp FROM applied)""")
def stream_controller(spark, sf):
    """Points, commands and topology that one stream leaves behind."""
    points, commands, hubs, marks = (scratch(spark) for _ in range(4))
    _, readings = sequences.leaf_packets(spark, sf)
    nodes = events.packets(spark, sf).select("seq", F.col("node_id").alias("node"))
    readings = readings.join(nodes, "seq").withColumn("id_board", F.col("node")).drop("node")
    controlled(spark, node_packets(spark, sf), readings, RULES, lambda d: controller.run_controller(d, points, commands, marks, hubs, RULES))
    value = lambda c: c.cast("double").alias("value")
    fired = controller.command_table(spark, commands).read()
    live = telemetry.topology_table(spark, hubs).read()
    return fired.select(F.lit("command").alias("kind"), "id_board", F.col("rule").alias("name"), us(), value(F.col("val"))).unionByName(
        tables.read_table(spark, points).select(F.lit("point").alias("kind"), "id_board", F.col("_field").alias("name"), us(), value(F.col("_value")))).unionByName(
        live.select(F.lit("hub").alias("kind"), F.col("node_id").alias("id_board"), F.col("star_id").alias("name"), us(), value(F.lit(None))))


@query("stream_packets", """SELECT event_id % 3 AS poll, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS stamp, user_id AS node_id, value AS air_temp FROM ev""")
def stream_packets(spark, sf):
    """Hub logs that grow between three polls; each record is decoded once."""
    rows, folder = packet_rows(spark, sf), scratch(spark).removeprefix("file://")
    out, marks = scratch(spark), scratch(spark)
    for poll in range(3):
        log_records(rows.where(F.col("event_id") % 3 == poll).select("data"), folder, poll)
        d = packets.decode_packets(rings.stream_rings(spark, folder))
        d.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
    d = spark.read.parquet(out)
    return d.select(F.substring_index("hub", "-", 1).cast("long").alias("poll"), F.col("timestamp").alias("stamp"), "node_id", "air_temp")


def log_records(rows, folder, poll):
    """A log for each task; a task that runs again writes the same bytes."""
    uri = folder if "://" in folder else f"file://{folder}"

    def write(batches):
        system, root = fs.FileSystem.from_uri(uri)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{poll}-{TaskContext.get().partitionId()}.bin") as f:
            for batch in batches:
                f.write(b"".join(batch.column("data").to_pylist()))
        yield pa.RecordBatch.from_pydict({"done": [True]})

    rows.mapInArrow(write, "done boolean").collect()  # a row for each task
