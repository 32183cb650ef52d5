"""Incremental cleaning, the whole retrain, and streams over several micro-batches."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import slicing as sl
from canopyflow.operators import joins
from canopyflow.operators import sequence as seq
from canopyflow.operators.reshape import pivot_fields
from canopyflow.plans import clean, cycle, forecast, history, learn, retrain
from canopyflow.plans.store import ModelStore
from canopyflow.sources import documents, tables
from canopyflow.streaming import state, telemetry

T0 = datetime(2024, 5, 1)


def raw_points(spark, boards=("b0", "b1"), n=300, step=2):
    rng = np.random.default_rng(1)
    rows, s = [], 0
    for b in boards:
        for i in range(n):
            for f in C.FIELDS:
                if rng.random() < 0.9:
                    rows.append((b, f, float(50 + 10 * np.sin(i / 60) + rng.normal()), T0 + timedelta(minutes=step * i), s))
                    s += 1
    return tables.as_points(spark.createDataFrame(rows, "id_board string, _field string, _value double, _time timestamp, seq long")).persist()


def as_dict(df):
    return {(r.id_board, r._field, r._time): r._value for r in df.collect()}


def test_incremental_clean_adds_only_newer_rows_per_board(spark):
    raw = raw_points(spark)
    whole = as_dict(clean.sync_clean(raw, raw.limit(0)))
    mark = {"b0": T0 + timedelta(hours=5), "b1": T0 + timedelta(hours=2)}
    stored = clean.sync_clean(raw, raw.limit(0))
    limit = F.when(F.col("id_board") == "b0", F.lit(mark["b0"])).otherwise(F.lit(mark["b1"]))
    stored = stored.where(F.col("_time") <= limit).persist()
    fresh = as_dict(clean.sync_clean(raw, stored))
    assert fresh and all(t > mark[b] for b, _, t in fresh)
    assert {k for k in whole if k[2] > mark[k[0]]} == set(fresh)
    far = {k: v for k, v in fresh.items() if k[2] > mark[k[0]] + timedelta(hours=1)}
    assert far == pytest.approx({k: whole[k] for k in far})
    late = as_dict(clean.sync_clean(raw, stored, global_watermark=True))
    assert all(t > mark["b0"] for _, _, t in late)


def test_alias_gives_way_to_the_stored_name(spark):
    rows = [("b", "tds", 1.0, T0, 1), ("b", "tds_value", 2.0, T0, 2), ("b", "tds_value", 3.0, T0 + timedelta(minutes=2), 3)]
    p = spark.createDataFrame(rows, "id_board string, _field string, _value double, _time timestamp, seq long")
    from canopyflow.operators.reshape import pivot_fields
    assert [r.tds for r in pivot_fields(clean.unify_points(p), ["tds"]).orderBy("_time").collect()] == [1.0, 3.0]


def test_retrain_and_score(spark, tmp_path):
    tasks = {"t4": C.TASKS["t4"], "t8": C.Task("t8", C.TASKS["t8"].features, True, False, 2), "t9": C.Task("t9", C.TASKS["t9"].features, True, True, 2)}
    raw_path, clean_path, archive, models = (str(tmp_path / n) for n in ("raw", "clean", "archive", "models"))
    tables.write_points(raw_points(spark, n=700), raw_path)
    ridge = [learn.Spec("Ridge_linear", "ridge", {"alpha": [1.0]})]
    steps = {"b1": (clean.TDS_FLOOR, clean.LEAF_FILL)}
    out = retrain.retrain(spark, raw_path, clean_path, models, 6, tasks, None, ridge, steps)
    assert out.count() == 3
    with pytest.raises(ValueError):
        retrain.check_freq(4)
    now = tables.read_table(spark, clean_path).agg(F.max("_time")).first()[0] + timedelta(minutes=6)
    catalogue = {"groups": ["C"], "single": ["t8"], "tasks": tasks, "group_tasks": {"C": ("t4", "t8", "t9")}}
    saved = cycle.run_forecasts(spark, clean_path, archive, models, 6, now, **catalogue)  # from the stored models alone
    stored = tables.read_table(spark, archive)
    assert stored.count() == saved.count() == 2 * 2 * 30 * 3 and {r.model_source for r in stored.select("model_source").distinct().collect()} == {"ENSEMBLE_C", "T8"}
    assert tables.read_table(spark, clean_path).where("_field rlike 'pred'").count() == saved.count()
    wide = pivot_fields(tables.read_table(spark, clean_path).where("_field not rlike 'pred'"))
    assert forecast.context(wide, 6, now=now + timedelta(days=8)).count() == 0  # silent for a week
    trained = ModelStore(spark, models).load(6)
    given = forecast.forecasts(wide, trained.season, trained.models, trained.mae, 6, what_if={"air_temp": 30.0}, **catalogue)
    for history_rows, rows in given.values():
        assert {tuple(r) for r in rows.groupBy("id_board").count().collect()} == {("b0", 30), ("b1", 30)}
        assert {r[0] for r in history_rows.groupBy("id_board").agg(F.max_by("air_temp", "_time")).select("max_by(air_temp, _time)").collect()} == {30.0}
    docs = {(r.id_board, r.model_source): r for r in forecast.documents(given, 6).collect()}
    assert set(docs) == {(b, s) for b in ("b0", "b1") for s in ("ENSEMBLE_C", "T8")}
    blended, plain = docs["b0", "ENSEMBLE_C"], docs["b0", "T8"]
    assert plain.ensemble_details is None and len(blended.ensemble_details.forecast_env) == len(blended.leaf_temperature.forecast) == 30
    w = blended.ensemble_details.weights
    for v, e, a in zip(blended.leaf_temperature.forecast, blended.ensemble_details.forecast_env, blended.ensemble_details.forecast_auto):
        assert v.timestamp == e.timestamp == a.timestamp and v.value == pytest.approx(w.environmental * e.value + w.autoregressive * a.value, abs=0.05)
    # a second training run replaces models and reports, copies archived forecasts back, and reads only newer raw points
    tables.write_points(raw_points(spark, n=720), raw_path)
    again = retrain.retrain(spark, raw_path, clean_path, models, 6, {"t4": tasks["t4"]}, None, ridge, steps, archive, now)
    assert [r.task for r in again.collect()] == ["t4"]
    reports = documents.read_report_lines(spark, f"{models}/6m/reports")
    assert sorted(r.task for r in reports.collect()) == ["t4", "t8", "t9"]
    runs = {r.task: r.run for r in ModelStore(spark, models).registry(6).collect()}
    assert runs["t4"] == runs["season"] != runs["t8"] == runs["t9"]


def test_sync_reads_only_the_days_it_needs(spark, tmp_path):
    raw_path, clean_path, archive = (str(tmp_path / n) for n in ("raw", "clean", "archive"))
    raw = raw_points(spark, n=3000)  # four days
    tables.write_points(raw, raw_path)
    whole = clean.sync_clean(tables.read_table(spark, raw_path), raw.limit(0)).persist()
    tables.write_points(whole.where(F.col("_time") < F.lit(T0 + timedelta(days=3))), clean_path)
    plan = cycle.newer_raw(spark, raw_path, tables.read_table(spark, clean_path))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    tables.write_points(tables.as_points(whole.limit(5).withColumn("_field", F.lit("leaf_temp_pred")).withColumn("_time", F.lit(T0 + timedelta(days=4))), model_source="T8", freq="6m"), archive)
    cycle.sync(spark, raw_path, clean_path, 6, archive, T0 + timedelta(days=5))
    got, want = as_dict(tables.read_table(spark, clean_path)), as_dict(whole)
    assert {k for k in got if "pred" not in k[1]} == set(want) and any("pred" in k[1] for k in got)
    far = {k: v for k, v in want.items() if k[2] > T0 + timedelta(days=3, hours=1)}
    assert {k: got[k] for k in far} == pytest.approx(far)
    new = raw.withColumn("id_board", F.lit("b7"))
    tables.write_points(new, raw_path)
    cycle.sync(spark, raw_path, clean_path, 6)
    assert tables.read_table(spark, clean_path).where("id_board = 'b7'").agg(F.min("_time")).first()[0] == T0


def test_sync_cleans_a_new_board_with_old_points_only(spark, tmp_path):
    raw_path, clean_path = str(tmp_path / "raw"), str(tmp_path / "clean")
    raw = raw_points(spark, n=3000)  # four days
    tables.write_points(raw, raw_path)
    whole = clean.sync_clean(tables.read_table(spark, raw_path), raw.limit(0))
    tables.write_points(whole, clean_path)
    dump = raw.where(F.col("_time") < F.lit(T0 + timedelta(days=1))).withColumn("id_board", F.lit("b9"))
    tables.write_points(dump, raw_path)
    cycle.sync(spark, raw_path, clean_path, 6)
    first, last = tables.read_table(spark, clean_path).where("id_board = 'b9'").agg(F.min("_time"), F.max("_time")).first()
    assert first == T0 and last >= T0 + timedelta(hours=23)


def test_history_prunes_days(spark, tmp_path):
    tables.write_points(raw_points(spark, n=1500), str(tmp_path / "t"))
    now = T0 + timedelta(days=200)
    stale = history.stored_history(spark, str(tmp_path / "t"), now, 24)
    assert stale.count() == 0 and "PartitionFilters: [isnotnull(day" in stale._jdf.queryExecution().executedPlan().toString()
    assert history.stored_history(spark, str(tmp_path / "t"), T0 + timedelta(days=2), 24).where("is_stale = false").count() > 0


def test_an_implausible_leaf_value_without_a_reading_is_cleared(spark):
    d = spark.createDataFrame([("b", T0 + timedelta(minutes=i), i, leaf, None, None) for i, leaf in enumerate([3.0, 18.0, None])],
                              "id_board string, _time timestamp, seq long, leaf_temp double, temp double, reading_id string")
    out = seq.apply_fallback(d, sl.Slicing(("id_board",))).orderBy("seq").collect()
    assert [(r.leaf_temp, r.leaf_source) for r in out] == [(None, "none"), (18.0, "sensor"), (None, "none")]


def files(spark, df, path, n):
    """``df`` in time order as n files, one per micro-batch."""
    lo, hi = df.agg(F.min("_time"), F.max("_time")).first()
    for i in range(n):
        a, b = lo + (hi - lo) * i / n, lo + (hi - lo) * (i + 1) / n
        part = df.where((F.col("_time") >= F.lit(a)) & ((F.col("_time") < F.lit(b)) if i < n - 1 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream, path):
    q = stream.writeStream.format("parquet").option("checkpointLocation", path + "-c").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def test_moisture_state_survives_micro_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"n{i % 3}", T0 + timedelta(minutes=i), i, None if rng.random() < .1 else float(rng.uniform(20, 90))) for i in range(300)]
    d = spark.createDataFrame(rows, "node_id string, _time timestamp, seq long, soil_moisture double")
    want = {r.seq for r in seq.moisture_alerts(d, sl.Slicing(("node_id",))).collect()}
    got = drain(spark, state.stream_moisture(files(spark, d, str(tmp_path / "in"), 4)), str(tmp_path / "out"))
    assert {r.seq for r in got.collect()} == want and want


def test_commands_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    t, rows = 0.0, []
    for i in range(120):
        t += float(rng.choice([1.5, 2.5, 4.25, 20.0]))
        rows.append((f"n{rng.integers(2)}", T0 + timedelta(seconds=t), i, bool(rng.random() < 0.6)))
    rows += [(n, T0 + timedelta(seconds=t + 3600), 900 + i, False) for i, n in enumerate(("n0", "n1"))]  # moves the watermark on
    d = spark.createDataFrame(rows, "node_id string, _time timestamp, seq long, is_command boolean")
    s = sl.Slicing(("node_id",))
    out = joins.command_outcomes(d.where("is_command").drop("is_command"), d.where("NOT is_command").drop("is_command"), s, 9_000_000)
    want = {(r.seq, r.attempt) for r in joins.retry_events(out, s, 3_000_000).collect()}
    stream = files(spark, d, str(tmp_path / "in"), 1).withWatermark("_time", "0 seconds")
    got = drain(spark, state.stream_commands(stream, time_mode="EventTime"), str(tmp_path / "out")).collect()
    assert {(r.seq, r.attempt) for r in got if r.event == "sent"} == want
    ended = {r.seq: r.event for r in got if r.event != "sent"}
    assert ended == {r.seq: r.status for r in out.collect() if r.status != "replaced"}


def test_event_time_from_device_or_arrival(spark):
    d = spark.createDataFrame([(1700000000, T0)], "timestamp long, at timestamp")
    assert telemetry.with_event_time(d).first()._time == datetime(2023, 11, 14, 22, 13, 20)
    assert telemetry.with_event_time(d, arrival="at").first()._time == T0


def test_stream_clean_keeps_the_clean_table_current(spark, tmp_path):
    raw = raw_points(spark, ("b0",), 120)
    src = files(spark, raw, str(tmp_path / "in"), 2)
    telemetry.stream_clean(src, str(tmp_path / "raw"), str(tmp_path / "clean"), str(tmp_path / "c")).awaitTermination()
    stamps = tables.read_table(spark, str(tmp_path / "clean")).select("_time").distinct().count()
    assert tables.read_table(spark, str(tmp_path / "raw")).count() == raw.count()
    assert stamps == 40


def test_leaf_readings_in_the_telemetry_stream(spark, tmp_path):
    frames = [(f'{{"sid":1,"id":5,"ts":{1700000000 + 120 * i},"at":20.5' + ("}" if i % 2 else ',"lt":18.5}'),) for i in range(6)]
    spark.createDataFrame(frames, "payload string").coalesce(1).write.parquet(str(tmp_path / "in"))
    readings = spark.createDataFrame([("5", 21.25, "A")], "board string, temp double, reading_id string")
    src = spark.readStream.schema("payload string").parquet(str(tmp_path / "in"))
    p = telemetry.telemetry_points(telemetry.telemetry_rows(src), readings)
    telemetry.store_points(p, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = tables.read_table(spark, str(tmp_path / "t")).where("_field = 'leaf_temp'").orderBy("_time").collect()
    assert [r._value for r in got] == [18.5, 21.25] * 3


def test_topology_moves_on_over_micro_batches(spark, tmp_path):
    rows = [(f"n{i % 4}", f"h{i // 10}", T0 + timedelta(minutes=i), i) for i in range(40)] + [("n9", "h7", T0 + timedelta(minutes=3), 50)]
    d = spark.createDataFrame(rows, "node_id string, star_id string, _time timestamp, seq long")
    telemetry.stream_topology(files(spark, d, str(tmp_path / "in"), 3), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = {r.node_id: r.star_id for r in telemetry.live_topology(spark, str(tmp_path / "t")).collect()}
    assert got == {"n0": "h3", "n1": "h3", "n2": "h3", "n3": "h3", "n9": "h7"}
    assert telemetry.live_topology(spark, str(tmp_path / "none")) is None
