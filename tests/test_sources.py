"""Files in and out."""

import gzip
import json
import struct
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import filters, joins
from canopyflow.sources import documents, dumps, packets, tables, uplink

T0 = datetime(2024, 6, 1, 12)


def packet(ts, node, *values):
    return struct.pack("<IIffffffff", ts, node, *(values or (1.234, 2, 3, 4, 5, 6, 101325.0, 20.005)))


def test_packets_from_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(packet(1700000000, 4294967295) + packet(0, 7) + b"1234567")
    (tmp_path / "b.bin").write_bytes(b"")
    rows = {r.node_id: r for r in packets.read_dump_blobs(spark, str(tmp_path)).collect()}
    assert set(rows) == {4294967295, 7}
    assert rows[7].water_temp == 1.23 and rows[7].pressure == 101325.0


def test_packet_gate(spark):
    d = spark.createDataFrame([(1, b""), (2, packet(5, 5)[:39]), (3, packet(0, 0)), (4, packet(0, 9)), (5, None)], "i int, data binary")
    assert [r.i for r in filters.valid_packets(d).collect()] == [4]


def test_uplink_keeps_unknown_keys(spark):
    lines = ['{"sid":1,"id":2,"lt":21.5,"x":7}', '{"sid":1,"sync":1}', "not json", "{}"]
    good, dead = uplink.decode_uplink(spark.createDataFrame([(x,) for x in lines], "payload string"))
    rows = good.orderBy("node_id").collect()
    assert rows[1].leaf_temp == 21.5 and rows[1].extra == {"x": "7"} and rows[0].sync == "1"
    assert sorted(r.payload for r in dead.collect()) == ["not json", "{}"]


def test_annotated_file_with_repeated_headers(spark, tmp_path):
    head = [*dumps.ANNOTATIONS, ",".join(dumps.HEADER)]
    row = ",,0,1970-01-01T00:00:00Z,2024-01-01T00:00:00Z,2023-05-01T10:00:00Z,{},air_temp,sensor_measurements,42"
    (tmp_path / "d.csv").write_text("\n".join([*head, row.format("1.5"), "", *head, row.format("")]) + "\n")
    rows = dumps.read_annotated_csv(spark, str(tmp_path / "d.csv")).collect()
    assert sorted((r._value is None, r.id_board, r._field) for r in rows) == [(False, "42", "air_temp"), (True, "42", "air_temp")]
    assert rows[0]._time == datetime(2023, 5, 1, 10)


def test_annotated_parts_begin_with_the_annotations(spark, tmp_path):
    dump = spark.createDataFrame([("2024-01-01 00:00:00", 5, *[1.0] * 8)], dumps.PLAIN).withColumn("_time", F.lit(T0))
    dumps.write_annotated_csv(dump, str(tmp_path / "o"), F.lit(T0))
    text = [p.read_text().splitlines() for p in (tmp_path / "o").glob("part-*") if p.stat().st_size]
    assert all(t[:3] == list(dumps.ANNOTATIONS) and t[3] == ",".join(dumps.HEADER) for t in text)
    assert sum(len(t) - 4 for t in text) == 8


def test_annotated_parts_are_compressed_and_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dumps, "FILE_ROWS", 3)
    dump = spark.createDataFrame([("2024-01-01 00:00:00", i, *[1.0 + i] * 8) for i in range(2)], dumps.PLAIN).withColumn("_time", F.lit(T0)).coalesce(1)
    a, b, c = (str(tmp_path / x) for x in "abc")
    dumps.write_annotated_csv(dump, a, F.lit(T0), compression="gzip")
    dumps.write_annotated_csv(dump.withColumns({"node_id": F.col("node_id") + 1, **{x: F.col(x) + 9 for x in dumps.PLAIN.names[2:]}}), b, F.lit(T0), compression="gzip")
    dumps.merge_dumps(spark, a, b, c, F.lit(T0), compression="gzip")
    for path, rows in ((a, 16), (c, 24)):
        text = [gzip.decompress(p.read_bytes()).decode().splitlines() for p in Path(path).glob("part-*.gz")]
        text = [t for t in text if t]
        assert all(t[:3] == list(dumps.ANNOTATIONS) and t[3] == ",".join(dumps.HEADER) and len(t) <= 7 for t in text)
        assert sum(len(t) - 4 for t in text) == rows
    got = {(r.id_board, r._value) for r in dumps.read_annotated_csv(spark, c).collect()}
    assert got == {("0", 1.0), ("1", 10.0), ("2", 11.0)}


def test_local_stamps_can_be_read_as_local(spark, tmp_path):
    d = spark.createDataFrame([("2024-07-01 12:00:00", 5, *[1.0] * 8)], dumps.PLAIN)
    dumps.write_dump_csv(d, str(tmp_path / "c"))
    utc, rome = (dumps.read_dump_csv(spark, str(tmp_path / "c"), z).first()._time for z in ("UTC", "Europe/Rome"))
    assert (utc, rome) == (datetime(2024, 7, 1, 12), datetime(2024, 7, 1, 10))


def test_topology_file(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"1": "9", "2": "8"}, indent=2))
    assert {tuple(r) for r in documents.read_topology(spark, str(tmp_path / "t.json")).collect()} == {("1", "9"), ("2", "8")}


def test_report_tree(spark, tmp_path):
    folder = tmp_path / "t3" / "models_archive"
    folder.mkdir(parents=True)
    (folder / "Ridge_metrics.json").write_text(json.dumps({
        "model_name": "Ridge", "best_params": {"regressor__alpha": 0.1}, "metrics": {m: 1.0 for m in documents.METRICS},
        "performance": {m: 0.5 for m in documents.TIMINGS}, "feature_importance": {"a": 1.0}}, indent=4))
    (folder / "other.json").write_text("{}")
    r = documents.read_reports(spark, str(tmp_path))
    row = r.first()
    assert r.count() == 1 and (row.task, row.model_name, row.best_params, row.MAE) == ("t3", "Ridge", {"regressor__alpha": "0.1"}, 1.0)
    documents.write_reports(r, str(tmp_path / "out"))
    again = documents.read_report_lines(spark, str(tmp_path / "out")).first()
    assert (again.task, again.model_name, again.feature_importance, again.train_R_squared) == ("t3", "Ridge", {"a": 1.0}, 1.0)


def points(spark, rows):
    return tables.as_points(spark.createDataFrame([("b", "air_temp", v, t, s) for t, v, s in rows], "id_board string, _field string, _value double, _time timestamp, seq long"))


def test_table_upsert(spark, tmp_path):
    path = str(tmp_path / "p")
    day2 = T0.replace(day=2)
    tables.write_points(points(spark, [(T0, 1.0, 1), (day2, 2.0, 2)]), path)
    tables.write_points(points(spark, [(T0, 9.0, 0), (T0, None, 5)]), path)
    assert {r._time: r._value for r in tables.read_table(spark, path).collect()} == {T0: 9.0, day2: 2.0}
    assert tables.read_table(spark, path, since="2024-06-02").count() == 1


def test_day_folders_are_pruned(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.write_points(points(spark, [(T0, 1.0, 1)]), path)
    plan = tables.read_table(spark, path, "2024-06-01", "2024-06-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(_time)" in plan


def test_missing_table_is_empty(spark, tmp_path):
    assert tables.read_table(spark, str(tmp_path / "none")).count() == 0


def test_isolate_without_target(spark):
    d = spark.createDataFrame([(1.0,)], "air_temp double")
    assert filters.isolate(d, ["air_temp"], "leaf_temp") == (None, ["leaf_temp"])


def test_reintegrate_without_stored_forecasts_takes_a_week(spark):
    t = [datetime(2024, 5, d) for d in (1, 25)]
    arch = points(spark, [(x, 1.0, i) for i, x in enumerate(t)]).withColumn("_field", F.lit("leaf_temp_pred")).withColumn("freq", F.lit("6m"))
    out = joins.reintegrate(arch, arch.limit(0), "6m", F.lit(datetime(2024, 5, 30)))
    assert [r._time for r in out.collect()] == [t[1]]


def test_all_boards_when_topology_is_unavailable(spark):
    d = spark.createDataFrame([("b2",), ("b1",), (None,), ("b2",)], "id_board string")
    assert [r[0] for r in joins.available_boards(d, None).collect()] == ["b1", "b2"]


def test_ring_size():
    assert C.RING_RECORDS == 410


@pytest.mark.parametrize("text, want", [("21,5", 21.5), (" 7.25x", 7.25), ("x7", None), ("1,2,3", 1.2)])
def test_leading_number(spark, text, want):
    from canopyflow.functions.text import leading_number
    assert spark.createDataFrame([(text,)], "s string").select(leading_number(F.col("s"))).first()[0] == want


def test_ring_logs_are_read_once_as_they_grow(spark, tmp_path, monkeypatch):
    from canopyflow.sources import rings
    rec = lambda t: np.array([(t, 7, *[1.5] * 8)], packets.RECORD).tobytes()
    logs, out, marks = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "c")
    logs.mkdir()
    (logs / "note.txt").write_text("x")
    (logs / "h1.bin").write_bytes(rec(1) + rec(2) + rec(3)[:17])

    def poll():
        d = packets.decode_packets(rings.stream_rings(spark, str(logs)))
        d.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.hub, r.timestamp) for r in spark.read.parquet(out).collect())

    assert poll() == [("h1", 1), ("h1", 2)]
    with (logs / "h1.bin").open("ab") as f:
        f.write(rec(3)[17:] + rec(4))
    (logs / "h2.bin").write_bytes(rec(9))
    want = [("h1", 1), ("h1", 2), ("h1", 3), ("h1", 4), ("h2", 9)]
    assert poll() == want and poll() == want
    reader = rings.RingReader(f"file://{logs}")
    monkeypatch.setattr(rings, "_TASK_RECORDS", 3)
    monkeypatch.setattr(rings, "_BATCH_RECORDS", 2)
    parts = reader.partitions({"hubs": '{"h1": 40, "h2": 999}'}, reader.latestOffset())
    assert [(p.hub, p.start, p.stop) for p in parts] == [("h1", 40, 160), ("h2", 0, 40)]  # h2 was begun anew
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 4
