"""Versioned tables: what readers see when writers die, race, repeat themselves and merge."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from canopyflow.sources import tables
from canopyflow.sources.versions import VersionedTable

T0 = datetime(2024, 6, 1)


def points(spark, rows):
    rows = [("b", "air_temp", v, T0 + timedelta(hours=h), s) for h, v, s in rows]
    return tables.as_points(spark.createDataFrame(rows, "id_board string, _field string, _value double, _time timestamp, seq long"))


def shown(df):
    return {int((r._time - T0).total_seconds() // 3600): r._value for r in df.collect()}


def test_a_write_that_dies_before_its_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.write_points(points(spark, [(0, 1.0, 0), (30, 2.0, 0)]), path)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            tables.write_points(points(spark, [(0, 9.0, 0)]), path)
    assert len(list((tmp_path / "t" / "parts").iterdir())) == 2  # its files are there
    assert shown(tables.read_table(spark, path)) == {0: 1.0, 30: 2.0}
    tables.point_table(spark, path).vacuum(grace_s=3600)
    assert len(list((tmp_path / "t" / "parts").iterdir())) == 2  # they may be of a running write
    tables.point_table(spark, path).vacuum(grace_s=0)
    assert len(list((tmp_path / "t" / "parts").iterdir())) == 1
    tables.write_points(points(spark, [(0, 9.0, 0)]), path)
    assert shown(tables.read_table(spark, path)) == {0: 9.0, 30: 2.0}


def test_a_commit_that_dies_half_written_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_points(points(spark, [(0, 1.0, 0)]), path)
    (tmp_path / "t" / "commits" / "000000000002.json.abc.tmp").write_text('{"parts": [{"na')
    tables.write_points(points(spark, [(1, 2.0, 0)]), path)
    assert shown(tables.read_table(spark, path)) == {0: 1.0, 1: 2.0}


def test_of_two_writers_none_is_lost(spark, tmp_path):
    path = str(tmp_path / "t")
    table = tables.point_table(spark, path)
    put, others = table.files.put, [7.0]

    def raced(name, text):
        if others:
            tables.write_points(points(spark, [(0, others.pop(), 0)]), path)  # takes the number first
        return put(name, text)

    table.files.put = raced
    version = table.append(points(spark, [(0, 8.0, 0), (1, 1.0, 0)]))
    assert version.number == 2 and [p.commit for p in version.parts] == [1, 2]
    assert shown(table.read()) == {0: 8.0, 1: 1.0}  # the later commit wins


def test_a_repeated_batch_is_left_out(spark, tmp_path):
    path = str(tmp_path / "t")
    for value, writer, batch in ((1.0, "w", 0), (2.0, "w", 1), (9.0, "w", 1), (9.0, "w", 0)):
        tables.write_points(points(spark, [(0, value, 0)]), path, writer, batch)
    assert shown(tables.read_table(spark, path)) == {0: 2.0}
    tables.write_points(points(spark, [(0, 3.0, 0)]), path, "a new stream", 0)
    assert shown(tables.read_table(spark, path)) == {0: 3.0}


def test_appends_do_not_read_what_is_stored(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.write_points(points(spark, [(h, 1.0, 0) for h in range(100)]), path)
    monkeypatch.setattr(VersionedTable, "_rows", None)
    table = tables.point_table(spark, path)
    sizes = [table.append(points(spark, [(h, 2.0, 0)])).parts[-1].size for h in range(2)]
    assert len(list((tmp_path / "t" / "parts").rglob("*.parquet"))) < 10 and max(sizes) < 6000


def test_merged_parts_hold_the_same_rows(spark, tmp_path):
    rnd, path, want = random.Random(1), str(tmp_path / "t"), {}
    for i in range(24):
        rows = [(rnd.randrange(60), float(rnd.randrange(1000)), rnd.randrange(3)) for _ in range(rnd.choice([1, 3, 20]))]
        rows += [(rnd.randrange(60), None, 99)]
        tables.write_points(points(spark, rows).coalesce(1), path)
        last = {}
        for h, v, s in rows:
            if v is not None and (h not in last or s > last[h][0]):
                last[h] = (s, v)
        tied = {h for h in last if len({v for k, v, s in rows if k == h and s == last[h][0] and v is not None}) > 1}
        want |= {h: None if h in tied else v for h, (_, v) in last.items()}
    table = tables.point_table(spark, path)
    now = table.version()
    assert now.number > 24 and len(now.parts) <= 9 and len(list((tmp_path / "t" / "commits").glob("*.json"))) <= 10
    got = shown(table.read())
    assert set(got) == set(want) and all(got[h] == v for h, v in want.items() if v is not None)
    while table.compact(ratio=1e9):
        pass
    assert [p.merged for p in table.version().parts] == [True] and shown(table.read()) == got
    assert "Aggregate" not in table.read()._jdf.queryExecution().executedPlan().toString()  # one merged part needs no merging
    assert shown(table.read(version=now.number)) == got  # an older version is still there
    day = F.col(tables.DAY) == F.lit("2024-06-02").cast("date")
    assert shown(table.read(day)) == {h: v for h, v in got.items() if 24 <= h < 48}


def test_rows_that_come_during_a_compaction_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in (1.0, 2.0):
        tables.write_points(points(spark, [(0, v, 0), (int(v), v, 0)]), path)
    table = tables.point_table(spark, path)
    write = table._write

    def slow(rows):
        name = write(rows)
        tables.write_points(points(spark, [(0, 3.0, 0)]), path)
        return name

    table._write = slow
    table.compact()
    assert [p.merged for p in table.version().parts] == [True, False] and shown(table.read()) == {0: 3.0, 1: 1.0, 2: 2.0}


def test_order_by_columns_and_tables_without_folders(spark, tmp_path):
    schema = "k string, v long, at long"
    make = lambda rows: spark.createDataFrame(rows, schema)
    table = VersionedTable(spark, str(tmp_path / "t"), make([]).schema, ["k"], ["at"])
    assert table.read().count() == 0 and table.compact() is None
    table.append(make([("a", 1, 10), ("b", 1, 10)]))
    table.append(make([("a", 2, 5), ("b", 2, 20)]))  # a is an old report that came late
    want = {("a", 1, 10), ("b", 2, 20)}
    assert set(map(tuple, table.read().collect())) == want
    table.compact()
    table.vacuum(keep=1, grace_s=0)
    assert set(map(tuple, table.read().collect())) == want and len(list((tmp_path / "t" / "parts").iterdir())) == 1
