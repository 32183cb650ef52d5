"""The controller's work on live telemetry: operators' readings in force, rules, points, commands and topology in one stream.

Packets and readings are rows of one stream, told apart by ``is_reading``. A board's packets wait until the watermark has passed them, so
all readings before them are there, whatever the order of arrival; then they are worked through in event time. What counts for a
packet does not depend on how rows fall into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from canopyflow import config as C
from canopyflow.operators.filters import latest_per
from canopyflow.operators.reshape import to_points
from canopyflow.operators.sequence import alert_level
from canopyflow.session import materialise
from canopyflow.sources import tables
from canopyflow.sources.versions import VersionedTable
from canopyflow.streaming import telemetry
from canopyflow.streaming.state import count_rule, count_uses, use_rocksdb

HOUR_US = 3_600_000_000
#: packets of a board that a task works through at once, or more if an hour holds more
CHUNK = 50_000
#: bytes of rows that a task gathers before it puts them together or to those that wait
GATHER = 32 << 20
#: most rows that travel as one, and how many an hour has to have for that
PACK, LEAST = 512, 16
PACKED, ARRIVED = "packed_rows", "_arrived"  # the first as a name that pandas keeps in a tuple
TOLD = pa.schema([("at_us", pa.int64()), ("seq", pa.int64()), ("temp", pa.float64()), ("reading_id", pa.string())])


@dataclass(frozen=True)
class Rule:
    """A command that is fired when ``holds`` was true ``patience`` times since it was false or fired last.

    ``holds`` takes a frame of packets and gives a truth value for each. Packets without one of the columns in ``needs`` neither count
    nor reset. A rule that raises is left out for the packets it was given, and says so in their ``failed``; others are not touched.
    """

    name: str
    needs: tuple[str, ...]
    holds: Callable[[pd.DataFrame], pd.Series]
    patience: int
    command: tuple[str, int, int]


LOW_MOISTURE = Rule("low_soil_moisture", ("soil_moisture",), lambda p: p["soil_moisture"] < C.SOIL_LOW, C.SOIL_PATIENCE, C.PUMP)


def wire_schema(columns: list[str], kinds: list[str]) -> pa.Schema:
    return pa.schema([(c, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[k]) for c, k in zip(columns, kinds)])


def packed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Put rows of one kind, board and hour together: a row with the latest of their times and a blob of them, ``schema`` for packets.
    A few of them go as they are, and so do rows without a time and readings without a number."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHER:
            yield _packed(held, schema)
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield _packed(held, schema)


def _packed(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    board = batch.column("id_board").dictionary_encode().indices
    told, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("is_reading", "at_us"))
    valid, numbered = (batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("at_us", "seq"))
    at, timed = np.where(valid, at, 0).astype(np.int64), valid & (numbered | ~told)
    parts = [at // HOUR_US, pc.fill_null(board, -1).to_numpy(zero_copy_only=False), told, timed]
    order = np.lexsort(parts)
    batch, at, timed, told = batch.take(pa.array(order)), at[order], timed[order], told[order]
    new = np.any([np.diff(x[order].astype(np.int64)) != 0 for x in parts], axis=0)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(order)]
    kinds = {False: batch.select(schema.names).cast(schema), True: batch.select(TOLD.names).cast(TOLD)}
    single, first, latest, blobs = [], [], [], []
    for i, j in zip(edges[:-1], edges[1:]):
        if j - i < LEAST or not timed[i]:
            single.extend(range(i, j))
            continue
        for k in range(i, j, PACK):
            end = min(k + PACK, j)
            first.append(k)
            latest.append(at[k:end].max())
            blobs.append(_blob(kinds[bool(told[i])].slice(k, end - k)))
    out = batch.take(pa.array([*single, *first], pa.int64()))
    where = out.schema.get_field_index("_time")
    times = pa.concat_arrays([out.column("_time").slice(0, len(single)), pa.array(latest, pa.int64()).cast(out.schema.field(where).type)])
    out = out.set_column(where, out.schema.field(where), times)
    return pa.RecordBatch.from_arrays([*out.columns, pa.array([*[None] * len(single), *blobs], pa.binary())], [*out.schema.names, PACKED])


def _blob(batch: pa.RecordBatch) -> bytes:
    return batch.serialize().to_pybytes()


def _rows(blob: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(bytes(blob)), schema)


class _Waiting:
    """Rows of a board that wait, as blobs of whole hours by first hour and arrival. A board has any number of them, a value holds a bounded one."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema):
        self.state, self.schema = handle.getMapState(name, "hour long, n long", "rows binary"), schema
        self.arrived = handle.getValueState(f"{name}_arrived", "n long")

    def put(self, batches: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        """Put rows to those that wait, in the order they came; under which keys."""
        n = self.arrived.get()[0] if self.arrived.exists() else 0
        self.arrived.update((n + 1,))
        return self._put(pa.Table.from_batches(batches), n)

    def put_back(self, table: pa.Table) -> None:
        """Put back taken rows as having come when they did."""
        arrived = table.column(ARRIVED).to_numpy()
        for n in np.unique(arrived).tolist():
            self._put(table.filter(pa.array(arrived == n)).drop_columns([ARRIVED]), n)

    def _put(self, table: pa.Table, n: int) -> list[tuple[int, int]]:
        hours = table.column("at_us").to_numpy() // HOUR_US
        order = np.argsort(hours, kind="stable")
        hours, batch = hours[order], table.combine_chunks().to_batches()[0].take(pa.array(order))
        i, keys = 0, []
        for j in [*(np.flatnonzero(np.diff(hours)) + 1).tolist(), len(hours)]:
            if j - i >= CHUNK // 100 or j == len(hours):
                keys.append((int(hours[i]), n))
                self.state.updateValue(keys[-1], (_blob(batch.slice(i, j - i)),))
                i = j
        return keys

    def keys(self) -> list[tuple[int, int]]:
        return sorted((int(h), int(n)) for h, n in self.state.keys())

    def drop(self, keys: list[tuple[int, int]]) -> None:
        for x in keys:
            self.state.removeKey(x)

    def read(self, key: tuple[int, int]) -> pa.Table:
        table = pa.Table.from_batches([_rows(self.state.getValue(key)[0], self.schema)])
        return table.append_column(ARRIVED, pa.array(np.full(table.num_rows, key[1])))

    def take(self, key: tuple[int, int]) -> pa.Table:
        table = self.read(key)
        self.state.removeKey(key)
        return table


class _InForce:
    """Readings of a board while its packets are worked through in event time: the last one before them and those that come up."""

    def __init__(self, waiting: _Waiting, last: tuple | None):
        self.waiting, self.todo = waiting, waiting.keys()
        row = {c: [v] for c, v in zip(TOLD.names, last)} if last else {c: [] for c in TOLD.names}
        self.held = pa.Table.from_pydict(row, TOLD).append_column(ARRIVED, pa.array([-1] if last else [], pa.int64()))

    def until(self, first_us: int, last_us: int) -> pa.Table:
        """One reading for each time up to ``last_us``, in time order, and maybe later ones; before ``first_us`` only the last."""
        new, n = [self.held], 0
        while self.todo and self.todo[0][0] * HOUR_US <= last_us:
            new.append(self.waiting.take(self.todo.pop(0)))
            n += new[-1].num_rows
            if n >= CHUNK:
                new, n = [self._one(new, first_us)], 0
        self.held = self._one(new, first_us)
        return self.held

    def _one(self, tables: list[pa.Table], first_us: int) -> pa.Table:
        table = pa.concat_tables(tables)
        at, seq, n = (table.column(c).to_numpy() for c in ("at_us", "seq", ARRIVED))
        order = np.lexsort((n, seq, at))  # of one time the greatest seq counts, of equal ones what came last
        order = order[np.append(np.diff(at[order]) != 0, True)] if len(order) else order
        return table.take(pa.array(order[max(0, np.searchsorted(at[order], first_us, side="right") - 1):]))

    def close(self, passed: int) -> tuple | None:
        """Put back what packets to come may need; the last reading up to ``passed``."""
        table = self.until(passed, passed)
        after = int(np.searchsorted(table.column("at_us").to_numpy(), passed, side="right"))
        if after < table.num_rows:
            self.waiting.put_back(table.slice(after))
        return tuple(table.column(c)[0].as_py() for c in TOLD.names) if after else None


class _Controller(StatefulProcessor):
    def __init__(self, columns: list[str], kinds: list[str], rules: Sequence[Rule], uses: int):
        self.columns, self.rules, self.uses = columns, rules, uses
        self.schema = wire_schema(columns, kinds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending, self.told = _Waiting(handle, "pending", self.schema), _Waiting(handle, "told", TOLD)
        self.force = handle.getValueState("force", "at_us long, seq long, temp double, reading_id string")
        self.passed = handle.getValueState("passed", "at_us long")
        self.used = handle.getValueState("used", "reading_id string, n long")
        self.counts = handle.getMapState("counts", "rule string", "n int")

    def handleInputRows(self, key, rows, timerValues):
        passed = self.passed.get()[0] if self.passed.exists() else None
        held, size, first, put, timed = {False: [], True: []}, {False: 0, True: 0}, None, [], True
        for pdf in rows:
            is_pack = pdf[PACKED].notna().to_numpy() if PACKED in pdf else np.zeros(len(pdf), bool)
            alone, packs = pdf[~is_pack], pdf[is_pack]
            told, known = alone["is_reading"].to_numpy(bool), alone["at_us"].notna().to_numpy()
            if (told & ~(known & alone["seq"].notna().to_numpy())).any():
                raise ValueError("a reading without a time or without a number")
            timed &= bool((known | told).all())
            new = [(t, self._batch(alone.loc[which], TOLD if t else self.schema)) for t, which in ((False, ~told & known), (True, told)) if which.any()]
            if len(packs):
                new += [(bool(t), self._late(_rows(x, TOLD if t else self.schema), passed)) for t, x in zip(packs["is_reading"], packs[PACKED])]
            for is_told, batch in new:
                if not batch.num_rows:
                    continue
                held[is_told].append(batch)
                size[is_told] += batch.nbytes
                if not is_told:
                    first = min(pc.min(batch.column("at_us")).as_py(), first if first is not None else 1 << 62)
                if size[is_told] >= GATHER:
                    keys = (self.told if is_told else self.pending).put(held[is_told])
                    put += [] if is_told else keys
                    held[is_told], size[is_told] = [], 0
        if held[True]:
            self.told.put(held[True])
        if held[False] and timed:
            self.pending.put(held[False])
        if not timed:  # a packet without a time takes the board's others of its micro-batch with it
            self.pending.drop(put)
        if first is not None:
            due = [-(-first // 1000), *self.handle.listTimers()]
            for timer in due[1:]:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(min(due))
        return iter(())

    def _batch(self, pdf: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(pdf[schema.names], schema=schema, preserve_index=False)

    def _late(self, batch: pa.RecordBatch, passed: int | None) -> pa.RecordBatch:
        """Rows of a pack that the board was not yet worked through past; the stream leaves out a pack only when all of it is too late."""
        return batch if passed is None else batch.filter(pc.greater(batch.column("at_us"), passed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self.pending.keys()
        due = [x for x in waiting if x[0] * HOUR_US <= passed]
        readings = _InForce(self.told, self.force.get() if self.force.exists() else None)
        held, n, rest_us = [], 0, None
        for x, following in zip(due, [*due[1:], None]):
            held.append(self.pending.take(x))
            n += held[-1].num_rows
            if n >= CHUNK and following is not None and following[0] > x[0]:  # what is left has no row before this hour
                ready, rest = self._split(held, following[0] * HOUR_US - 1)
                if ready.num_rows:
                    yield self._passed(key, ready, readings)
                held, n = [rest], rest.num_rows
        if held:
            ready, rest = self._split(held, passed)
            if rest.num_rows:
                rest_us = pc.min(rest.column("at_us")).as_py()
                self.pending.put_back(rest)
            if ready.num_rows:
                yield self._passed(key, ready, readings)
        for x in waiting[len(due):]:
            if x[0] != waiting[len(due)][0] or rest_us is not None and x[0] * HOUR_US >= rest_us:
                break
            first = pc.min(self.pending.read(x).column("at_us")).as_py()
            rest_us = first if rest_us is None else min(first, rest_us)
        if rest_us is not None:
            self.handle.registerTimer(-(-rest_us // 1000))
        last = readings.close(passed)
        if last is not None:
            self.force.update(last)
        self.passed.update((passed,))

    def _split(self, tables: list[pa.Table], upto: int) -> tuple[pa.Table, pa.Table]:
        table = pa.concat_tables(tables)
        ready = pc.less_equal(table.column("at_us"), upto)
        return table.filter(ready), table.filter(pc.invert(ready))

    def _passed(self, key, table: pa.Table, readings: _InForce) -> pd.DataFrame:
        order = np.lexsort([table.column(c).to_numpy() for c in (ARRIVED, "seq", "at_us")])
        pdf = table.select(self.columns).take(pa.array(order)).to_pandas()
        at = pdf["at_us"].to_numpy(np.int64)
        out = self._work(pdf, readings.until(int(at[0]), int(at[-1])))
        out.insert(0, "id_board", key[0])
        return out

    def _work(self, pdf: pd.DataFrame, known: pa.Table) -> pd.DataFrame:
        hit = np.searchsorted(known.column("at_us").to_numpy(), pdf["at_us"].to_numpy(np.int64), side="right") - 1
        temp = np.append(known.column("temp").to_numpy().astype(float), np.nan)[hit]
        reading = np.asarray([*known.column("reading_id").to_pylist(), None], object)[hit]
        leaf = pdf[C.TARGET].to_numpy(float)
        needs = ~(leaf >= C.LEAF_MIN_VALID)  # a missing value is no number
        tries = np.flatnonzero(needs & (reading != None))  # noqa: E711
        state = self.used.get() if self.used.exists() else (None, 0)
        uses, state = count_uses(reading[tries], (state[0], state[1]))
        self.used.update(state)
        use_no = np.zeros(len(pdf), np.int64)
        use_no[tries] = uses
        used, spent = (use_no > 0) & (use_no <= self.uses), use_no > self.uses
        out = pdf.copy()
        out[C.TARGET] = np.where(used, temp, np.where(needs & ~spent, np.nan, leaf))
        out["use_no"] = pd.array(use_no, dtype="Int64")
        out.loc[use_no == 0, "use_no"] = pd.NA
        out["leaf_source"] = np.select([used, spent, needs], ["reading", "exhausted", "none"], "sensor")
        return self._ruled(out)

    def _ruled(self, pdf: pd.DataFrame) -> pd.DataFrame:
        fired, failed = [[]] * len(pdf), []  # rows share their lists: most are empty
        for rule in self.rules:
            try:
                told = np.flatnonzero(pdf[list(rule.needs)].notna().all(axis=1))
                holds = rule.holds(pdf.iloc[told]).fillna(False).to_numpy(bool)
                before = self.counts.getValue((rule.name,))[0] if self.counts.containsKey((rule.name,)) else 0
                fires, after = count_rule(holds, rule.patience, before)
            except Exception as e:  # a rule's own fault: the others and the packets go on
                failed.append(f"{rule.name}: {type(e).__name__}: {e}")
                continue
            self.counts.updateValue((rule.name,), (after,))
            for i in told[fires].tolist():
                fired[i] = [*fired[i], rule.name]
        return pdf.assign(fired=fired, failed=[failed] * len(pdf))

    def close(self) -> None:
        pass


def controlled(packets: DataFrame, readings: DataFrame | None = None, rules: Sequence[Rule] = (LOW_MOISTURE,), lateness: str = "10 minutes",
               uses: int = C.READING_USES) -> DataFrame:
    """Packets with the operator's reading in force put in for a missing or implausible leaf temperature, and the rules they fire.

    ``packets``: id_board, _time, seq and measures, other columns go along as text. ``readings``: id_board, _time (when it was told), seq,
    temp, reading_id. Both without a watermark; a row that is more than ``lateness`` behind the newest is left out. A reading counts
    from its own time on, before a packet of the same time; of readings of one time the greatest ``seq`` counts.
    Adds use_no, leaf_source and alert_level as ``apply_fallback`` does, ``fired`` (names of rules) and ``failed`` (rules that raised).
    """
    use_rocksdb(packets.sparkSession)
    own = ["id_board", "_time", "seq", "leaf_temp"]
    numbers = [f.name for f in packets.schema if f.name not in own and isinstance(f.dataType, T.NumericType)]
    texts = [c for c in packets.columns if c not in own and c not in numbers]
    columns = ["at_us", "seq", "leaf_temp", *numbers, *texts]
    kinds = ["long", "long", *["double"] * (1 + len(numbers)), *["string"] * len(texts)]
    a = packets.select("id_board", "_time", F.unix_micros("_time").alias("at_us"), F.lit(False).alias("is_reading"), F.col("seq").cast("long").alias("seq"),
                       *[F.col(c).cast("double").alias(c) for c in ["leaf_temp", *numbers]], *[F.col(c).cast("string").alias(c) for c in texts])
    if readings is None:
        both = a.withColumns({"temp": F.lit(None).cast("double"), "reading_id": F.lit(None).cast("string")})
    else:
        b = readings.select("id_board", "_time", F.unix_micros("_time").alias("at_us"), F.lit(True).alias("is_reading"), F.col("seq").cast("long").alias("seq"),
                            F.col("temp").cast("double").alias("temp"), F.col("reading_id").cast("string").alias("reading_id")).where("reading_id is not null")
        both = a.unionByName(b, allowMissingColumns=True)
    own, fields = wire_schema(columns, kinds), T.StructType([*both.schema.fields, T.StructField(PACKED, T.BinaryType())])
    both = both.mapInArrow(lambda batches: packed(batches, own), fields)
    both = both.withWatermark("_time", lateness)  # one watermark over both, so silent operators hold nothing up
    added = [("use_no", "long"), ("leaf_source", "string"), ("fired", "array<string>"), ("failed", "array<string>")]
    out = ", ".join(f"`{c}` {k}" for c, k in [*zip(columns, kinds), *added])
    d = both.groupBy("id_board").transformWithStateInPandas(_Controller(columns, kinds, rules, uses), f"id_board string, {out}", "Append", "EventTime")
    d = d.withColumn("_time", F.timestamp_micros("at_us")).withColumn("alert_level", alert_level(F.col("use_no"), uses)).drop("at_us")
    return d.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ["leaf_temp", *numbers]})


COMMANDS = T.StructType([T.StructField(c, t) for c, t in (
    ("id_board", T.StringType()), ("rule", T.StringType()), ("seq", T.LongType()), ("_time", T.TimestampType()), ("act", T.StringType()),
    ("val", T.IntegerType()), ("dur", T.IntegerType()))])


def command_table(spark, path: str) -> VersionedTable:
    """Commands that rules fired, one for a packet and a rule."""
    return VersionedTable(spark, path, COMMANDS, ["id_board", "rule", "seq"], ["_time"])


def fired_commands(rows: DataFrame, rules: Sequence[Rule] = (LOW_MOISTURE,)) -> DataFrame:
    """The commands of controlled rows."""
    known = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.struct(*[F.lit(v).alias(n) for n, v in zip(("act", "val", "dur"), r.command)]))])
    d = rows.select("id_board", F.explode("fired").alias("rule"), "seq", "_time")
    return d.withColumn("_c", known[F.col("rule")]).select("id_board", "rule", "seq", "_time", "_c.act", "_c.val", "_c.dur")


def run_controller(rows: DataFrame, points_path: str, commands_path: str, checkpoint: str, topology_path: str | None = None,
                   rules: Sequence[Rule] = (LOW_MOISTURE,), once: bool = True) -> StreamingQuery:
    """Store controlled rows as points, their commands, and the hubs they came by, in one query.

    A micro-batch is written aside once, because each of the three sinks reads it; each sink leaves out a batch it has committed.
    """
    def each(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        name, held = telemetry.stream_id(spark, checkpoint), materialise(batch)
        tables.write_points(to_points(held, ("id_board", "_time", "seq"), [f for f in C.FIELDS if f in held.columns]), points_path, name, i)
        commands = command_table(spark, commands_path)
        commands.tidy(commands.append(fired_commands(held, rules), name, i))
        if topology_path is not None:
            heard = held.where(F.col("star_id").isNotNull()).select(F.col("id_board").alias("node_id"), "star_id", "_time", "seq")
            hubs = telemetry.topology_table(spark, topology_path)
            hubs.tidy(hubs.append(latest_per(heard, ["node_id"], ["_time", "seq"]), name, i))

    return telemetry.run(rows, each, checkpoint, once)
