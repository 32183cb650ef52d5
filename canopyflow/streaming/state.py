"""Per-node state of the telemetry stream. Each operator has a batch twin that gives the same rows.

A node's rows of one micro-batch are put in time order first; bound a micro-batch with maxFilesPerTrigger or
maxOffsetsPerTrigger.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from canopyflow import config as C
from canopyflow.operators.sequence import alert_level

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State with several variables per key needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def count_rule(holds: np.ndarray, patience: int, before: int) -> tuple[np.ndarray, int]:
    """Where a condition has held for the ``patience``-th time since it failed or fired last, and the count afterwards. ``before``: the
    count of what was seen so far."""
    if not len(holds):
        return holds, before
    at = np.arange(len(holds))
    reset = np.maximum.accumulate(np.where(holds, -1, at))
    count = at - reset + np.where(reset < 0, before, 0)
    return holds & (count % patience == 0), int(count[-1] % patience) if holds[-1] else 0


def count_uses(readings: np.ndarray, before: tuple[str | None, int]) -> tuple[np.ndarray, tuple[str | None, int]]:
    """The how-manieth use of its reading each row makes; a reading that comes back after another one counts from the start."""
    if not len(readings):
        return np.zeros(0, np.int64), before
    at = np.arange(len(readings))
    new = np.append(readings[0] != before[0], readings[1:] != readings[:-1])
    start = np.maximum.accumulate(np.where(new, at, -1))
    uses = at - start + np.where(start < 0, before[1], 1)
    return uses, (readings[-1], int(uses[-1]))


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class _Moisture(StatefulProcessor):
    def __init__(self, col: str, threshold: float, patience: int):
        self.col, self.threshold, self.patience = col, threshold, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.low = handle.getValueState("low", "n int")

    def handleInputRows(self, key, rows, timerValues):
        state = self.low.get()
        pdf = _ordered(rows, ["at", "seq"])
        pdf = pdf[pdf[self.col].notna()]
        fires, n = count_rule(pdf[self.col].to_numpy(float) < self.threshold, self.patience, state[0] if state else 0)
        self.low.update((n,))
        act, val, dur = C.PUMP
        hit = pdf[fires]
        yield pd.DataFrame({"node_id": hit["node_id"], "at": hit["at"], "seq": hit["seq"], self.col: hit[self.col], "act": act, "val": val, "dur": dur})

    def close(self) -> None:
        pass


def stream_moisture(df: DataFrame, col: str = "soil_moisture", threshold: float = C.SOIL_LOW, patience: int = C.SOIL_PATIENCE) -> DataFrame:
    """Pump commands fired by every fifth low reading in a row (node_id, _time, seq and the reading)."""
    use_rocksdb(df.sparkSession)
    d = df.select("node_id", F.col("_time").alias("at"), "seq", col)
    out = T.StructType([*d.schema.fields, T.StructField("act", T.StringType()), T.StructField("val", T.IntegerType()), T.StructField("dur", T.IntegerType())])
    return d.groupBy("node_id").transformWithStateInPandas(_Moisture(col, threshold, patience), out, "Append", "None").withColumnRenamed("at", "_time")


class _Fallback(StatefulProcessor):
    def __init__(self, uses: int):
        self.uses = uses

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "reading_id string, n long")

    def handleInputRows(self, key, rows, timerValues):
        state = self.seen.get()
        pdf = _ordered(rows, ["at", "seq"])
        tries = np.flatnonzero(~(pdf["leaf_temp"].to_numpy(float) >= C.LEAF_MIN_VALID) & pdf["reading_id"].notna().to_numpy())
        made, state = count_uses(pdf["reading_id"].to_numpy(object)[tries], (state[0], state[1]) if state else (None, 0))
        self.seen.update(state)
        uses = np.zeros(len(pdf), np.int64)
        uses[tries] = made
        pdf["use_no"] = pd.array(uses, dtype="Int64")
        pdf.loc[uses == 0, "use_no"] = pd.NA
        yield pdf

    def close(self) -> None:
        pass


def stream_fallback(df: DataFrame, key: str = "id_board", uses: int = C.READING_USES, carry: Sequence[str] = ()) -> DataFrame:
    """Count the uses of operator readings per board, then replace and flag as the batch operator does.

    ``df`` has leaf_temp and the reading in force: temp, reading_id. Columns in ``carry`` go along.
    """
    use_rocksdb(df.sparkSession)
    d = df.select(key, F.col("_time").alias("at"), "seq", "leaf_temp", "temp", "reading_id", *carry)
    out = T.StructType([*d.schema.fields, T.StructField("use_no", T.LongType())])
    d = d.groupBy(key).transformWithStateInPandas(_Fallback(uses), out, "Append", "None").withColumnRenamed("at", "_time")
    leaf = F.when(F.isnan("leaf_temp"), None).otherwise(F.col("leaf_temp"))
    used, spent = F.col("use_no") <= uses, F.col("use_no") > uses
    needs = leaf.isNull() | (leaf < C.LEAF_MIN_VALID)
    source = F.when(used, "reading").when(spent, "exhausted").when(needs, "none").otherwise("sensor")
    return d.withColumns({
        "leaf_source": source,
        "alert_level": alert_level(F.col("use_no"), uses),
        "leaf_temp": F.when(used, F.col("temp")).when(source != "none", leaf),
    })


class _Commands(StatefulProcessor):
    """Sends of the open command of a node: at once, then after each wait until it is acknowledged or replaced."""

    def __init__(self, retry_ms: int, attempts: int, event_time: bool):
        self.retry_ms, self.attempts, self.event_time = retry_ms, attempts, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "seq long, attempt int, due_ms long")

    def _until(self, pending, now_ms, out, key):
        """Emit the resends due before ``now_ms``."""
        while pending and pending[2] < now_ms:
            seq, attempt, due = pending
            if attempt >= self.attempts:
                out.append((key, seq, attempt, due, "failed"))
                pending = None
            else:
                out.append((key, seq, attempt + 1, due, "sent"))
                pending = (seq, attempt + 1, due + self.retry_ms)
        return pending

    def _keep(self, pending):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if pending:
            self.open.update(pending)
            self.handle.registerTimer(pending[2])
        elif self.open.exists():
            self.open.clear()

    def _frame(self, out):
        return pd.DataFrame(out, columns=["node_id", "seq", "attempt", "at_ms", "event"])

    def handleInputRows(self, key, rows, timerValues):
        pending, out = (self.open.get() if self.open.exists() else None), []
        pdf = _ordered(rows, ["at_ms", "seq"])
        for seq, at, is_command in zip(pdf["seq"], pdf["at_ms"], pdf["is_command"]):
            pending = self._until(pending, at, out, key[0])
            if is_command:
                out.append((key[0], int(seq), 1, int(at), "sent"))
                pending = (int(seq), 1, int(at) + self.retry_ms)
            elif pending:
                out.append((key[0], pending[0], pending[1], int(at), "acked"))
                pending = None
        self._keep(pending)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        pending = self.open.get() if self.open.exists() else None
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.event_time:  # the watermark may have passed later waits too, and no batch need follow this one
            now = max(now, timerValues.getCurrentWatermarkInMs())
        pending = self._until(pending, now + 1, out, key[0])
        self._keep(pending)
        yield self._frame(out)

    def close(self) -> None:
        pass


def stream_commands(df: DataFrame, retry_ms: int = C.COMMAND_RETRY_S * 1000, attempts: int = C.COMMAND_ATTEMPTS, time_mode: str = "ProcessingTime") -> DataFrame:
    """Sends, acknowledgements and failures of commands.

    ``df``: node_id, seq, _time, is_command (false for an acknowledgement). In processing time a resend leaves when its
    wait is over; in event time (the stream needs a watermark) when the watermark passes it.
    """
    use_rocksdb(df.sparkSession)
    d = df.select("node_id", "seq", "_time", "is_command", F.unix_millis("_time").alias("at_ms"))
    out = T.StructType([df.schema["node_id"], T.StructField("seq", T.LongType()), T.StructField("attempt", T.IntegerType()),
                        T.StructField("at_ms", T.LongType()), T.StructField("event", T.StringType())])
    return d.groupBy("node_id").transformWithStateInPandas(_Commands(retry_ms, attempts, time_mode == "EventTime"), out, "Append", time_mode)
