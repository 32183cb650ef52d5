"""Hub logs of 40-byte records as a stream: each poll takes the whole records that hubs have appended since the last one."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from canopyflow.config import PACKET_BYTES

SCHEMA = T.StructType([T.StructField("hub", T.StringType()), T.StructField("data", T.BinaryType())])
_SUFFIX = ".bin"
#: records of one read task
_TASK_RECORDS = 400_000
_BATCH_RECORDS = 20_000


class Records(InputPartition):
    """Whole records of a hub's file, from a byte on."""

    def __init__(self, path: str, hub: str, start: int, stop: int):
        self.path, self.hub, self.start, self.stop = path, hub, start, stop


class RingReader(DataSourceStreamReader):
    """Offsets are bytes by hub. A file that got shorter was begun anew, so it is read from its start."""

    def __init__(self, folder: str):
        self.folder = folder

    def _sizes(self) -> dict[str, int]:
        system, root = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(root))
        return {f.base_name.removesuffix(_SUFFIX): f.size // PACKET_BYTES * PACKET_BYTES for f in found if f.is_file and f.base_name.endswith(_SUFFIX)}

    def initialOffset(self) -> dict:
        return {"hubs": json.dumps({})}

    def latestOffset(self) -> dict:
        return {"hubs": json.dumps(self._sizes(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Records]:
        before, now, out = json.loads(start["hubs"]), json.loads(end["hubs"]), []
        step = _TASK_RECORDS * PACKET_BYTES
        for hub, size in now.items():
            first = before.get(hub, 0) if before.get(hub, 0) <= size else 0
            out += [Records(f"{self.folder.rstrip('/')}/{hub}{_SUFFIX}", hub, at, min(at + step, size)) for at in range(first, size, step)]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(path) as file:
            for at in range(partition.start, partition.stop, _BATCH_RECORDS * PACKET_BYTES):
                raw = file.read_at(min(_BATCH_RECORDS * PACKET_BYTES, partition.stop - at), at)
                n = len(raw) // PACKET_BYTES
                offsets = pa.py_buffer((np.arange(n + 1, dtype="<i4") * PACKET_BYTES).tobytes())
                data = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array([partition.hub] * n, pa.string()), data], ["hub", "data"])


class RingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hub_rings"

    def schema(self) -> T.StructType:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return RingReader(self.options["path"])


def stream_rings(spark: SparkSession, folder: str) -> DataFrame:
    """``hub`` and ``data`` (one record) of the logs ``<hub>.bin`` in a folder, each record once; ``decode_packets`` takes them on.

    ``folder`` is a full URI that pyarrow can open on every executor. The record a hub is just writing is left for the next poll.
    """
    spark.dataSource.register(RingSource)
    return spark.readStream.format("hub_rings").option("path", folder if "://" in folder else f"file://{folder}").load()
