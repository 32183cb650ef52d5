"""Binary telemetry: 40-byte little-endian records, alone or many in a blob."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from canopyflow.config import PACKET_BYTES, PACKET_FIELDS

RECORD = np.dtype([(n, "<u4" if i < 2 else "<f4") for i, n in enumerate(PACKET_FIELDS)])
_TYPES = [T.LongType() if i < 2 else T.DoubleType() for i in range(len(PACKET_FIELDS))]


def decode_packets(df: DataFrame, col: str = "data") -> DataFrame:
    """One row per whole record of each blob, a trailing partial record is dropped, measures to 2 decimals.

    Whole Arrow batches are reinterpreted in place; there is no loop over records.
    """
    others = [f for f in df.schema if f.name != col]
    schema = T.StructType([*others, *[T.StructField(n, t) for n, t in zip(PACKET_FIELDS, _TYPES)]])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(col)
            sizes = np.array([0 if b is None else len(b) // PACKET_BYTES for b in blobs.to_pylist()], dtype=np.int64)
            raw = b"".join(b[: n * PACKET_BYTES] for b, n in zip(blobs.to_pylist(), sizes) if n)
            rec = np.frombuffer(raw, RECORD)
            take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            cols = [batch.column(f.name).take(take) for f in others]
            cols += [pa.array(rec[n].astype(np.int64)) if i < 2 else pa.array(np.round(rec[n].astype(np.float64), 2))
                     for i, n in enumerate(PACKET_FIELDS)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(decode, schema)


def encode_packets(df: DataFrame, keep: list[str]) -> DataFrame:
    """The record of each row as ``data`` (absent measures are 0), with the ``keep`` columns."""
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("data", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec = np.zeros(batch.num_rows, RECORD)
            for n in PACKET_FIELDS:
                if n in batch.schema.names:
                    rec[n] = np.nan_to_num(batch.column(n).to_numpy(zero_copy_only=False))
            raw = rec.tobytes()
            data = pa.array([raw[i:i + PACKET_BYTES] for i in range(0, len(raw), PACKET_BYTES)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], data], names=schema.names)

    return df.mapInArrow(encode, schema)


def read_dump_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Hub dumps (16 KiB rings) stored as files."""
    return decode_packets(spark.read.format("binaryFile").load(path).select("path", "content").withColumnRenamed("content", "data"))
