"""Helpers shared by the operators: stored steps, Arrow batches in small slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.session import materialise

#: bytes of text that a task turns into Python objects at once
SLICE_BYTES = 1 << 20


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: read as often as needed, never recomputed."""
    return materialise(df)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    """The field of a column, nullable, under another name if one is given."""
    return T.StructField(alias or name, df.schema[name].dataType, True)


def text_slices(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of the text columns, or one row."""
    for batch in batches:
        lengths = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype("int64") for c in columns).tolist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *fields: T.StructField) -> DataFrame:
    return df.mapInArrow(fn, T.StructType(list(fields)))


def keyed_chunks(batches: Iterator[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows out of a task's input sorted by ``key``; a key is never cut, so its size has to be bounded."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= rows and (keys := batch.column(key).to_numpy())[0] != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held)
            held, n = [], 0
        elif n >= rows and (cut := int(np.argmax(keys != keys[0]))):
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def split_hot(rows: DataFrame, limit: int, key: str = "bucket", member: str = "node") -> DataFrame:
    """Deal the members of each bucket so that every two of them meet, and no task gets more than about ``2 * limit`` of a bucket.

    A bucket of more than ``limit`` members is cut in shards by a hash of the member; two shards meet under a key of their own, a
    shard with itself under another. Columns added: ``meet`` (the key), ``left`` and ``right`` (whether the row's shard is the first
    or the second of the two). Buckets with one member are left out.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    shards = F.ceil(F.col("_n") / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), F.col(member)), F.col("_shards")).cast("int")
    out = rows.join(stored(sizes), key).withColumn("_shards", shards).withColumn("_own", own)
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)))
    out = out.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
    out = out.withColumn("meet", F.xxhash64(key, "_i", "_j")).withColumn("left", F.col("_own") == F.col("_i"))
    return out.withColumn("right", F.col("_own") == F.col("_j")).drop("_n", "_shards", "_own", "_other", "_i", "_j")


def local_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place reachable from each of ``n`` places by the links a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def first_rows(rows: DataFrame, n: int, group: list[str], order: list, by: str) -> DataFrame:
    """The first ``n`` rows of each group, and their ``rank``. Groups are cut in shards by a hash of ``by``, whose winners meet in fewer
    shards, so no task sorts a whole group. The order has to be total."""
    shards = shuffle_partitions(rows)
    while shards > 1:
        w = Window.partitionBy(*group, F.pmod(F.xxhash64(F.lit(shards), by), F.lit(shards))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")
        shards //= 32
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def word_blocks(data: bytes, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """What lies between single spaces, in lists out of about ``size`` bytes; a list ends where a space does."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size) if at + size < len(data) else -1
        yield data[at:end if end >= 0 else len(data)].split(b" ")
        if end < 0:
            return
        at = end + 1
