"""Token ids as Arrow stream files of fixed-size lists.

A folder holds for each shard ``ids-*.arrow``, an Arrow stream of record batches with two fixed-size-list columns of the same
length: ``ids`` and ``mask`` (true for a token, false for the padding at a shard's end), and ``docs-*.arrow``, a stream with one row
per document: its id, its place in the shard, its number of ids. Batches are not compressed, so a memory-mapped stream gives any
sequence and mask without a copy. ``manifest`` lists the shards, in the order of their documents, with the files that count: a task
that ran twice leaves a second pair of files that no manifest names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import map_arrow, shuffle_partitions, text_slices
from canopyflow.llm.encode import ID, encoder

_MANIFEST = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("ids_file", T.StringType()), T.StructField("docs_file", T.StringType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_sequences", T.LongType())])
#: sequences in a record batch, documents in a batch of the index
_SEQUENCES, _DOCS = 256, 16_384


def _open(path: str):
    """File system and path; what a cluster's executors share has to be reachable by pyarrow (local or mounted, hdfs, s3, gs)."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, so that executors do not take a path of the cluster's default store for a local one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _id_type(tokenizer_size: int) -> pa.DataType:
    return pa.uint16() if tokenizer_size <= 1 << 16 else pa.uint32()


class _Writer:
    def __init__(self, folder: str, name: str, length: int, kind: pa.DataType, id_type: pa.DataType):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        self.names = f"ids-{name}.arrow", f"docs-{name}.arrow"
        self.length, self.kind, self.id_type = length, kind, id_type
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [fs.open_output_stream(f"{root}/{n}") for n in self.names]
        self.ids, self.docs = (pa.ipc.new_stream(s, c) for s, c in zip(self.sinks, (self.schema, self.docs_schema)))
        self.waiting, self.n_waiting, self.rows, self.n_tokens, self.n_docs, self.n_sequences = [], 0, [], 0, 0, 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.n_tokens, len(ids)))
        self.n_tokens += len(ids)
        self.n_docs += 1
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= _SEQUENCES * self.length:
            self._sequences(False)
        if len(self.rows) >= _DOCS:
            self._index()

    def _index(self) -> None:
        ids, starts, lengths = zip(*self.rows) if self.rows else ((), (), ())
        self.docs.write_batch(pa.record_batch([pa.array(ids, self.id_type), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                                              schema=self.docs_schema))
        self.rows = []

    def _sequences(self, last: bool) -> None:
        flat, step = np.concatenate(self.waiting) if self.waiting else np.zeros(0, ID), _SEQUENCES * self.length
        real, rest = len(flat), flat[:0]
        if last:
            flat = np.concatenate([flat, np.zeros(-real % self.length, ID)])
        else:  # whole batches only: all but a file's last one are equally long, so a sequence's place is plain arithmetic
            flat, rest = np.split(flat, [real // step * step])
        for i in range(0, len(flat), step):
            part = flat[i:i + step]
            mask = np.arange(i, i + len(part)) < real
            self.ids.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(part.astype(self.kind.to_pandas_dtype())), self.length),
                 pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
            self.n_sequences += len(part) // self.length
        self.waiting, self.n_waiting = [rest], len(rest)

    def close(self) -> tuple:
        self._sequences(True)
        self._index()
        for x in (self.ids, self.docs, *self.sinks):
            x.close()
        return (*self.names, self.n_docs, self.n_tokens, self.n_sequences)


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = 1024, id_col: str = "doc_id",
                    text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id`` to each document, and write all ids in ascending id order; returns the manifest.

    One range shuffle on (id, hash of the text), then each task sorts, encodes and writes its shard as it goes, so it holds a batch
    and never a shard. Null ids come first; documents with one id follow each other in the order of their texts' hashes; a null or empty
    text is the end id alone; other columns are not read; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = _qualified(spark, folder)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    n = partitions or shuffle_partitions(docs)
    rows = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def run(batches):
        lib, writer = encoder(tokenizer), None
        task = TaskContext.get()
        kind = _id_type(max(lib.tokenizer.get_vocab_size(), end_id + 1))
        end = np.asarray([end_id], ID)
        for part in text_slices(batches, "text"):
            if writer is None:
                writer = _Writer(folder, f"{task.partitionId():05d}-{task.taskAttemptId()}", length, kind, part.column("id").type)
            for doc_id, ids in zip(part.column("id").to_pylist(), lib.encode(part.column("text").to_pylist())):
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer:
            ids_file, docs_file, *counts = writer.close()
            values = [task.partitionId(), ids_file, docs_file, *counts]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 3))],
                                             [f.name for f in _MANIFEST])

    rows.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest, one row per file pair, with the ids of all shards before; dealt one shard to a task."""
    folder = _qualified(spark, folder)
    found = sorted(spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").collect())  # a row per shard
    rows, base = [], 0
    for r in found:
        rows.append((r.shard, f"{folder}/{r.ids_file}", f"{folder}/{r.docs_file}", base))
        base += r.n_tokens
    df = spark.createDataFrame(rows, "shard int, ids_path string, docs_path string, base long")
    return df.repartition(max(1, len(rows)))


def open_stream(path: str) -> pa.Table:
    """A stream file as a table; local files are mapped, so that no byte is read before it is asked for and none is copied."""
    fs, name = _open(path)
    source = pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name)
    return pa.ipc.open_stream(source).read_all()


def sequence(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view) and mask of sequence ``i`` of an opened stream."""
    per_batch = len(table.column("ids").chunk(0))  # all batches but the last are equally long
    ids, mask = (table.column(c).chunk(i // per_batch) for c in ("ids", "mask"))
    at, n = i % per_batch, ids.type.list_size
    return ids.values.slice(at * n, n).to_numpy(), mask.values.slice(at * n, n).to_numpy(zero_copy_only=False)


def _token_reader(table: pa.Table):
    """A function from (start, length) to ids, across batch borders; each batch's ids are one view."""
    chunks = [c.values.slice(c.offset * c.type.list_size, len(c) * c.type.list_size).to_numpy() for c in table.column("ids").chunks]
    ends = np.cumsum([len(c) for c in chunks])

    def read(start: int, n: int) -> np.ndarray:
        out, k = [], int(np.searchsorted(ends, start, side="right"))
        while n > 0:
            at = start - (int(ends[k]) - len(chunks[k]))
            out.append(chunks[k][at:at + n])
            n, start, k = n - len(out[-1]), start + len(out[-1]), k + 1
        return np.concatenate(out).astype(ID)
    return read


def read_documents(spark: SparkSession, folder: str, id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """Each document of the files: id, ``start`` (ids before it in the whole output), ``n_tokens``, ``ids`` (little-endian 32-bit)."""
    def run(batches):
        for batch in batches:
            for ids_path, docs_path, base in zip(*(batch.column(c).to_pylist() for c in ("ids_path", "docs_path", "base"))):
                read = _token_reader(open_stream(ids_path))
                for part in open_stream(docs_path).to_batches(max_chunksize=1024):
                    starts, lengths = part.column("start"), part.column("n_tokens")
                    ids = [read(s, n).tobytes() for s, n in zip(starts.to_pylist(), lengths.to_pylist())]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(starts.to_numpy() + base, pa.int64()), lengths,
                                                      pa.array(ids, pa.binary())], ["id", "start", "n_tokens", "ids"])

    out = map_arrow(_shards(spark, folder), run, T.StructField("id", id_type), T.StructField("start", T.LongType()),
                    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()))
    return out.withColumnRenamed("id", id_col)


def read_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Each sequence of the files: shard, number in the shard, ids and mask as arrays."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("ids_path").to_pylist()):
                first = 0
                for part in open_stream(path).to_batches(max_chunksize=64):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()),
                         part.column("ids").cast(pa.list_(pa.int64())), part.column("mask").cast(pa.list_(pa.bool_()))],
                        ["shard", "sequence", "ids", "mask"])
                    first += n

    return map_arrow(_shards(spark, folder), run, T.StructField("shard", T.IntegerType()), T.StructField("sequence", T.LongType()),
                     T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("mask", T.ArrayType(T.BooleanType())))


