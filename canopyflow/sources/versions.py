"""Versioned tables of Parquet files: a write adds a folder, a small commit makes it count, readers merge by key.

``path/parts/part=<name>/`` holds what one write or one compaction made, ``path/commits/<number>.json`` lists the parts in force. A job
that dies before its commit leaves files nobody reads. Commits are put in place by a rename that fails if the number is taken, so of
two writers the later one looks again and takes the next number; the file system has to have such a rename, as HDFS has.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: the number of the commit that brought a row, for ``order``
COMMIT = "_commit"
_PART = "part"


@dataclass(frozen=True)
class Part:
    """A folder of rows. ``commit`` orders them against the rows of other parts; a ``merged`` part holds one row a key."""

    name: str
    commit: int
    size: int
    merged: bool = False


@dataclass(frozen=True)
class Version:
    """The parts in force, oldest first, and the last batch that each writer committed."""

    number: int = 0
    parts: tuple[Part, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)


class Files:
    """The few calls to the shared file system that commits need."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.hadoop = spark, spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        path = self.hadoop.Path(root)
        self.fs = path.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(path).toString()

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def listed(self, folder: str) -> dict[str, float]:
        """What is in a folder, and when it was written, in seconds; nothing if it is missing."""
        path = self.path(folder)
        if not self.fs.exists(path):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.fs.listStatus(path)}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file under a name that is free; false if it is taken."""
        to, aside = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.hadoop, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(kind, 1)
        never_over[0] = kind.NONE
        try:
            self.hadoop.FileContext.getFileContext(to.toUri(), self.conf).rename(aside, to, never_over)
            return True
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self.path(folder)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class VersionedTable:
    """Rows with one value a ``key``: the greatest in ``order`` counts, whichever part it is in.

    ``order`` may name columns and ``COMMIT``. ``folder`` (name, expression) makes day folders or the like inside each part; a filter on
    it, or on key columns, reaches the scan, because it leaves whole keys in or out.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], order: Sequence[str],
                 folder: tuple[str, Column, T.DataType] | None = None):
        self.spark, self.schema, self.key, self.order, self.folder = spark, schema, list(key), list(order), folder
        self.files = Files(spark, path)

    # -- versions ----------------------------------------------------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.listed("commits") if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A version, by default the newest."""
        numbers = self._numbers()
        if not numbers:
            return Version()
        number = numbers[-1] if number is None else number
        raw = json.loads(self.files.read(f"commits/{number:012d}.json"))
        return Version(number, tuple(Part(**p) for p in raw["parts"]), raw["batches"])

    def _commit(self, change) -> Version | None:
        """Put ``change`` of the newest version in force; None if it is no longer wanted. Tried again if another writer was faster."""
        while True:
            now = self.version()
            new = change(now)
            if new is None:
                return None
            new = replace(new, number=now.number + 1)
            text = json.dumps({"parts": [asdict(p) for p in new.parts], "batches": new.batches})
            if self.files.put(f"commits/{new.number:012d}.json", text):
                return new

    # -- writes ------------------------------------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows = rows.select(*self.schema.names, *([COMMIT] if COMMIT in rows.columns else []))
        if self.folder:
            rows = rows.withColumn(self.folder[0], self.folder[1]).hint("rebalance", self.folder[0])
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(self.folder[0]) if self.folder else writer).parquet(f"{self.files.root}/parts/{_PART}={name}")
        return name

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> Version:
        """Add rows as a part of their own; what is stored is not read. A batch that its writer has committed already is left out."""
        def seen(now: Version) -> bool:
            return writer is not None and batch <= now.batches.get(writer, -1)

        if seen(now := self.version()):
            return now
        name = self._write(rows)
        size = self.files.size(f"parts/{_PART}={name}")

        def change(now: Version) -> Version | None:
            if seen(now):
                return None
            batches = now.batches if writer is None else {**now.batches, writer: batch}
            return Version(0, (*now.parts, Part(name, now.number + 1, size)), batches)

        return self._commit(change) or self.version()

    def compact(self, ratio: float = 4.0) -> Version | None:
        """Merge the newest parts into one: as many as are not more than ``ratio`` times larger than all newer ones together, so a row is
        rewritten a number of times that grows with the logarithm of the table. Rows that came meanwhile stay in their own parts."""
        now = self.version()
        taken, size = [], 0
        for p in reversed(now.parts):
            if len(taken) > 0 and p.size > ratio * size:
                break
            taken.append(p)
            size += p.size
        if len(taken) < 2:
            return None
        last = max(p.commit for p in taken)
        name = self._write(self._merged(self._rows(taken), keep_commit=True))
        merged = Part(name, last, self.files.size(f"parts/{_PART}={name}"), merged=True)

        def change(now: Version) -> Version | None:
            if not set(taken) <= set(now.parts):
                return None  # another compaction was faster
            parts = [p for p in now.parts if p not in taken] + [merged]
            return Version(0, tuple(sorted(parts, key=lambda p: p.commit)), now.batches)

        return self._commit(change)

    def tidy(self, version: Version, most: int = 8) -> None:
        """Merge the newest parts, and drop old versions, once a version has more than ``most`` parts."""
        if len(version.parts) > most:
            self.compact()
            self.vacuum()

    def vacuum(self, keep: int = 2, grace_s: float = 86_400) -> None:
        """Drop all but the newest ``keep`` versions, and parts of none of these that are older than ``grace_s`` seconds: a younger one
        may be of a write that is not committed yet."""
        numbers = self._numbers()
        held = {p.name for n in numbers[-keep:] for p in self.version(n).parts}
        for n in numbers[:-keep]:
            self.files.delete(f"commits/{n:012d}.json")
        for name, written in self.files.listed("parts").items():
            if name.removeprefix(f"{_PART}=") not in held and time.time() - written >= grace_s:
                self.files.delete(f"parts/{name}")

    # -- reads -------------------------------------------------------------------------------------------------------------------------

    def _rows(self, parts: Sequence[Part]) -> DataFrame:
        """Rows of some parts, with the commit that brought them. Parts are few: compaction keeps their number logarithmic."""
        columns = [*self.schema.fields, T.StructField(COMMIT, T.LongType()), T.StructField(_PART, T.StringType())]
        if self.folder:
            columns.append(T.StructField(self.folder[0], self.folder[2]))
        root = f"{self.files.root}/parts"
        read = self.spark.read.schema(T.StructType(columns)).option("basePath", root).parquet(*[f"{root}/{_PART}={p.name}" for p in parts])
        commits = F.create_map(*[F.lit(x) for p in parts for x in (p.name, p.commit)])
        return read.withColumn(COMMIT, F.coalesce(COMMIT, commits[F.col(_PART)].cast("long"))).drop(_PART)

    def _merged(self, rows: DataFrame, keep_commit: bool = False) -> DataFrame:
        """One row a key. An aggregate with map-side combine, so copies collapse before the shuffle."""
        own = [COMMIT] if keep_commit else []
        rest = [c for c in [*self.schema.names, *own] if c not in self.key]
        best = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_best"))
        return best.select(*[F.col(c) if c in self.key else F.col("_best")[c].alias(c) for c in [*self.schema.names, *own]])

    def read(self, where: Column | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest. ``where`` may use key columns and the folder's column."""
        parts = self.version(version).parts
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self._rows(parts)
        rows = rows if where is None else rows.where(where)
        if len(parts) == 1 and parts[0].merged:
            return rows.select(*self.schema.names)
        return self._merged(rows)
