"""CSV dumps: plain rows of one packet each, and annotated long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.config import MEASUREMENT, PACKET_FIELDS
from canopyflow.operators.joins import upsert_points
from canopyflow.operators.reshape import field_index, melt

_MEASURES = PACKET_FIELDS[2:]
PLAIN = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("node_id", T.LongType()),
                      *[T.StructField(c, T.DoubleType()) for c in _MEASURES]])
STAMP = "yyyy-MM-dd HH:mm:ss"
EPOCH_MIN = 10_000
#: rows of a part file of an annotated dump
FILE_ROWS = 1_000_000

# fixed values: annotation rows and columns of the annotated form
ANNOTATIONS = (
    "#group,false,false,true,true,false,false,true,true,true",
    "#datatype,string,long,dateTime:RFC3339,dateTime:RFC3339,dateTime:RFC3339,double,string,string,string",
    "#default,_result,,,,,,,,",
)
HEADER = ("", "result", "table", "_start", "_stop", "_time", "_value", "_field", "_measurement", "id_board")
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def read_dump_csv(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Plain dump rows with ``_time`` in UTC. ``zone`` is the zone the stamps were written in."""
    df = spark.read.csv(path, header=True, schema=PLAIN)
    return df.withColumn("_time", F.to_utc_timestamp(F.to_timestamp("timestamp", STAMP), zone))


def local_stamp(epoch: str = "timestamp", zone: str = "UTC") -> Column:
    """Readable stamp of a device time; counters from before the clock was set stay as they are."""
    e = F.col(epoch)
    text = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(e), zone), STAMP)
    return F.when(e > EPOCH_MIN, text).otherwise(e.cast("string"))


def write_dump_csv(df: DataFrame, path: str) -> None:
    df.select(*PLAIN.names).write.csv(path, header=True)


def _annotated(points: DataFrame, board: Column, stop: Column) -> DataFrame:
    """Columns of the annotated form (the first, unnamed one as ``annotation``) for points with the number of their field."""
    return points.select(
        F.lit("").alias("annotation"), F.lit("").alias("result"), F.col("table").cast("long").alias("table"),
        F.lit("1970-01-01T00:00:00Z").alias("_start"), F.date_format(stop, RFC3339).alias("_stop"),
        F.date_format("_time", RFC3339).alias("_time"), "_value", "_field",
        F.lit(MEASUREMENT).alias("_measurement"), board.cast("string").alias("id_board"),
    )


def annotated_rows(dump: DataFrame, stop: Column) -> DataFrame:
    """Long rows of a plain dump with the columns of the annotated form."""
    rows = melt(dump.select("timestamp", "_time", "node_id", *_MEASURES), ["timestamp", "_time", "node_id"], _MEASURES)
    return _annotated(field_index(rows), F.col("node_id"), stop)


def _write_annotated(rows: DataFrame, path: str, compression: str | None) -> None:
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("value")
    head = "\n".join([*ANNOTATIONS, ",".join(HEADER)])
    per_file = FILE_ROWS

    def with_head(batches):
        import pyarrow as pa
        room = 0  # rows that still go into the file
        for batch in batches:
            while batch.num_rows:
                if not room:
                    yield pa.RecordBatch.from_arrays([pa.array([head])], schema=batch.schema)
                    room = per_file
                part, batch = batch.slice(0, room), batch.slice(room)
                room -= part.num_rows
                yield part

    out = rows.select(line).mapInArrow(with_head, "value string").write.option("maxRecordsPerFile", per_file + 1)  # the head is one record
    out.text(path, compression=compression)


def write_annotated_csv(dump: DataFrame, path: str, stop: Column, compression: str | None = None) -> None:
    """Annotated CSV. The annotation rows and the header lead every part file, so each part can be imported alone.

    A part file has ``FILE_ROWS`` rows at most, so parts of a ``compression`` that cannot be split (gzip) are still read by many tasks.
    """
    _write_annotated(annotated_rows(dump, stop), path, compression)


def merge_dumps(spark: SparkSession, a: str, b: str, path: str, stop: Column, compression: str | None = None) -> None:
    """Merge the annotated dump ``b`` into ``a`` and write the result in the same form: points of ``b`` win, none is there twice.

    Of points of one series and second within a dump the greatest value counts: lines of a dump have no order across its parts.
    """
    old, new = (read_annotated_csv(spark, p).drop("table").withColumn("seq", F.col("_value")) for p in (a, b))
    merged = field_index(upsert_points(old, new, key=("id_board", "_field", "_time")).drop("seq"))
    _write_annotated(_annotated(merged, F.col("id_board"), stop), path, compression)


def read_annotated_csv(spark: SparkSession, path: str) -> DataFrame:
    """Long points of annotated CSV; annotation rows and repeated headers are skipped wherever they stand.

    All tables of a file share one column order (the form written here and by the store's raw export of this data).
    """
    names = ["annotation", *HEADER[1:]]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(path, header=False, schema=schema, comment="#").where(
        F.col("result").isNull() | (F.col("result") != "result"))
    return df.select(
        F.col("_measurement").alias("measurement"), "id_board", "_field", F.col("_value").try_cast("double").alias("_value"),
        F.to_timestamp("_time").alias("_time"), F.col("table").try_cast("long").alias("table"))
