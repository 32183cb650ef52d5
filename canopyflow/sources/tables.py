"""Point tables: versioned, with day folders in each part."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow import config as C
from canopyflow.session import materialise
from canopyflow.sources.versions import COMMIT, VersionedTable

POINT = T.StructType([
    T.StructField("measurement", T.StringType()), T.StructField("id_board", T.StringType()),
    T.StructField("model_source", T.StringType()), T.StructField("freq", T.StringType()),
    T.StructField("_field", T.StringType()), T.StructField("_value", T.DoubleType()),
    T.StructField("_time", T.TimestampType()), T.StructField("seq", T.LongType()),
])
POINT_KEY = ("measurement", "id_board", "model_source", "freq", "_field", "_time")
DAY = "day"


def as_points(df: DataFrame, **tags: str) -> DataFrame:
    """Complete long rows to the stored schema; tags not given and not present are null."""
    cols = []
    for f in POINT:
        if f.name in tags:
            cols.append(F.lit(tags[f.name]).cast(f.dataType).alias(f.name))
        elif f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType))
        else:
            default = C.MEASUREMENT if f.name == "measurement" else None
            cols.append(F.lit(default).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def ensure_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a catalog table of points, in day folders, when it is missing; Spark's own writers fill it."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in POINT)
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({cols}, `{DAY}` date) USING parquet PARTITIONED BY (`{DAY}`){where}")


def point_table(spark: SparkSession, path: str, key: Sequence[str] = POINT_KEY) -> VersionedTable:
    """The points stored at ``path``: of points with one key the one written last counts, then the greatest ``seq``."""
    return VersionedTable(spark, path, POINT, key, [COMMIT, "seq"], (DAY, F.to_date("_time"), T.DateType()))


def read_table(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Points of a path; the bounds prune day folders and are pushed into the scan. A missing table is empty."""
    bounds = []
    if since is not None:
        bounds += [F.col(DAY) >= F.to_date(F.lit(since)), F.col("_time") >= F.lit(since).cast("timestamp")]
    if until is not None:
        bounds += [F.col(DAY) <= F.to_date(F.lit(until)), F.col("_time") < F.lit(until).cast("timestamp")]
    return point_table(spark, path).read(reduce(and_, bounds) if bounds else None)


def write_points(points: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> None:
    """Upsert into the table at ``path``. The cost is that of the points given: stored days are neither read nor rewritten, and readers
    see the points all at once. Null values are not written. Small parts are merged, and old ones dropped, now and then.

    A streaming ``writer`` numbers its batches; a batch that comes again is left out.
    """
    table = point_table(points.sparkSession, path)
    table.tidy(table.append(as_points(points).where("_value is not null"), writer, batch))


def save_predictions(preds: DataFrame, clean_path: str, archive_path: str, model_source: str | None, freq_min: int) -> DataFrame:
    """The same forecast points to the clean and the archive table, tagged with their frequency and source (None: that of each row)."""
    keys, tags = ["id_board", "_time"], {"freq": f"{freq_min}m"}
    if model_source is None:
        keys.append("model_source")
    else:
        tags["model_source"] = model_source
    fields = [c for c in C.PRED_FIELDS if c in preds.columns]
    long = preds.unpivot(keys, fields, "_field", "_value").where(F.col("_value").isNotNull())
    points = materialise(as_points(long.withColumn("seq", F.unix_micros("_time")), **tags))
    for path in (clean_path, archive_path):
        write_points(points, path)
    return points
