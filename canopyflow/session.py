"""Session set-up and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
#: folders of local applications without the setting, which cannot be set once a session runs
_own: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Stored times are UTC, so the session zone has to be UTC too."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only where none is named."""
    context = spark.sparkContext
    named = spark.conf.get(_CHECKPOINT_CONF, None) or context.getConf().get(_CHECKPOINT_CONF)
    if named:
        return named
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError(f"set {_CHECKPOINT_CONF} to a folder every executor can reach (master {context.master})")
    if not _own.get(context.applicationId):
        _own[context.applicationId] = tempfile.mkdtemp(prefix="canopyflow-")
    return _own[context.applicationId]


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so a lost executor re-reads files in place of recomputing the steps before.
    Used between the steps of a pipeline that each need more than one pass over their input.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/canopyflow/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the tables that ``materialise`` returned; nothing that is still to be computed may read them."""
    for df in frames:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
