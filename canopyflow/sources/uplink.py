"""Compact JSON of the radio link: decoding, encoding and clock replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow.config import UPLINK_KEYS
from canopyflow.operators.filters import required

INTEGER_KEYS = ("sid", "ts", "id")


def decode_uplink(df: DataFrame, col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(decoded rows, dead letters).

    Known short keys become typed columns, a ``sync`` flag stays text, all other keys stay in ``extra``.
    """
    pairs = F.from_json(col, "map<string,string>", {"mode": "PERMISSIVE"})
    parsed = df.withColumn("_m", pairs)
    broken = F.coalesce(F.size("_m"), F.lit(0)) <= 0  # no object, or nothing in it
    m = F.col("_m")

    def value(short: str, name: str) -> Column:
        text = F.coalesce(m[short], m[name])
        kind = "long" if short in INTEGER_KEYS else "double"
        return text.try_cast(kind).alias(name)

    known = [*UPLINK_KEYS, *UPLINK_KEYS.values(), "sync"]
    good = parsed.where(~broken).select(
        *[c for c in df.columns if c != col],
        *[value(s, n) for s, n in UPLINK_KEYS.items()],
        m["sync"].alias("sync"),
        F.map_filter(m, lambda k, _: ~k.isin(known)).alias("extra"),
    )
    return good, parsed.where(broken).drop("_m")


def _num(name: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.coalesce(F.col(name), F.lit(0.0)))


def encode_uplink() -> Column:
    """Compact JSON text of a telemetry row; absent measures are 0.00."""
    parts = []
    for i, (short, name) in enumerate(UPLINK_KEYS.items()):
        text = F.col(name).cast("long").cast("string") if short in INTEGER_KEYS else _num(name, 2)
        parts += [F.lit(f'{"," if i else "{"}"{short}":'), text]
    return F.concat(*parts, F.lit("}"))


def encode_command(nid: str = "node_id", act: str = "actuator", val: str = "value", dur: str = "duration_s") -> Column:
    return F.to_json(F.struct(F.col(nid).cast("long").alias("nid"), F.col(act).cast("string").alias("act"),
                              F.col(val).cast("long").alias("val"), F.col(dur).cast("long").alias("dur")))


def encode_ack(nid: str = "node_id") -> Column:
    return F.to_json(F.struct(F.lit(1).alias("ack"), F.col(nid).cast("long").alias("nid")))


def sync_replies(df: DataFrame, now: Column, flag: str = "sync") -> DataFrame:
    """The clock answer to each request frame."""
    reply = F.to_json(F.struct(F.lit(1).alias("sync"), F.col("star_id").alias("sid"), F.unix_seconds(now).alias("ts")))
    return df.where(required(flag)).select("star_id", reply.alias("reply"))
