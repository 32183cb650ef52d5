"""Connected components of a distributed list of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import local_labels, map_arrow, stored

_EDGE = (T.StructField("a", T.LongType()), T.StructField("b", T.LongType()))


def _contract(batches):
    """Each task's links as stars around the smallest node: fewer links, the same components."""
    for batch in batches:
        nodes, at = np.unique(np.concatenate([batch.column("a").to_numpy(), batch.column("b").to_numpy()]), return_inverse=True)
        label = local_labels(at[:batch.num_rows], at[batch.num_rows:], len(nodes))
        away = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[label[away]])], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for every node of the links (``a``, ``b``, both long).

    Large-star and small-star rounds (Kiveris and others, 2014) until nothing changes; the number of rounds grows with the logarithm
    of the nodes. Each half round joins links with one row per node; both sides are read from stored tables, so that adaptive
    execution can split a node with very many links.
    """
    links = stored(map_arrow(edges.where("a <> b"), _contract, *_EDGE).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        seen = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()  # one row
        if seen == before or not seen.n:
            break
        before = seen
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m")))
        up = links.join(low, links.lo == low.node).select(F.col("hi").alias("x"), F.col("m").alias("y"))  # larger neighbours of each node
        large = stored(up.where("x <> y").select(F.col("x").alias("hi"), F.col("y").alias("lo")).distinct())
        low = stored(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "node"))
        down = large.join(low, large.hi == low.node)
        small = down.select(F.col("lo").alias("x"), F.col("m").alias("y")).union(low.select("node", "m"))
        links = stored(small.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(links.select("lo", "lo").distinct())
