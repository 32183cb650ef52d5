"""The stages of ``corpus_pipeline``: each takes and, but for the last, returns the columns of ``documents``.

Texts are whole throughout, other columns may have any names. A null text is empty; rows that repeat a ``doc_id`` stay or go together in
near-dedup; rows without one are never copies there and have no order in ``repeats`` but that of their texts. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.llm import packing as bins
from canopyflow.llm import quality as classifier
from canopyflow.llm import simhash, suffix_dedup
from canopyflow.llm.common import stored


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that clash with nothing an operator adds, and the new name of each."""
    names = {c: f"doc_column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, scores at 0.7 or more."""
    space = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, names = _plain(docs)
    good = classifier.score(plain, space, threshold=0.7, id_col=names["doc_id"], text_col=names["text"], keep=tuple(names.values())).where("predicted = 1")
    return good.select(*names.values()).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints are at most 3 bits apart, in chains, the one with the smallest id."""
    found = simhash.near_duplicates(docs, words=3, radius=3, seed=42)
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays")
    return docs.join(stored(gone.select("doc_id")), "doc_id", "left_anti").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier too; characters are removed whole, no document is."""
    plain, names = _plain(docs)
    keep = tuple(n for c, n in names.items() if c not in ("doc_id", "text", "n_chars"))
    cut = suffix_dedup.cut_repeats(plain, length=100, id_col=names["doc_id"], text_col=names["text"], keep=keep, whole_characters=True)
    cut = cut.withColumn(names["text"], F.decode("kept", "utf-8"))
    return cut.withColumn(names["n_chars"], F.char_length(names["text"]).cast("long")).select(*names.values()).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids and places in sequences."""
    return bins.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2).withColumn("ids_crc32", F.crc32("ids"))
