import random

import public_tokenizers
import pytest
from pyspark import cloudpickle

import canopyflow

cloudpickle.register_pickle_by_value(canopyflow)
#: columns whose names the operators use themselves
CLASH = {c: "x" for c in ("id", "text_", "doc", "h", "lo", "n", "bucket", "meet", "node", "label", "task", "nth", "length", "piece", "score", "_id", "keep_lang", "predicted", "held_out",
                            "kept", "spans", "n_bytes", "component_id", "doc_column_0", "recipe", "term", "terms", "tf", "phrase", "rank")}


@pytest.fixture(scope="session")
def bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns of clashing names and nulls in all others."""
    def make(rows, parts=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
        return spark.createDataFrame([(i, t, None, None, None, *CLASH.values()) for i, t in rows], schema).repartition(parts)
    return make


@pytest.fixture(scope="session")
def odd():
    """Null ids and texts, empty and white texts, repeated rows, repeated ids, a very long text."""
    rnd = random.Random(4)
    long = " ".join(rnd.choice(["alpha", "beta,", "gam\nma", "  ", "été", "x<|endoftext|>y", "12", "'s"]) for _ in range(30_000))
    return [(1, None), (2, ""), (3, " \n "), (None, "no id"), (None, None), (4, "same row"), (4, "same row"), (5, "one"), (5, "other"), (6, long),
            (7, "<|endoftext|>"), (8, "日本語 😀 a  b"), (9, "same row")]
