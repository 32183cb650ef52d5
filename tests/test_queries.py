"""Every registered query against its SQL, and the ordered ones again with hot series cut in narrow slices."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from canopyflow.operators import slicing
from checks import registry
from checks.compare import compare

QUERIES, SQL = registry.QUERIES, registry.SQL  # those of the training-data operators are tested in tests/llm
HEAVY = {"score_all_boards", "recursive_forecast", "grid_search_reports", "forecast_cycle"}  # trained models: covered by test_models
ORDERED = ["lag_features", "diff_features", "forward_fill", "fill_both_ways", "spike_filter", "sessions", "leaf_weights", "moisture_alerts",
           "fallback_lookup", "apply_fallback", "topology_changes", "fraction_split", "ts_folds", "gap_size", "interpolate", "command_outcomes",
           "dispatch", "quantile_split", "gaussian_fill"]
COMPOSED = ["clean_series", "sync_clean", "training_frame"]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in HEAVY])
def test_query(spark, con, sf, name):
    verdict, _, rows = compare(spark, con, QUERIES[name], SQL.get(name), sf)
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0


@pytest.mark.parametrize("name, max_rows", [(n, 3) for n in ORDERED] + [("sessions", 40), ("apply_fallback", 40), ("ts_folds", 40)] + [(n, 40) for n in COMPOSED])
def test_narrow_slices(spark, con, sf, name, max_rows, monkeypatch):
    """40 rows per slice: a day each; 3 rows: an hour or less."""
    monkeypatch.setattr(slicing, "MAX_ROWS", max_rows)
    assert compare(spark, con, QUERIES[name], SQL[name], sf)[0] == "ok"


def test_sql_only_for_queries():
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
