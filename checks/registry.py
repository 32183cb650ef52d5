"""Pairs each query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_FIELD = """CASE event_type WHEN 'view' THEN 'air_temp' WHEN 'click' THEN 'humidity' WHEN 'purchase' THEN 'tds'
       WHEN 'signup' THEN 'leaf_temp' WHEN 'error' THEN 'water_temp' END"""


def _cell(event: str, field: str) -> str:
    return f"arg_max(value, event_id) FILTER (WHERE event_type = '{event}' AND value IS NOT NULL) AS {field}"


VIEWS = {
    "ev": "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events",
    "points": f"""SELECT event_id AS seq, 'b' || (user_id % 2) AS id_board, ts AS _time, {_FIELD} AS _field, value AS _value FROM ev
      UNION ALL SELECT event_id, 'b' || (user_id % 2), ts, 'soil_moisture', k FROM ev""",
    "wide": f"""SELECT 'b' || (user_id % 2) AS id_board, ts AS _time, {_cell('view', 'air_temp')}, {_cell('click', 'humidity')},
      CAST(NULL AS DOUBLE) AS pressure, {_cell('error', 'water_temp')}, {_cell('purchase', 'tds')},
      arg_max(k, event_id) FILTER (WHERE k IS NOT NULL) AS soil_moisture, CAST(NULL AS DOUBLE) AS light_lux,
      {_cell('signup', 'leaf_temp')} FROM ev GROUP BY 1, 2""",
    "packets": """SELECT event_id AS seq, 'n' || (user_id % 20) AS node_id, 'h' || (user_id % 7) AS star_id, ts AS _time,
      event_type, value, k FROM ev""",
    "reports": """SELECT event_type AS task, 'm' || (user_id % 5) AS model_name, avg(value) AS MAE, sqrt(avg(value * value)) AS RMSE,
      avg(k) AS train_MAE FROM ev GROUP BY 1, 2""",
    "importances": """SELECT event_type AS task, 'm' || (user_id % 5) AS model_name, 'poly__reading_' || CAST(k % 17 AS BIGINT) AS feature,
      avg(value) - 24 AS importance FROM ev GROUP BY 1, 2, 3""",
}
_NEEDS = {"ev": (), "points": ("ev",), "wide": ("ev",), "packets": ("ev",), "reports": ("ev",), "importances": ("ev",)}


def with_views(names: str, body: str, more: str = "") -> str:
    """Prefix a body with the named views (and what they need)."""
    wanted: list[str] = []
    for n in names.split():
        for m in (*_NEEDS[n], n):
            if m not in wanted:
                wanted.append(m)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    return f"WITH {ctes}{', ' + more if more else ''}\n{body}"


def query(name: str, sql: str | None = None, views: str = "ev", more: str = "", recursive: bool = False):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            text = with_views(views, sql, more)
            SQL[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text
        return fn
    return add
