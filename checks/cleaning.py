"""The fill and the cleaning pipeline, checked by recursive SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopyflow.operators import sequence as seq
from canopyflow.operators.gaussfill import gaussian_fill
from canopyflow.plans import clean
from canopyflow.session import materialise
from canopyflow.sources import events, tables
from checks.basics import r
from checks.registry import query
from checks.scans import us
from checks.sequences import MIN, SIX

R6 = 6


def fill_ctes(name: str, src: str, cap: float = 42, two_var: float = 450.0) -> str:
    """CTEs that fill ``src`` (g, t in microseconds, v, w) row by row; the result is ``name`` (g, t, v)."""
    bell = f"exp(-(((x.t - b.t) / 60000000.0) * ((x.t - b.t) / 60000000.0)) / {two_var})"
    near = f"list_filter(r.hist || [b.nx.a, b.nx.b], lambda x: x IS NOT NULL)"
    return f"""{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t) AS rn FROM {src}),
{name}_o AS (SELECT g, rn, {{'t': t, 'v': v, 'w': w}} AS o, lead({{'t': t, 'v': v, 'w': w}}) OVER (PARTITION BY g ORDER BY rn) AS o2 FROM {name}_n WHERE v IS NOT NULL),
{name}_b AS MATERIALIZED (SELECT g, rn, t, v, w, first_value(CASE WHEN o IS NOT NULL THEN {{'a': o, 'b': o2}} END IGNORE NULLS) OVER (PARTITION BY g ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx
  FROM {name}_n LEFT JOIN {name}_o USING (g, rn)),
{name}_r AS (SELECT g, 0::BIGINT AS rn, NULL::DOUBLE AS t, NULL::DOUBLE AS val, []::STRUCT(t DOUBLE, v DOUBLE, w DOUBLE)[] AS hist FROM {name}_b WHERE rn = 1
 UNION ALL SELECT g, rn, t, val, CASE WHEN val IS NULL THEN hist ELSE list_append(hist, {{'t': t, 'v': val, 'w': w}})[-5:] END FROM (
  SELECT b.g, b.rn, b.t, b.w, r.hist, CASE WHEN b.v IS NOT NULL THEN b.v
   WHEN CASE WHEN len(r.hist) > 0 AND b.nx IS NOT NULL THEN b.nx.a.t - r.hist[-1].t WHEN len(r.hist) > 0 THEN b.t - r.hist[-1].t ELSE b.nx.a.t - b.t END <= {cap * MIN} THEN
    list_sum(list_transform({near}, lambda x: x.v * x.w * {bell})) / list_sum(list_transform({near}, lambda x: x.w * {bell})) END AS val
  FROM {name}_r r JOIN {name}_b b ON b.g = r.g AND b.rn = r.rn + 1)),
{name} AS (SELECT g, t, val AS v FROM {name}_r WHERE rn > 0)"""


_WEIGHTED = f"""lw AS (SELECT id_board, epoch_us(_time) AS us, leaf_temp AS v, CASE WHEN leaf_temp IS NULL THEN 1 WHEN pt IS NULL OR epoch_us(_time) - pt > {12 * MIN} THEN 2
  WHEN leaf_temp = pv THEN 1 ELSE 2 END AS w FROM (SELECT *, lag(epoch_us(_time)) OVER (PARTITION BY id_board ORDER BY _time) AS pt,
  last_value(leaf_temp IGNORE NULLS) OVER (PARTITION BY id_board ORDER BY _time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM wide))"""


@query("gaussian_fill", "SELECT g AS id_board, CAST(t AS BIGINT) AS t_us, round(v, 6) AS leaf_temp FROM f", "wide",
       _WEIGHTED + ", s AS (SELECT id_board AS g, us::DOUBLE AS t, v, w::DOUBLE AS w FROM lw), " + fill_ctes("f", "s"), recursive=True)
def gaussian_fill_query(spark, sf):
    w = events.wide(spark, sf).select("id_board", "_time", "leaf_temp")
    s = events.board_slices(spark, sf)
    d = materialise(seq.leaf_weights(w, s))
    return gaussian_fill(d, s, {"leaf_temp": F.col("leaf_weight")}).select("id_board", us(), r("leaf_temp", R6).alias("leaf_temp"))


STEPS = {"b1": (clean.TDS_FLOOR, clean.LEAF_FILL, clean.ANOMALIES)}  # b0 runs them all
_CLEANED = _WEIGHTED + """,
 s1 AS (SELECT id_board || '/leaf_temp' AS g, us::DOUBLE AS t, v, CASE WHEN id_board = 'b1' THEN 1.0 ELSE w END AS w FROM lw
  UNION ALL SELECT id_board || '/tds', epoch_us(_time)::DOUBLE, CASE WHEN NOT tds < 30 THEN tds END, 1.0 FROM wide
  UNION ALL SELECT id_board || '/water_temp', epoch_us(_time)::DOUBLE, CASE WHEN NOT water_temp < 10 THEN water_temp END, 1.0 FROM wide),
 """ + fill_ctes("f1", "s1") + """,
 s2 AS (SELECT g, t, CASE WHEN NOT coalesce(v > m * 1.3 OR v < m * (1 / 1.3), false) THEN v END AS v, 1.0 AS w FROM (
  SELECT *, median(v) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m FROM f1 WHERE g LIKE '%/tds')),
 """ + fill_ctes("f2", "s2") + """,
 cleaned AS (SELECT split_part(g, '/', 1) AS id_board, split_part(g, '/', 2) AS f, t, v FROM (SELECT * FROM f1 WHERE g NOT LIKE '%/tds' UNION ALL SELECT * FROM f2)
  UNION ALL SELECT id_board, 'air_temp', epoch_us(_time)::DOUBLE, air_temp FROM wide
  UNION ALL SELECT id_board, 'humidity', epoch_us(_time)::DOUBLE, humidity FROM wide
  UNION ALL SELECT id_board, 'soil_moisture', epoch_us(_time)::DOUBLE, soil_moisture FROM wide)"""


@query("clean_series", "SELECT id_board, CAST(t AS BIGINT) AS t_us, f AS _field, round(v, 6) AS _value FROM cleaned",
       "wide", _CLEANED, recursive=True)
def clean_series(spark, sf):
    d = clean.clean_series(events.wide(spark, sf), events.board_slices(spark, sf), STEPS)
    long = d.unpivot(["id_board", "_time"], SIX, "_field", "_value")
    return long.select("id_board", us(), "_field", r("_value", R6).alias("_value"))


def _grid_ctes(freq: int, cap: int) -> str:
    p = "PARTITION BY id_board, f"
    return f""", gb AS (SELECT id_board, f, CAST(floor(t / {freq * MIN}) AS BIGINT) AS b, avg(v) AS v FROM cleaned GROUP BY ALL),
 ge AS (SELECT id_board, unnest(range(min(b), max(b) + 1)) AS b FROM gb GROUP BY id_board),
 gg AS (SELECT id_board, f, b, v FROM ge CROSS JOIN (SELECT DISTINCT f FROM gb) LEFT JOIN gb USING (id_board, f, b)),
 gm AS (SELECT *, last_value(v IGNORE NULLS) OVER ({p} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  last_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER ({p} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pb,
  first_value(v IGNORE NULLS) OVER ({p} ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN v IS NOT NULL THEN b END IGNORE NULLS) OVER ({p} ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb,
  count(v) OVER ({p} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM gg),
 gi AS (SELECT id_board, f, b, CASE WHEN v IS NOT NULL THEN v WHEN gap > {cap} THEN NULL WHEN nb IS NULL THEN pv ELSE pv + (nv - pv) * (b - pb) / (nb - pb) END AS v
  FROM (SELECT *, count(*) FILTER (WHERE v IS NULL) OVER ({p}, run) AS gap FROM gm))"""


@query("sync_clean", f"SELECT id_board, f AS _field, b * {6 * MIN} AS t_us, round(v, 6) AS _value FROM gi WHERE v IS NOT NULL", "wide", _CLEANED + _grid_ctes(6, 7), recursive=True)
def sync_clean(spark, sf):
    """First run of the incremental job: no clean points yet, so everything is cleaned."""
    raw = events.points(spark, sf)
    none = tables.as_points(raw).limit(0)
    return clean.sync_clean(raw, none, 6, STEPS).select("id_board", "_field", us(), r("_value", R6).alias("_value"))


#: newest clean stamps of the boards, far apart
CLEAN_MARKS = {"b0": "2024-01-09 06:00:00", "b1": "2024-01-20 18:00:00"}
_NEAR = f"""marks(id_board, mark) AS (VALUES {', '.join(f"('{b}', TIMESTAMP '{t}')" for b, t in CLEAN_MARKS.items())}),
 near AS (SELECT wide.* FROM wide JOIN marks USING (id_board) WHERE _time >= mark - INTERVAL 60 MINUTE)"""


@query("sync_clean_newer", f"""SELECT id_board, f AS _field, b * {6 * MIN} AS t_us, round(v, 6) AS _value FROM gi JOIN marks USING (id_board)
 WHERE v IS NOT NULL AND b * {6 * MIN} > epoch_us(mark)""", "wide", _NEAR + ", " + _CLEANED.replace("FROM wide", "FROM near") + _grid_ctes(6, 7), recursive=True)
def sync_clean_newer(spark, sf):
    """A later run: each board is cleaned from an hour before its own newest clean stamp, and what is newer comes out."""
    raw = events.points(spark, sf)
    marks = spark.createDataFrame(list(CLEAN_MARKS.items()), "id_board string, mark string")
    stored = tables.as_points(marks.select("id_board", F.col("mark").cast("timestamp").alias("_time"), F.lit("air_temp").alias("_field"), F.lit(1.0).alias("_value")))
    forecasts = stored.withColumn("_field", F.lit("air_temp_pred")).withColumn("_time", F.col("_time") + F.expr("INTERVAL 5 DAYS"))  # not measured
    return clean.sync_clean(raw, stored.unionByName(forecasts), 6, STEPS).select("id_board", "_field", us(), r("_value", R6).alias("_value"))
