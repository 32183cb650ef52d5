"""Training frames, season models and forecasts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import aggregates as agg
from canopyflow.operators import reshape
from canopyflow.operators import sequence as seq
from canopyflow.plans import cycle, features, forecast, learn, recursion, retrain, ridge, season
from canopyflow.plans.store import ModelStore
from canopyflow.session import materialise
from canopyflow.sources import documents, events, tables
from checks.aggregates import reports
from checks.basics import r
from checks.registry import query
from checks.scans import scratch, us
from checks.sequences import BEFORE, FROM, MIN, UPTO

FEATURES = ("air_temp", "humidity", "water_temp", "tds", "soil_moisture")
#: every task of the catalogue over the measures that events has (no pressure, no light)
TASKS = {n: replace(t, features=tuple(f for f in t.features if f in FEATURES)) for n, t in C.TASKS.items()}
FREQ = 60


def hourly(spark, sf):
    """The wide series on a full hourly grid without gaps."""
    cols = [*FEATURES, "leaf_temp"]
    g = materialise(agg.resample(events.wide(spark, sf), cols, FREQ))
    return materialise(seq.fill(g, events.board_slices(spark, sf), cols, backward=True))


_COLS = [*FEATURES, "leaf_temp"]
_HOURLY = f"""hb AS (SELECT id_board, time_bucket(INTERVAL '60 minutes', _time) AS _time, {', '.join(f'avg({c}) AS {c}' for c in _COLS)} FROM wide GROUP BY 1, 2),
 hg AS (SELECT id_board, unnest(generate_series(min(_time), max(_time), INTERVAL '60 minutes')) AS _time FROM hb GROUP BY id_board),
 hj AS (SELECT * FROM hg LEFT JOIN hb USING (id_board, _time)),
 hourly AS (SELECT id_board, _time, {', '.join(f'coalesce(last_value({c} IGNORE NULLS) OVER {UPTO}, first_value({c} IGNORE NULLS) OVER {FROM}) AS {c}' for c in _COLS)} FROM hj),
 hd AS (SELECT *, {', '.join(f'{c} - last_value({c}) OVER {BEFORE} AS {c}_diff' for c in FEATURES)} FROM hourly),
 hl AS (SELECT *, {', '.join(f'lag({c}, {i}) OVER (PARTITION BY id_board ORDER BY _time) AS {c}_lag_{i}' for c in [*FEATURES, *[f'{f}_diff' for f in FEATURES], 'leaf_temp'] for i in range(1, 16))} FROM hd)"""
_FRAME = [c for c in features.model_columns(TASKS["t9"], FREQ) if not c.startswith("time_")]


@query("training_frame", f"""SELECT id_board, epoch_us(_time) AS t_us, {', '.join(f'round({c}, 6) AS {c}' for c in _FRAME)}, round(leaf_temp, 6) AS leaf_temp,
 round(sin(2 * pi() * (hour(_time) * 60) / 1440), 9) AS time_sin, round(cos(2 * pi() * (hour(_time) * 60) / 1440), 9) AS time_cos,
 row_number() OVER (PARTITION BY id_board ORDER BY _time) <= floor(count(*) OVER (PARTITION BY id_board) * 0.9) AS is_train
FROM hl WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _FRAME)} AND leaf_temp IS NOT NULL""", "wide", _HOURLY)
def training_frame(spark, sf):
    d = features.training_frame(hourly(spark, sf), events.board_slices(spark, sf), TASKS["t9"], FREQ)
    return d.select("id_board", us(), *[r(c, 6).alias(c) for c in [*_FRAME, "leaf_temp"]], r("time_sin").alias("time_sin"), r("time_cos").alias("time_cos"), "is_train")


def solved(name: str, src: str, n: int) -> str:
    """CTEs that solve ``src`` (g, m: n rows of n + 1 numbers) by elimination; the result is ``name`` (g, coef)."""
    return f"""{name}_r AS (SELECT g, 0 AS k, m FROM {src} UNION ALL SELECT g, k + 1, list_transform(range(1, {n + 1}), lambda i:
  CASE WHEN i = k + 1 THEN list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1])
  ELSE list_transform(range(1, {n + 2}), lambda j: m[i][j] - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END) FROM {name}_r WHERE k < {n}),
 {name} AS MATERIALIZED (SELECT g, list_transform(m, lambda x: x[{n + 1}]) AS coef FROM {name}_r WHERE k = {n})"""


def dot(columns) -> str:
    return " + ".join(f"coef[{i}] * ({c})" for i, c in enumerate(columns, 1))


_N_SEASON = 2 + 2 * season.PAIRS
_DAY = "(hour(_time) * 60 + minute(_time) + second(_time) / 60.0)"
_DESIGN = ["1.0", "(epoch_us(_time) / 1e6 - t0) / span", *[f"{f}(2 * pi() * {k} / 1440 * {_DAY})" for k in range(1, season.PAIRS + 1) for f in ("sin", "cos")]]
_X = [f"x{i}" for i in range(1, _N_SEASON + 1)]
_SEASON = f"""sp AS (SELECT *, epoch_us(_time) <= floor(quantile_cont(epoch_us(_time), 0.8) OVER (PARTITION BY _field)) AS is_train FROM (
  SELECT * FROM (UNPIVOT hourly ON {', '.join(FEATURES)} INTO NAME _field VALUE y) QUALIFY row_number() OVER (PARTITION BY id_board, _field ORDER BY _time DESC) <= 336)),
 sr AS (SELECT _field || '/all' AS g, * FROM sp UNION ALL SELECT _field || '/train', * FROM sp WHERE is_train),
 se AS (SELECT g, min(epoch_us(_time)) / 1e6 AS t0, greatest((max(epoch_us(_time)) - min(epoch_us(_time))) / 1e6, 1) AS span FROM sr GROUP BY g),
 sx AS (SELECT g, y, {', '.join(f'{d} AS {x}' for d, x in zip(_DESIGN, _X))} FROM sr JOIN se USING (g)),
 sm AS (SELECT g, [{', '.join('[' + ', '.join(f'sum({x} * {z})' for z in [*_X, 'y']) + ']' for x in _X)}] AS m FROM sx GROUP BY g),
 {solved('ss', 'sm', _N_SEASON)}"""


@query("season_fit", f"""SELECT _field, {_N_SEASON} AS terms, round(avg(abs(y - yhat)), 6) AS MAE, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS RMSE, count(*) AS n FROM (
 SELECT _field, y, {dot(_DESIGN)} AS yhat FROM sp JOIN se ON se.g = _field || '/train' JOIN ss ON ss.g = se.g WHERE NOT is_train) GROUP BY _field""",
       "wide", f"{_HOURLY}, {_SEASON}", recursive=True)
def season_fit(spark, sf):
    """Season models of all variables and their held-out errors."""
    models, errors = season.season_fit(hourly(spark, sf), FREQ, fields=FEATURES)
    return models.join(errors, "_field").select("_field", F.size("coef").alias("terms"), r("MAE", 6).alias("MAE"), r("RMSE", 6).alias("RMSE"), "n")


_TERMS = 2 + 2 * season.PAIRS


@query("season_residuals", f"""SELECT _field, unnest(range({_TERMS})) AS term, n, CAST(0 AS DOUBLE) AS moment FROM (SELECT _field, count(*) AS n FROM (
 SELECT * FROM (UNPIVOT hourly ON {', '.join(FEATURES)} INTO NAME _field VALUE y) QUALIFY row_number() OVER (PARTITION BY id_board, _field ORDER BY _time DESC) <= 336)
 GROUP BY _field)""", "wide", _HOURLY)
def season_residuals(spark, sf):
    """What makes a fit the least-squares one: residuals are orthogonal to every term, over the whole panel."""
    p = materialise(season.panel(hourly(spark, sf), FREQ, fields=FEATURES))
    models = materialise(season.fit_models(p))
    d = season.predict(p, models).join(models.select("_field", "t0", "span"), "_field").withColumn("_e", F.col("y") - F.col("yhat"))
    sums = d.groupBy("_field").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("_e") * x) for x in season.design()]).alias("_m"))
    moments = sums.select("_field", "n", F.posexplode("_m").alias("term", "moment"))
    return moments.select("_field", F.col("term").cast("long").alias("term"), "n", (F.bround("moment", 6) + 0.0).alias("moment"))


@query("env_forecast", f"""SELECT id_board, step, epoch_us(_time) AS t_us, _field, round(value, 6) AS value, from_model FROM (
 SELECT id_board, step, _time, _field, {dot(_DESIGN)} AS value, true AS from_model FROM ahead JOIN se ON true JOIN ss USING (g), LATERAL (SELECT replace(g, '/all', '') AS _field) WHERE g LIKE '%/all'
 UNION ALL SELECT id_board, step, _time, 'light_lux', 0.0, false FROM ahead)""", "wide",
       f"{_HOURLY}, {_SEASON}, ahead AS (SELECT id_board, step::INTEGER AS step, last + step * INTERVAL 60 MINUTE AS _time FROM (SELECT id_board, max(_time) AS last FROM hourly GROUP BY 1), range(1, 4) t(step))", recursive=True)
def env_forecast(spark, sf):
    h = hourly(spark, sf)
    models, _ = season.season_fit(h, FREQ, fields=FEATURES)
    return season.env_forecast(h, models, FREQ, 3, [*FEATURES, "light_lux"]).select("id_board", "step", us(), "_field", r("value", 6).alias("value"), "from_model")


POINT_TASKS = ("t1", "t4")
ALPHAS = learn.RIDGE["alpha"]


def _ridge_ctes(task: str) -> str:
    """Training rows of a point task, and the solutions of every fold and penalty (fold 3: all training rows)."""
    x = [*TASKS[task].features, "time_sin", "time_cos"]
    scale = {c: f"(max({c}) - min({c}))" for c in x}
    rows = ", ".join("[" + ", ".join([*(f"covar_pop({a}, {b}) * count(*) / ({scale[a]} * {scale[b]})" for b in x), f"covar_pop({a}, leaf_temp) * count(*) / {scale[a]}"]) + "]" for a in x)
    own = ", ".join(f"list_transform(range(1, {len(x) + 2}), lambda j: m[{i}][j] + CASE WHEN j = {i} THEN alpha ELSE 0 END)" for i in range(1, len(x) + 1))
    return f"""{task}_f AS (SELECT *, sin(2 * pi() * (hour(_time) * 60 + minute(_time)) / 1440) AS time_sin, cos(2 * pi() * (hour(_time) * 60 + minute(_time)) / 1440) AS time_cos FROM hourly),
 {task}_t AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY _time, id_board) AS rk, count(*) OVER () AS n FROM (
  SELECT * FROM {task}_f QUALIFY row_number() OVER (PARTITION BY id_board ORDER BY _time) <= floor(count(*) OVER (PARTITION BY id_board) * 0.9))),
 {task}_n AS (SELECT fold, [{rows}] AS m, [{', '.join(scale.values())}] AS span, [{', '.join(f'avg({c})' for c in x)}] AS mean, avg(leaf_temp) AS y0
  FROM {task}_t, range(0, 4) t(fold) WHERE fold = 3 OR rk <= n - n // 4 * (3 - fold) GROUP BY fold),
 {task}_m AS (SELECT fold || '/' || alpha AS g, [{own}] AS m FROM {task}_n, (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha)),
 {solved(f'{task}_s', f'{task}_m', len(x))},
 {task}_c AS MATERIALIZED (SELECT fold, split_part(g, '/', 2)::DOUBLE AS alpha, list_transform(range(1, {len(x) + 1}), lambda i: s.coef[i] / span[i]) AS coef,
  y0 - list_sum(list_transform(range(1, {len(x) + 1}), lambda i: s.coef[i] / span[i] * mean[i])) AS c0 FROM {task}_n JOIN {task}_s s ON split_part(g, '/', 1)::BIGINT = fold)"""


def _ridge_errors(task: str) -> str:
    x = [*TASKS[task].features, "time_sin", "time_cos"]
    return f"""SELECT '{task}' AS task, fold, alpha, round(avg(abs(leaf_temp - c0 - ({dot(x)}))), 6) AS mae FROM {task}_t, {task}_c
 WHERE fold < 3 AND rk > n - n // 4 * (3 - fold) AND rk <= n - n // 4 * (2 - fold) GROUP BY fold, alpha"""


@query("ridge_grid", " UNION ALL ".join(_ridge_errors(t) for t in POINT_TASKS), "wide", f"{_HOURLY}, " + ", ".join(_ridge_ctes(t) for t in POINT_TASKS), recursive=True)
def ridge_grid(spark, sf):
    """The error of every penalty on every time fold, from one set of normal equations a task."""
    h, s, out = hourly(spark, sf), events.board_slices(spark, sf), []
    for name in POINT_TASKS:
        train = features.training_frame(h, s, TASKS[name], FREQ).where("is_train")
        cols = features.model_columns(TASKS[name], FREQ)
        out += [(name, x.fold, x.penalty, round(x.mae, 6)) for x in ridge.grid(train, {"r": ridge.linear(cols)}, {"r": ALPHAS}, "leaf_temp", 3)]  # 15 numbers a task
    return spark.createDataFrame(out, "task string, fold long, alpha double, mae double")


_SOFT = [*TASKS["t4"].features, "time_sin", "time_cos"]


@query("soft_sensor", f"""SELECT id_board, epoch_us(_time) AS t_us, round(coalesce(last_value(v IGNORE NULLS) OVER {UPTO}, first_value(v IGNORE NULLS) OVER {FROM}), 6) AS leaf_temp FROM (
 SELECT id_board, _time, CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in TASKS['t4'].features)} THEN c0 + {dot(_SOFT)} ELSE leaf_temp END AS v FROM (
  SELECT *, sin(2 * pi() * (hour(_time) * 60 + minute(_time)) / 1440) AS time_sin, cos(2 * pi() * (hour(_time) * 60 + minute(_time)) / 1440) AS time_cos FROM hj),
  (SELECT * FROM t4_c WHERE fold = 3 AND alpha = 1.0))""", "wide", f"{_HOURLY}, {_ridge_ctes('t4')}", recursive=True)
def soft_sensor(spark, sf):
    """Leaf values estimated where all inputs are known, on the hourly grid with its gaps."""
    task, cols = TASKS["t4"], features.model_columns(TASKS["t4"], FREQ)
    train = materialise(features.training_frame(hourly(spark, sf), events.board_slices(spark, sf), task, FREQ).where("is_train"))
    model = learn.estimator(learn.Spec("r", "ridge", {}), {"alpha": 1.0}, cols, task.features, "leaf_temp", *learn._stats(train, "leaf_temp")).fit(train)
    grid = materialise(agg.resample(events.wide(spark, sf), [*FEATURES, "leaf_temp"], FREQ))
    d = forecast.soft_sensor(grid, events.board_slices(spark, sf), model, cols, task)
    return d.select("id_board", us(), r("leaf_temp", 6).alias("leaf_temp"))


#: ridge models of every task with all their penalties; forests and boosted trees are in grid_search_reports (times in the README)
_RIDGES = [s for s in learn.model_grid(FREQ) if s.family == "ridge" and not s.poly]
_stores: dict[tuple[str, str], str] = {}
#: tasks trained side by side
_AT_ONCE = 4


def model_store(spark, sf, h=None) -> str:
    """Season models and the winners of all tasks, trained once an application and read from the store by every query. ``h``: the
    hourly series, if the query has it. Tasks are trained side by side, for each is a row of short jobs."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stores:
        h, s, path = hourly(spark, sf) if h is None else h, events.board_slices(spark, sf), scratch(spark)

        def trained(task):
            return learn.winner(retrain.train_task(features.training_frame(h, s, task, FREQ), task, FREQ, _RIDGES))

        with ThreadPoolExecutor(_AT_ONCE) as pool:
            by_season = pool.submit(season.season_fit, h, FREQ, fields=FEATURES)
            best = dict(zip(TASKS, pool.map(trained, TASKS.values())))
        ModelStore(spark, path).save(FREQ, by_season.result()[0], best, TASKS)
        _stores[key] = path
    return _stores[key]


def loaded(spark, sf, h=None):
    return ModelStore(spark, model_store(spark, sf, h)).load(FREQ)


@query("grid_search_reports")
def grid_search_reports(spark, sf):
    """All penalties of the ridge models, with cubic terms and without, and a forest and boosted trees, over time folds."""
    task = TASKS["t4"]
    frame = features.training_frame(hourly(spark, sf), events.board_slices(spark, sf), task, FREQ)
    specs = [s for s in learn.model_grid(FREQ) if s.family == "ridge" and not s.drop_diff]
    specs += [learn.Spec("RandomForest", "forest", {"n_estimators": [10], "max_depth": [5], "min_samples_split": [2], "max_features": [1.0]}),
              learn.Spec("Boosted", "boosted", {"n_estimators": [5], "learning_rate": [0.1], "num_leaves": [31]})]
    return learn.report_frame(spark, "t4", retrain.train_task(frame, task, FREQ, specs))


@query("model_store", f"SELECT unnest({[*sorted(TASKS)]}) AS task, 'leaf_temp' AS target, true AS inputs_known, true AS has_error")
def model_registry(spark, sf):
    """The models in force, as another process finds them; each task makes all that its model takes."""
    made = F.create_map(*[x for n, t in TASKS.items() for x in (F.lit(n), F.array(*[F.lit(c) for c in features.model_columns(t, FREQ)]))])
    rows = ModelStore(spark, model_store(spark, sf)).registry(FREQ).where("task <> 'season'")
    return rows.select("task", "target", (F.size(F.array_except("columns", made[F.col("task")])) == 0).alias("inputs_known"), F.col("mae").isNotNull().alias("has_error"))


@query("recursive_forecast")
def recursive_forecast(spark, sf):
    h = hourly(spark, sf)
    trained = loaded(spark, sf, h)
    past = forecast.context(h, FREQ)
    env = materialise(forecast.env_columns(season.env_forecast(past, trained.season, FREQ, 3, FEATURES), FEATURES))
    return recursion.recursive_forecast(past, env, *trained.models["t9"], TASKS["t9"], FREQ).select("id_board", "step", us(), "value")


@query("score_all_boards")
def score_all_boards(spark, sf):
    """Every board by every group and every task of the catalogue, from stored models; groups with what was blended."""
    h = hourly(spark, sf)
    t = loaded(spark, sf, h)
    d = forecast.score_all(h, t.season, t.models, t.mae, FREQ, tasks=TASKS)
    return d.select("model_source", "id_board", "step", us(), "value", "vpd", *forecast.ENSEMBLE)


@query("forecast_cycle")
def forecast_cycle(spark, sf):
    """Points that the forecast job, which has only the paths of tables and models, leaves in the clean and in the archive table."""
    h, clean, archive = hourly(spark, sf), scratch(spark), scratch(spark)
    models = model_store(spark, sf, h)
    tables.write_points(tables.as_points(reshape.to_points(h.withColumn("seq", F.unix_micros("_time")), ("id_board", "_time", "seq"), [*FEATURES, "leaf_temp"])), clean)
    now = h.agg(F.max("_time")).first()[0] + timedelta(minutes=FREQ)
    cycle.run_forecasts(spark, clean, archive, models, FREQ, now, tasks=TASKS)
    saved = [tables.read_table(spark, p).where("_field rlike 'pred'").withColumn("kept_in", F.lit(n)) for n, p in (("clean", clean), ("archive", archive))]
    return saved[0].unionByName(saved[1]).select("kept_in", "id_board", "model_source", "freq", "_field", us(), "_value")


@query("report_round_trip", """SELECT task, model_name, round(MAE, 9) AS MAE, round(RMSE, 9) AS RMSE, round(train_MAE, 9) AS train_MAE, CAST(NULL AS DOUBLE) AS R_squared,
 'k' AS param, 2 AS importances FROM reports""", "reports")
def report_round_trip(spark, sf):
    """Reports written twice and read back: the second time they replace the first."""
    d = reports(spark, sf)
    given = {"MAE", "RMSE", "train_MAE"}
    d = d.select("task", "model_name", F.create_map(F.lit("k"), F.lit("1")).alias("best_params"),
                 *[F.col(m) if m in given else F.lit(None).cast("double").alias(m) for m in documents.METRICS],
                 *[F.lit(0.5).alias(t) for t in documents.TIMINGS], F.create_map(F.lit("a"), F.lit(0.25), F.lit("b"), F.lit(0.75)).alias("feature_importance"))
    path = scratch(spark)
    documents.write_reports(d.withColumn("MAE", F.lit(-1.0)), path)
    documents.write_reports(d, path)
    out = documents.read_report_lines(spark, path)
    return out.select("task", "model_name", *[r(c).alias(c) for c in sorted(given)], "R_squared", F.map_keys("best_params")[0].alias("param"), F.size("feature_importance").alias("importances"))


@query("forecast_document")
def forecast_document(spark, sf):
    """The documents of all groups and of the point tasks, from a real forecast."""
    h = hourly(spark, sf)
    t = loaded(spark, sf, h)
    given = forecast.forecasts(h, t.season, t.models, t.mae, FREQ, single=POINT_TASKS, tasks=TASKS)
    doc = forecast.documents(given, FREQ)
    return doc.select("id_board", "model_source", "frequency", F.size("leaf_temperature.historical").alias("past"), F.size("leaf_temperature.forecast").alias("steps"),
                      F.to_json(F.struct("leaf_temperature", "environmental_data", "vpd", "ensemble_details")).alias("document"))


_BLEND = f"""fa AS (SELECT id_board, CAST(hour(_time) AS INT) AS step, avg(leaf_temp) AS v FROM hourly GROUP BY 1, 2), fe AS (SELECT id_board, CAST(hour(_time) AS INT) AS step, avg(air_temp) AS v FROM hourly GROUP BY 1, 2)"""


@query("blend_forecasts", """SELECT id_board, step, round(fa.v * (1 / 0.700001) / (1 / 0.700001 + 1 / 0.400001) + fe.v * (1 / 0.400001) / (1 / 0.700001 + 1 / 0.400001), 3) AS value
FROM fa JOIN fe USING (id_board, step)""", "wide", _HOURLY + ", " + _BLEND)
def blend_forecasts(spark, sf):
    h = hourly(spark, sf).withColumn("step", F.hour("_time"))
    a = h.groupBy("id_board", "step").agg(F.avg("leaf_temp").alias("value"))
    e = h.groupBy("id_board", "step").agg(F.avg("air_temp").alias("value"))
    return forecast.blend(e, a, 0.4, 0.7).select("id_board", "step", "value")


@query("vpd_forecast", """SELECT id_board, step, round(CASE WHEN d > 0 THEN d ELSE 0.0 END, 9) AS vpd FROM (
 SELECT id_board, step, 0.61078 * exp(17.27 * l / (l + 237.3)) - 0.61078 * exp(17.27 * a / (a + 237.3)) * h / 100.0 AS d FROM (
 SELECT id_board, CAST(hour(_time) AS INT) AS step, avg(leaf_temp) AS l, avg(air_temp) AS a, avg(humidity) AS h FROM hourly GROUP BY 1, 2))""", "wide", _HOURLY)
def vpd_forecast(spark, sf):
    h = hourly(spark, sf).withColumn("step", F.hour("_time"))
    f = h.groupBy("id_board", "step").agg(F.avg("leaf_temp").alias("value"))
    e = h.groupBy("id_board", "step").agg(F.avg("air_temp").alias("air_temp"), F.avg("humidity").alias("humidity"))
    return forecast.with_forecast_vpd(f, e).select("id_board", "step", r("vpd").alias("vpd"))
