"""Learning and forecasting against plain loops."""

import threading
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import slicing as sl
from canopyflow.plans import features, forecast, learn, recursion, retrain, ridge, season
from canopyflow.plans.store import ModelStore
from checks import models

T0 = datetime(2024, 5, 1)
TASK = C.Task("t9", ("air_temp", "humidity"), True, True, 3)
POINT = C.Task("t4", ("air_temp", "humidity"), False, False)


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(7)
    rows = []
    for b in ("b0", "b1"):
        for i in range(400):
            day = np.sin(2 * np.pi * i / 240)
            air, hum = 20 + 5 * day + rng.normal(0, .1), 60 - 10 * day + rng.normal(0, .1)
            rows.append((b, T0 + timedelta(minutes=6 * i), float(air), float(hum), float(0.8 * air + 0.05 * hum + rng.normal(0, .05))))
    d = spark.createDataFrame(rows, "id_board string, _time timestamp, air_temp double, humidity double, leaf_temp double")
    return d.persist()


@pytest.fixture(scope="module")
def frame(wide):
    return features.training_frame(wide, sl.fit(wide, ["id_board"]), POINT, 6).persist()


def test_stored_models_are_trained_side_by_side(spark, monkeypatch):
    """Two tasks are in training at once, on the series that the query has; each task gets its own winner."""
    met, saved = threading.Barrier(2), {}

    def train_task(frame, task, *_):
        met.wait(30)
        return [task.name]

    monkeypatch.setattr(models, "_stores", {})
    monkeypatch.setattr(models, "hourly", lambda *_: pytest.fail("the series was made again"))
    monkeypatch.setattr(models.events, "board_slices", lambda *_: None)
    monkeypatch.setattr(models.features, "training_frame", lambda h, s, task, freq: h)
    monkeypatch.setattr(models.retrain, "train_task", train_task)
    monkeypatch.setattr(models.learn, "winner", lambda fitted: fitted[0])
    monkeypatch.setattr(models.season, "season_fit", lambda h, *_, **__: (h, None))
    monkeypatch.setattr(models.ModelStore, "save", lambda self, freq, season_models, best, tasks: saved.update(best))
    assert models.model_store(spark, "nowhere", "series") == models.model_store(spark, "nowhere")
    assert saved == {n: t.name for n, t in models.TASKS.items()}


def test_ridge_equals_closed_form(spark, frame):
    cols = features.model_columns(POINT, 6)
    n, spread = learn._stats(frame, "leaf_temp")
    model = learn.estimator(learn.Spec("r", "ridge", {}), {"alpha": 10.0}, cols, POINT.features, "leaf_temp", n, spread).fit(frame)
    pdf = frame.toPandas()
    x = pdf[cols].to_numpy()
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    xc, yc = x - x.mean(0), pdf["leaf_temp"] - pdf["leaf_temp"].mean()
    want = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(len(cols)), xc.T @ yc)
    assert np.allclose(model.stages[-1].coefficients.toArray(), want, rtol=1e-6)


def test_poly_names_match_the_terms(spark):
    from pyspark.ml.feature import PolynomialExpansion
    d = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(spark.createDataFrame([(2.0, 3.0)], "a double, b double"))
    got = PolynomialExpansion(degree=3, inputCol="v", outputCol="p").transform(d).first()["p"].toArray().tolist()
    value = lambda n: float(np.prod([{"a": 2.0, "b": 3.0}[t.split("^")[0]] ** int((t.split("^") + ["1"])[1]) for t in n.removeprefix("poly__").split()]))
    assert [value(n) for n in learn.poly_names(["a", "b"])] == got


def test_grid_search_and_store(spark, wide, frame, tmp_path):
    specs = [learn.Spec("Ridge_linear", "ridge", {"alpha": [0.01, 100.0]}), learn.Spec("RandomForest", "forest", {
        "n_estimators": [3], "max_depth": [2], "min_samples_split": [2], "max_features": [1.0]})]
    fitted = retrain.train_task(frame, POINT, 6, specs)
    best = learn.winner(fitted)
    assert best.spec.name == "Ridge_linear" and best.params == {"alpha": 0.01}
    reports = learn.report_frame(spark, "t4", fitted)
    assert reports.count() == 2 and reports.where("MAE IS NULL").count() == 0
    store = ModelStore(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.load(6)
    models, _ = season.season_fit(wide, 6, fields=["air_temp"])
    first = store.save(6, models, {"t4": best}, {"t4": POINT})
    store.save(30, models, {"t4": best}, {"t4": POINT})
    got = ModelStore(spark, str(tmp_path)).load(6)
    model, cols = got.models["t4"]
    assert cols == best.cols and got.mae == {"t4": best.metrics["MAE"]} and got.season.count() == 1
    assert model.transform(frame).first()["prediction"] == pytest.approx(best.model.transform(frame).first()["prediction"])
    assert {(r.task, r.best_model, r.target) for r in store.registry(6).collect()} == {("t4", "Ridge_linear", "leaf_temp"), ("season", None, None)}
    other = fitted[1]
    second = store.save(6, models, {"t8": other}, {"t8": POINT})  # t4 keeps its model, the season models are new
    assert {r.task: r.run for r in store.registry(6).collect()} == {"t4": first, "t8": second, "season": second}
    assert store.load(6).models["t8"][1] == other.cols
    third = store.save(6, models, {"t4": best}, {"t4": POINT})
    store.prune(grace_s=0)
    assert {p.name for p in (tmp_path / "runs").iterdir()} >= {second, third} and first not in {p.name for p in (tmp_path / "runs").iterdir()}
    assert set(store.load(6).models) == {"t4", "t8"} and set(store.load(30).models) == {"t4"}


def test_a_training_run_that_dies_leaves_the_old_models(spark, frame, wide, tmp_path, monkeypatch):
    best = learn.winner(retrain.train_task(frame, POINT, 6, [learn.Spec("Ridge_linear", "ridge", {"alpha": [0.01]})]))
    models, _ = season.season_fit(wide, 6, fields=["air_temp"])
    store = ModelStore(spark, str(tmp_path))
    run = store.save(6, models, {"t4": best}, {"t4": POINT})
    with monkeypatch.context() as m:
        m.setattr(store.table, "append", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.save(6, models, {"t4": best}, {"t4": POINT})
    assert {r.run for r in store.registry(6).collect()} == {run} and set(store.load(6).models) == {"t4"}


@pytest.mark.parametrize("poly", [False, True])
def test_ridge_grid_equals_a_fit_for_each_fold_and_penalty(frame, poly):
    cols = features.model_columns(POINT, 6)
    train = frame.where("is_train").drop("is_train")
    specs = {n: learn.Spec(n, "ridge", {"alpha": [0.01, 1.0, 100.0]}, drop, poly) for n, drop in (("all", False), ("no_diff", True))}
    terms = {n: (ridge.cubic if poly else lambda c, _: ridge.linear(c))(learn._own(s, cols), POINT.features) for n, s in specs.items()}
    got = ridge.grid(train, terms, {n: [0.01, 1.0, 100.0] for n in specs}, "leaf_temp", 3)
    assert len(got) == 18
    from canopyflow.operators.aggregates import regression_metrics
    from canopyflow.operators.sequence import ts_folds
    marked = ts_folds(train, sl.fit(train, []), 3).persist()
    for s in got[::5]:
        a, b = (marked.where(f"fold = {s.fold} and role = '{r}'") for r in ("train", "test"))
        model = learn.estimator(specs[s.variant], {"alpha": s.penalty}, cols, POINT.features, "leaf_temp", *learn._stats(a, "leaf_temp")).fit(a)
        assert s.mae == pytest.approx(regression_metrics(model.transform(b), "leaf_temp", "prediction").first()["MAE"], rel=1e-5)
        pdf = b.toPandas()
        own = sum(w * np.prod([pdf[c] for c in t], axis=0) for t, w in zip(s.terms, s.coef)) + s.constant
        assert np.abs(own - pdf["leaf_temp"]).mean() == pytest.approx(s.mae, rel=1e-9)


def test_ridge_with_a_constant_column_and_small_groups(spark, frame, monkeypatch):
    monkeypatch.setattr(ridge, "_ROWS", 7)
    train = frame.where("is_train").withColumn("flat", F.lit(3.0)).repartition(5)
    with_flat, without = (ridge.grid(train, {"r": ridge.linear(c)}, {"r": [1.0]}, "leaf_temp", 2) for c in (["air_temp", "flat"], ["air_temp"]))
    assert [s.mae for s in with_flat] == pytest.approx([s.mae for s in without]) and all(s.coef[1] == 0 for s in with_flat)
    assert ridge.grid(train.limit(0), {"r": ridge.linear(["air_temp"])}, {"r": [1.0]}, "leaf_temp", 2) == []


def test_permutation_importance_equals_one_shuffle_after_the_other(frame):
    import math
    import random
    cols = features.model_columns(POINT, 6)
    model = learn.estimator(learn.Spec("r", "ridge", {}), {"alpha": 0.01}, cols, POINT.features, "leaf_temp", *learn._stats(frame, "leaf_temp")).fit(frame)
    rows = frame.orderBy("_time", "id_board").toPandas()
    n, rng, w = len(rows), random.Random(learn.SEED), model.stages[-1]
    scaler = model.stages[1]
    low, span = scaler.originalMin.toArray(), scaler.originalMax.toArray() - scaler.originalMin.toArray()
    r2 = lambda x: 1 - ((rows["leaf_temp"] - ((x - low) / span @ w.coefficients.toArray() + w.intercept)) ** 2).sum() / (n * rows["leaf_temp"].var(ddof=0))
    want = {}
    for k, c in enumerate(cols):
        drops = []
        for _ in range(2):
            a = next(x for x in iter(lambda: rng.randrange(1, n + 1), None) if math.gcd(x, n) == 1)
            b = rng.randrange(n)
            x = rows[cols].to_numpy()
            to = (a * np.arange(1, n + 1) + b) % n
            moved = x[:, k].copy()
            moved[to] = x[:, k]
            shuffled = x.copy()
            shuffled[:, k] = moved
            drops.append(r2(x) - r2(shuffled))
        want[c] = sum(drops) / 2
    got = learn.permutation_importance(model, frame, cols, "leaf_temp", repeats=2)
    assert got == pytest.approx(want, abs=1e-9) and next(iter(got)) == "air_temp"
    assert learn.permutation_importance(model, frame.limit(0), cols, "leaf_temp") == dict.fromkeys(cols, 0.0)


def test_season_equals_least_squares(wide):
    models, errors = season.season_fit(wide, 6, fields=["air_temp"])
    m = models.first()
    pdf = season.panel(wide, 6, fields=["air_temp"]).toPandas()
    t = (pdf["_time"] - pd.Timestamp("1970-01-01")).dt.total_seconds().to_numpy()
    minute = (t / 60) % 1440
    x = np.column_stack([np.ones(len(t)), (t - t.min()) / (t.max() - t.min())] + [f(2 * np.pi * k * minute / 1440) for k in range(1, 5) for f in (np.sin, np.cos)])
    want = x @ np.linalg.lstsq(x, pdf["y"].to_numpy(), rcond=None)[0]
    assert np.allclose(x @ np.array(m.coef), want, atol=1e-6)
    assert errors.first()["MAE"] < 0.5  # far below the daily swing of 10


def pandas_forecast(past, env, predict, cols, task, freq, lags):
    """The recursion as data-frame steps: append, build, fill, predict."""
    hist = past.set_index("_time")[[*task.features, "leaf_temp"]]
    out = []
    for _, e in env.iterrows():
        t = past["_time"].iloc[-1] + pd.Timedelta(minutes=freq * int(e["step"]))
        row = pd.DataFrame([[*(e[f] for f in task.features), 0.0]], columns=hist.columns, index=[t])
        d = pd.concat([hist, row])
        age = d.index.to_series().diff().dt.total_seconds() / 60
        minute = d.index.hour * 60 + d.index.minute
        d["time_sin"], d["time_cos"] = np.sin(2 * np.pi * minute / 1440), np.cos(2 * np.pi * minute / 1440)
        for f in task.features:
            d[f"{f}_diff"] = d[f].ffill().diff().where(~(age > freq * 1.5))
        d = d.ffill().bfill()
        new = {}
        for c in [*task.features, *[f"{f}_diff" for f in task.features], "leaf_temp"]:
            for i in range(1, lags + 1):
                far = (d.index.to_series() - d.index.to_series().shift(i)).dt.total_seconds() / 60
                new[f"{c}_lag_{i}"] = d[c].shift(i).where(far <= freq * i * 1.5)
        d = pd.concat([d, pd.DataFrame(new, index=d.index)], axis=1).ffill().bfill().fillna(0)
        y = predict(d[cols].iloc[-1].to_numpy(float))
        out.append(round(y, 3))
        row["leaf_temp"] = y
        hist = pd.concat([hist, row]).tail(lags + 2)
    return out


@pytest.mark.parametrize("holes", [False, True])
def test_recursive_forecast_equals_loop(spark, wide, holes):
    rng = np.random.default_rng(3)
    cols = features.model_columns(TASK, 6)
    train = features.training_frame(wide, sl.fit(wide, ["id_board"]), TASK, 6)
    model = learn.estimator(learn.Spec("r", "ridge", {}), {"alpha": 1.0}, cols, TASK.features, "leaf_temp", *learn._stats(train, "leaf_temp")).fit(train)
    scaler, linear = model.stages[-2:]
    low, span = scaler.originalMin.toArray(), scaler.originalMax.toArray() - scaler.originalMin.toArray()
    predict = lambda x: float(linear.coefficients.toArray() @ ((x - low) / span) + linear.intercept)
    pasts, envs, want = [], [], {}
    for board in ("b0", "b1"):
        minutes = [6 * i for i in range(12) if not (holes and i in (7, 8))]
        past = pd.DataFrame({"id_board": board, "_time": [T0 + timedelta(minutes=m) for m in minutes], "air_temp": rng.normal(20, 2, len(minutes)),
                             "humidity": rng.normal(60, 2, len(minutes)), "leaf_temp": rng.normal(18, 2, len(minutes))})
        if holes:
            past.loc[[0, 4], "air_temp"] = None
            past.loc[[5], "leaf_temp"] = None
        steps = TASK.steps(6) if board == "b0" else 4  # a board with a short environment forecast
        env = pd.DataFrame({"id_board": board, "step": range(1, steps + 1), "air_temp": rng.normal(20, 2, steps), "humidity": rng.normal(60, 2, steps)})
        want |= {(board, i + 1): v for i, v in enumerate(pandas_forecast(past, env, predict, cols, TASK, 6, 3))}
        pasts += [(r[0], r[1].to_pydatetime(), *(None if v != v else float(v) for v in r[2:])) for r in past.itertuples(index=False)]
        envs += [(r.id_board, int(r.step), float(r.air_temp), float(r.humidity)) for r in env.itertuples()]
    a = spark.createDataFrame(pasts, "id_board string, _time timestamp, air_temp double, humidity double, leaf_temp double")
    b = spark.createDataFrame(envs, "id_board string, step int, air_temp double, humidity double")
    rows = recursion.recursive_forecast(a, b, model, cols, TASK, 6).collect()
    got = {(r.id_board, r.step): r.value for r in rows}
    assert len(rows) == len(want) and got == pytest.approx(want, abs=2e-3)
    assert all(r._time == T0 + timedelta(minutes=66 + 6 * r.step) for r in rows)
    with pytest.raises(ValueError):
        recursion.recursive_forecast(a, b, model, [*cols, "unheard_of"], TASK, 6)


def test_blend_weights():
    assert forecast.blend_weights(None, 0.1) == (0.5, 0.5)
    env, auto = forecast.blend_weights(1.0, 3.0)
    assert env == pytest.approx(0.75, abs=1e-5) and env + auto == pytest.approx(1.0)


def test_soft_task():
    assert [C.soft_task(x) for x in ("t2", "A", "t8", "B", "C")] == ["t1", "t1", "t4", "t4", "t4"]
