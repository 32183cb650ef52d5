"""Models of the leaf temperature with Spark ML: pipelines, grid search over time folds, importances, registry."""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import slicing as sl
from canopyflow.operators.aggregates import regression_metrics
from canopyflow.operators.sequence import ts_folds
from canopyflow.plans import ridge
from canopyflow.plans.features import without_diffs
from canopyflow.session import materialise
from canopyflow.sources.documents import METRICS, REPORT

SEED = 42

# fixed values: parameter grids by model family
RIDGE = {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]}
RIDGE_FAST = {"alpha": [0.1, 1.0, 10.0]}
FOREST = {"n_estimators": [100, 300], "max_depth": [10, 20, None], "min_samples_split": [2, 5, 10], "max_features": ["sqrt", 1.0]}
BOOSTED = {"n_estimators": [100, 300], "learning_rate": [0.01, 0.05, 0.1], "num_leaves": [31, 63], "subsample": [0.8, 1.0]}
BOOSTED_FAST = {"n_estimators": [100, 300], "learning_rate": [0.05, 0.1], "num_leaves": [31]}
DEPTH_LIMIT = 30


@dataclass(frozen=True)
class Spec:
    """A model of the grid."""

    name: str
    family: str
    grid: dict
    drop_diff: bool = False
    poly: bool = False

    def candidates(self) -> list[dict]:
        return [dict(zip(self.grid, v)) for v in itertools.product(*self.grid.values())]


def model_grid(freq_min: int) -> list[Spec]:
    """The candidates of a frequency: a short list below six minutes."""
    fast = freq_min < C.FREQ_MIN
    base = [Spec("Ridge_linear", "ridge", RIDGE_FAST if fast else RIDGE)]
    if not fast:
        base += [Spec("Ridge_poly", "ridge", RIDGE, poly=True), Spec("RandomForest", "forest", FOREST)]
    base.append(Spec("Boosted", "boosted", BOOSTED_FAST if fast else BOOSTED))
    return [v for s in base for v in (s, Spec(f"{s.name}_no_diff", s.family, s.grid, True, s.poly))]


def folds_for(freq_min: int) -> int:
    return 2 if freq_min < C.FREQ_MIN else 3


def _own(spec: Spec, cols: Sequence[str]) -> list[str]:
    return without_diffs(list(cols)) if spec.drop_diff else list(cols)


def estimator(spec: Spec, params: dict, cols: Sequence[str], base: Sequence[str], target: str, n: int, spread: float) -> Pipeline:
    """Pipeline of a candidate. ``n`` and ``spread`` (rows, deviation of the target) turn a ridge penalty on the
    squared-error sum into the solver's penalty on the scaled mean."""
    cols = _own(spec, cols)
    stages = []
    if spec.poly:
        own = [c for c in cols if c in base]
        stages += [VectorAssembler(inputCols=own, outputCol="_base"),
                   PolynomialExpansion(degree=3, inputCol="_base", outputCol="_poly"),
                   VectorAssembler(inputCols=["_poly", *[c for c in cols if c not in base]], outputCol="_raw")]
    else:
        stages.append(VectorAssembler(inputCols=cols, outputCol="_raw"))
    features = "_raw"
    if spec.family != "forest":
        stages.append(MinMaxScaler(inputCol="_raw", outputCol="_scaled"))
        features = "_scaled"
    common = {"featuresCol": features, "labelCol": target, "predictionCol": "prediction"}
    if spec.family == "ridge":
        stages.append(LinearRegression(elasticNetParam=0.0, standardization=False, solver="normal",
                                       regParam=params["alpha"] / n * spread, **common))
    elif spec.family == "forest":
        stages.append(RandomForestRegressor(
            numTrees=params["n_estimators"], maxDepth=min(params["max_depth"] or DEPTH_LIMIT, DEPTH_LIMIT), seed=SEED,
            minInstancesPerNode=max(1, params["min_samples_split"] // 2),
            featureSubsetStrategy="sqrt" if params["max_features"] == "sqrt" else "all", **common))
    else:
        stages.append(GBTRegressor(maxIter=params["n_estimators"], stepSize=params["learning_rate"], seed=SEED,
                                   maxDepth=5 if params["num_leaves"] <= 31 else 6, subsamplingRate=params.get("subsample", 1.0), **common))
    return Pipeline(stages=stages)


def _stats(df: DataFrame, target: str) -> tuple[int, float]:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
    return r["n"], r["s"] or 1.0


@dataclass
class Fitted:
    """A refitted winner of one grid and its report row."""

    spec: Spec
    model: PipelineModel
    params: dict
    cols: list[str]
    metrics: dict
    timings: dict
    importance: dict = field(default_factory=dict)

    def report(self, task: str) -> tuple:
        rounded = [round(self.metrics[m], 3) for m in METRICS]
        return (task, self.spec.name, {k: str(v) for k, v in self.params.items()}, *rounded,
                *[round(v, 4) for v in self.timings.values()], self.importance)


def grid_search(train: DataFrame, test: DataFrame, specs: Sequence[Spec], cols: Sequence[str], base: Sequence[str], target: str,
                folds: int, threads: int = 8) -> list[Fitted]:
    """Best parameters of each spec by mean MAE over expanding time folds, refitted on all training rows.

    The errors of all ridge candidates come from one set of normal equations. For the others folds are marked once on a stored frame, and
    candidates of all specs share a thread pool, so the cluster always has work.
    """
    ridges = {s.name: s for s in specs if s.family == "ridge"}
    terms = {n: ridge.cubic(_own(s, cols), base) if s.poly else ridge.linear(_own(s, cols)) for n, s in ridges.items()}
    solved = ridge.grid(train, terms, {n: [p["alpha"] for p in s.candidates()] for n, s in ridges.items()}, target, folds) if ridges else []
    known = {(s.variant, s.penalty, s.fold): s.mae for s in solved}
    if ridges and {k for *_, k in known} != set(range(folds)):
        raise ValueError(f"too few rows for {folds} time folds")
    parts, sizes = [], []
    if len(ridges) < len(specs):
        marked = materialise(ts_folds(train, sl.fit(train, []), folds), "fold", "role")  # a fit reads its own fold and role only
        parts = [[marked.where((F.col("fold") == k) & (F.col("role") == r)) for r in ("train", "test")] for k in range(folds)]
        sizes = [_stats(a, target) for a, _ in parts]

    def error(job) -> float:
        spec, params, k = job
        if spec.family == "ridge":
            return known[spec.name, params["alpha"], k]
        a, b = parts[k]
        model = estimator(spec, params, cols, base, target, *sizes[k]).fit(a)
        return regression_metrics(model.transform(b), target, "prediction").first()["MAE"]

    jobs = [(s, p, k) for s in specs for p in s.candidates() for k in range(folds)]
    with ThreadPoolExecutor(threads) as pool:
        errors = list(pool.map(error, jobs))
    n, spread = _stats(train, target)
    out = []
    for s in specs:
        mean = {i: sum(e for (js, jp, _), e in zip(jobs, errors) if js is s and jp == p) / folds for i, p in enumerate(s.candidates())}
        params = s.candidates()[min(mean, key=lambda i: (mean[i], i))]
        t0 = time.time()
        model = estimator(s, params, cols, base, target, n, spread).fit(train)
        t1 = time.time()
        metrics = _evaluate(model, test, target, "")
        t2 = time.time()
        metrics |= _evaluate(model, train, target, "train_")
        own = _own(s, cols)
        fitted = Fitted(s, model, params, own, metrics, {"training_time_seconds": t1 - t0, "inference_time_seconds": t2 - t1})
        fitted.importance = importances(model, own, base if s.poly else []) or permutation_importance(model, test, own, target)
        out.append(fitted)
    return out


def _evaluate(model: PipelineModel, df: DataFrame, target: str, prefix: str) -> dict:
    r = regression_metrics(model.transform(df), target, "prediction").first()
    return {f"{prefix}{m}": float(r[m]) if r[m] is not None else 0.0 for m in ("MAE", "RMSE", "R_squared")}


def poly_names(base: Sequence[str]) -> list[str]:
    """Names of the cubic terms in the order PolynomialExpansion emits them."""
    def expand(i: int, degree: int) -> list[tuple[int, ...]]:
        if i < 0 or degree == 0:
            return [()]
        return [t + (i,) * k for k in range(degree + 1) for t in expand(i - 1, degree - k)]
    terms = expand(len(base) - 1, 3)[1:]
    return ["poly__" + " ".join(f"{base[i]}^{t.count(i)}" if t.count(i) > 1 else base[i] for i in sorted(set(t))) for t in terms]


def importances(model: PipelineModel, cols: Sequence[str], base: Sequence[str]) -> dict[str, float]:
    """Tree importances or coefficients, strongest first; none for a model that has neither."""
    names = [*poly_names([c for c in cols if c in base]), *[f"remainder__{c}" for c in cols if c not in base]] if base else list(cols)
    last = model.stages[-1]
    if not hasattr(last, "coefficients") and not hasattr(last, "featureImportances"):
        return {}
    values = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    return dict(sorted(zip(names, map(float, values)), key=lambda kv: -abs(kv[1])))


def permutation_importance(model: PipelineModel, df: DataFrame, cols: Sequence[str], target: str, order: Sequence[str] = ("_time", "id_board"),
                           repeats: int = 5, seed: int = SEED) -> dict[str, float]:
    """Mean fall of R2 when a column is shuffled, for models without own importances; strongest first.

    Rows are numbered once; a shuffle is a bijection of the numbers, i -> (a * i + b) mod n with a and n coprime. The values of all columns
    and repeats travel to the numbers they move to in one exchange; each row then stands once for each of them, with one value
    replaced, and all are scored in one pass.
    """
    numbered = materialise(sl.ranked(df.select(*order, *cols, target), sl.fit(df, []), order, "_i"))
    n = numbered.count()
    if not n:
        return dict.fromkeys(cols, 0.0)
    rng = random.Random(seed)
    shuffles = [(next(x for x in iter(lambda: rng.randrange(1, n + 1), None) if math.gcd(x, n) == 1), rng.randrange(n)) for _ in cols for _ in range(repeats)]
    base = regression_metrics(model.transform(numbered), target, "prediction").first()["R_squared"] or 0.0

    def moved(a: int, b: int) -> Column:
        # decimal arithmetic: a * i exceeds 64 bits for large n
        return ((F.col("_i").cast("decimal(19,0)") * F.lit(a).cast("decimal(19,0)") + b) % n + 1).cast("long")

    sent = [F.struct(moved(a, b).alias("_i"), F.lit(v).alias("_v"), F.col(cols[v // repeats]).cast("double").alias("_x")) for v, (a, b) in enumerate(shuffles)]
    got = numbered.select(F.inline(F.array(*sent))).groupBy("_i").agg(F.collect_list(F.struct("_v", "_x")).alias("_got"))
    rows = numbered.join(got, "_i").select(*numbered.columns, F.inline("_got").alias("_v", "_x"))
    rows = rows.withColumns({c: F.when(F.floor(F.col("_v") / repeats) == i, F.col("_x")).otherwise(F.col(c)) for i, c in enumerate(cols)})
    scores = regression_metrics(model.transform(rows), target, "prediction", ["_v"]).select("_v", "R_squared").collect()  # a row per column and repeat
    drops = {r["_v"]: base - (r["R_squared"] or 0.0) for r in scores}
    out = {c: sum(drops[i * repeats + k] for k in range(repeats)) / repeats for i, c in enumerate(cols)}
    return dict(sorted(out.items(), key=lambda kv: -kv[1]))


def report_frame(spark, task: str, fitted: Sequence[Fitted]) -> DataFrame:
    flat = ", ".join(["task string", "model_name string", "best_params map<string,string>", *[f"{m} double" for m in METRICS],
                      *[f"{f.name} double" for f in REPORT["performance"].dataType], "feature_importance map<string,double>"])
    return spark.createDataFrame([f.report(task) for f in fitted], flat)


def winner(fitted: Sequence[Fitted]) -> Fitted:
    """Least test MAE, unrounded; the first of equals."""
    return min(fitted, key=lambda f: f.metrics["MAE"])
