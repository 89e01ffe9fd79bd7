"""Measures combined: features from component scores, linear models, merged lists, factor and topic models."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import maths as M
from relata.operators.calibrate import percentile_knots, percentiles
from relata.operators.evaluate import METRICS, wide_scores
from relata.operators.matrix import neighbour_matrix
from relata.operators.normalize import SIMS_SQL, labelled_sims
from relata.operators.postings import K, SEARCH_STEP, top_k
from relata.session import reliable, table

#: Judged pairs that a model is fitted on at most.
MAX_EXAMPLES = 100_000
FOLDS = 7
EPSILONS = [1.05, 1.2, 1.35, 1.6, 2.0]
PENALTIES = [0.0, 0.0001, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3]
#: More than any vocabulary holds: no term is left out.
ALL_TERMS = 2**31 - 1
#: Terms, or columns, that describe a topic.
TOPIC_TERMS = 100
LISTS = ["category", "esa", "links", "pairwise", "text"]
LIST_SIZE = 500
MIN_COMPONENTS = 1


# --- features ---------------------------------------------------------------------------------------------------
def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Absent scores replaced by the column's mean over all rows, 0 where a column has none."""
    means = df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in columns])
    joined = df.join(F.broadcast(means))
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"mean_{c}")) for c in columns}).drop(*[f"mean_{c}" for c in columns])


#: Features of a component: of a pair from both directions, and of an id in a list.
PAIR_FEATURES = ("rangemean", "rangemax", "percentmean", "percentmax")
LIST_FEATURES = ("range", "percent", "rank")
#: The percentile of what isn't in a list.
ABSENT_PERCENTILE = -0.2


@dataclass
class FeatureModel:
    """What features are made with: bounds (metric, low, high, missing) and percentile knots (metric, x, y)."""

    bounds: DataFrame
    knots: DataFrame


def fit_features(observed: DataFrame) -> FeatureModel:
    """From observed (metric, key, x, y): scores, NULL where absent, and labels. missing is the mean label of absent scores."""
    ok = M.finite(F.col("x"))
    bounds = observed.groupBy("metric").agg(
        F.min(F.when(ok, F.col("x"))).alias("low"), F.max(F.when(ok, F.col("x"))).alias("high"), F.coalesce(F.avg(F.when(~ok, F.col("y"))), F.lit(0.0)).alias("missing")
    )
    return FeatureModel(bounds, percentile_knots(observed))


def _scaled(x: Column) -> Column:
    return F.when(F.col("high") > F.col("low"), -1 + 2 * (x - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))


def both_directions(scores: DataFrame, pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """(id1, id2, metric, s1, s2): for each pair and metric the scores (metric, id1, id2, x) of both directions, NULL where absent."""
    grid = pairs.select("id1", "id2", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    usable = scores.where(M.finite(F.col("x")))
    ahead = usable.select("metric", "id1", "id2", F.col("x").alias("s1"))
    back = usable.select("metric", F.col("id2").alias("id1"), F.col("id1").alias("id2"), F.col("x").alias("s2"))
    keys = ["metric", "id1", "id2"]
    return grid.join(ahead, keys, "left").join(back, keys, "left").select("id1", "id2", "metric", "s1", "s2")


def observed_pairs(long: DataFrame, labels: DataFrame) -> DataFrame:
    """(metric, key, x, y) of both directions of the labelled pairs (id1, id2, y)."""
    judged = long.join(labels.where("y is not null").select("id1", "id2", "y"), ["id1", "id2"])
    one = judged.select("metric", F.concat_ws("-", "id1", "id2").alias("key"), F.col("s1").alias("x"), "y")
    return one.unionByName(judged.select("metric", F.concat_ws("-", "id2", "id1", F.lit("r")).alias("key"), F.col("s2").alias("x"), "y"))


def pair_features(long: DataFrame, model: FeatureModel) -> DataFrame:
    """(id1, id2, metric, *PAIR_FEATURES) of :func:`both_directions`: mean and greatest of the two directions, scaled to
    -1..1 by range and by percentile. An absent direction has the metric's missing score."""
    joined = long.join(F.broadcast(model.bounds), "metric")  # one row a metric
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.col("missing")) for c in ("s1", "s2")})
    rated = percentiles(percentiles(filled, model.knots, "p1", "s1"), model.knots, "p2", "s2")
    r1, r2, p1, p2 = _scaled(F.col("s1")), _scaled(F.col("s2")), F.col("p1"), F.col("p2")
    values = ((r1 + r2) / 2, F.greatest(r1, r2), M.percentile_score((p1 + p2) / 2), M.percentile_score(F.greatest(p1, p2)))
    return rated.select("id1", "id2", "metric", *[F.coalesce(v, F.lit(0.0)).alias(n) for n, v in zip(PAIR_FEATURES, values)])


def in_lists(lists: DataFrame, metrics: list[str]) -> DataFrame:
    """(query_id, id, metric, score, rank): each id of any list of a query for each metric, NULL where its list lacks it."""
    grid = lists.select("query_id", "id").distinct().select("query_id", "id", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    return grid.join(lists.select("query_id", "id", "metric", "score", "rank"), ["query_id", "id", "metric"], "left")


def list_features(long: DataFrame, model: FeatureModel, size: int = LIST_SIZE) -> DataFrame:
    """(query_id, id, metric, *LIST_FEATURES) of :func:`in_lists`: score by range and percentile, and the logarithm of the
    rank from 1. What a list lacks has the metric's missing score, the percentile ABSENT_PERCENTILE and twice the rank
    of the list's end."""
    joined = long.join(F.broadcast(model.bounds), "metric")
    rated = percentiles(joined, model.knots, "p", "score")
    p = F.when(F.col("score").isNull(), ABSENT_PERCENTILE).otherwise(F.coalesce("p", F.lit(0.5)))
    rank = F.coalesce(F.col("rank") - 1, F.lit(2 * size)).cast("double")
    values = (_scaled(F.coalesce("score", "missing")), M.percentile_score(p), M.rank_score(rank, 2 * size))
    return rated.select("query_id", "id", "metric", *[F.coalesce(v, F.lit(0.0)).alias(n) for n, v in zip(LIST_FEATURES, values)])


def wide_features(features: DataFrame, keys: list[str], metrics: list[str], names: tuple[str, ...]) -> DataFrame:
    """(*keys, metric_name ...): a column for each metric and feature."""
    # The names of the columns follow the metrics given, so no pass is needed to find them.
    return features.groupBy(*keys).pivot("metric", metrics).agg(*[F.first(n).alias(n) for n in names])


def feature_columns(metrics: list[str], names: tuple[str, ...]) -> list[str]:
    return [f"{m}_{n}" for m in metrics for n in names]


# --- linear models ------------------------------------------------------------------------------------------------
def colinear_groups(x: np.ndarray, tolerance: float = 1e-6) -> list[list[int]]:
    """Columns that are multiples of one another; a column of zeros joins any other. The factor comes from row 0."""
    groups: list[list[int]] = []
    for j in range(x.shape[1]):
        for g in groups:
            i = g[0]
            with np.errstate(divide="ignore", invalid="ignore"):
                k = x[0, i] / x[0, j]
                apart = np.abs(x[:, i] - k * x[:, j]) > tolerance
            if not np.isfinite(k) or not apart.any():
                g.append(j)
                break
        else:
            groups.append([j])
    return groups


def distributed_colinear_groups(df: DataFrame, columns: list[str], order: list[str], tolerance: float = 1e-6) -> list[list[int]]:
    """The same for the columns of a table, row 0 being the first by ``order``: the greatest distance of each two columns
    from being multiples is found in one pass."""
    first = df.orderBy(*order).select(*columns).first()
    if first is None:
        return [[i] for i in range(len(columns))]
    factor = {}
    for j in range(len(columns)):
        for i in range(j):
            factor[i, j] = first[i] / first[j] if first[j] else None
    pairs = [(i, j) for (i, j), k in factor.items() if k is not None]
    apart = df.agg(F.count(F.lit(1)), *[F.max(F.abs(F.col(columns[i]) - F.lit(factor[i, j]) * F.col(columns[j]))) for i, j in pairs]).first()
    distance = {p: apart[n + 1] for n, p in enumerate(pairs)}
    groups: list[list[int]] = []
    for j in range(len(columns)):
        for g in groups:
            if distance.get((g[0], j), 0.0) <= tolerance:
                g.append(j)
                break
        else:
            groups.append([j])
    return groups


def fit_without_colinear(df: DataFrame, columns: list[str], label: str, order: list[str]) -> tuple[float, dict[str, float]]:
    """Least squares from moments; of colinear columns only the first has a coefficient, the others have 0."""
    keep = [columns[g[0]] for g in distributed_colinear_groups(df.where(F.col(label).isNotNull()), columns, order)]
    b0, b = fit_from_moments(df, keep, label)
    return b0, dict.fromkeys(columns, 0.0) | dict(zip(keep, map(float, b)))


def fit_linear(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and coefficients by least squares; of colinear columns only the first has one."""
    keep = [g[0] for g in colinear_groups(x)]
    a = np.column_stack([np.ones(len(y)), x[:, keep]])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    coefficients = np.zeros(x.shape[1])
    coefficients[keep] = b[1:]
    return float(b[0]), coefficients


def fit_from_moments(df: DataFrame, columns: list[str], label: str) -> tuple[float, np.ndarray]:
    """The same least squares from sums of products of one distributed pass; nothing but k * k sums reaches the driver."""
    names = [*columns, label]
    sums = df.where(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names],
        *[F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j],
    ).first()
    k = len(columns)
    if not sums["n"]:
        return 0.0, np.zeros(k)
    cov = np.array([[sums[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
    b = np.linalg.lstsq(cov[:k, :k], cov[:k, k], rcond=1e-10)[0]
    means = np.array([sums[f"m_{c}"] or 0.0 for c in names])
    return float(means[k] - means[:k] @ b), b


def predict(intercept: float, coefficients: dict[str, float]) -> Column:
    out = F.lit(float(intercept))
    for name, b in coefficients.items():
        out = out + F.lit(float(b)) * F.col(name)
    return out


@dataclass
class Linear:
    """A fitted ensemble: how features are made, and their weights by the name of the column."""

    features: FeatureModel
    intercept: float
    weights: dict[str, float]
    metrics: list[str]

    def on(self, features: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
        """(*keys, score) of the features (*keys, metric, *names)."""
        wide = wide_features(features, keys, self.metrics, names).na.fill(0.0, feature_columns(self.metrics, names))
        return wide.select(*keys, predict(self.intercept, self.weights).alias("score"))


def _fit(features: DataFrame, model: FeatureModel, labels: DataFrame, keys: list[str], metrics: list[str], names: tuple[str, ...]) -> Linear:
    columns = feature_columns(metrics, names)
    wide = reliable(wide_features(features, keys, metrics, names).join(labels, keys).na.fill(0.0, columns))
    b0, b = fit_without_colinear(wide, columns, "y", keys)
    return Linear(model, b0, b, metrics)


def fit_pairs(long: DataFrame, labels: DataFrame, metrics: list[str]) -> Linear:
    """The model of pairs, from :func:`both_directions` of the labelled pairs (id1, id2, y)."""
    model = _kept(fit_features(observed_pairs(long, labels)))
    return _fit(pair_features(long, model), model, labels, ["id1", "id2"], metrics, PAIR_FEATURES)


def fit_lists(lists: DataFrame, labels: DataFrame, metrics: list[str], size: int) -> Linear:
    """The model of lists (query_id, id, metric, score, rank), from the judged ids in them and those they lack."""
    judged = labels.select(F.col("id1").alias("query_id"), F.col("id2").alias("id"), "y")
    grid = judged.select("query_id", "id", "y", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    long = reliable(grid.join(lists, ["query_id", "id", "metric"], "left"))
    model = _kept(fit_features(long.select("metric", F.concat_ws("-", "query_id", "id").alias("key"), F.col("score").alias("x"), "y")))
    return _fit(list_features(long.drop("y"), model, size), model, judged, ["query_id", "id"], metrics, LIST_FEATURES)


def _kept(model: FeatureModel) -> FeatureModel:
    return FeatureModel(reliable(model.bounds), reliable(model.knots))


def write_models(path: str, models: dict[str, Linear | None], names: dict[str, str]) -> None:
    """Models as JSON, with the parts' names in place of their columns; all digits are kept."""
    out = {}
    for kind, m in models.items():
        if m is not None:
            table_of = lambda df: [list(r) for r in df.collect()]  # noqa: E731, a few rows a metric, SAMPLE points at most
            bounds, knots = table_of(m.features.bounds.select("metric", "low", "high", "missing")), table_of(m.features.knots.select("metric", "x", "y"))
            out[kind] = {
                "intercept": m.intercept,
                "parts": [
                    {
                        "name": names[c], "bounds": next((b[1:] for b in bounds if b[0] == c), None), "knots": [k[1:] for k in knots if k[0] == c],
                        "weights": {w.removeprefix(f"{c}_"): v for w, v in m.weights.items() if w.startswith(f"{c}_")},
                    }
                    for c in m.metrics
                ],
            }
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=1)


def read_models(path: str, spark, columns: dict[str, str], prune: bool) -> dict[str, Linear | None]:
    """The models of :func:`write_models` for the parts of ``columns`` (name: column); see :meth:`EnsembleMeasure.load`."""
    found: dict[str, Linear | None] = {"pairs": None, "lists": None}
    for kind, m in read_model(path).items():
        if missing := [p["name"] for p in m["parts"] if p["name"] not in columns]:
            if not prune:
                raise ValueError(f"the model has other parts: {', '.join(missing)}")
        parts = {columns[p["name"]]: p for p in m["parts"] if p["name"] in columns}
        bounds = [(c, *map(_number, p["bounds"])) for c, p in parts.items() if p["bounds"]]
        knots = [(c, float(x), float(y)) for c, p in parts.items() for x, y in p["knots"]]
        features = FeatureModel(
            spark.createDataFrame(bounds, "metric string, low double, high double, missing double"), spark.createDataFrame(knots, "metric string, x double, y double")
        )
        weights = {f"{c}_{w}": v for c, p in parts.items() for w, v in p["weights"].items()}
        found[kind] = Linear(features, m["intercept"], weights, list(parts))
    return found


def _number(x) -> float | None:
    return None if x is None else float(x)


def write_equation(intercept: float, coefficients: dict[str, float]) -> str:
    """Terms in ascending order of their coefficient, with all digits."""
    terms = sorted(coefficients.items(), key=lambda t: t[1])
    return " + ".join([repr(float(intercept)), *[f"{float(b)!r}*{name}" for name, b in terms]])


def read_equation(text: str) -> tuple[float, dict[str, float]]:
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    first, *rest = re.split(r"\s\+\s", text.strip())
    out = {}
    for term in rest:
        m = re.fullmatch(rf"({number})\*(\S+)", term)
        if not m:
            raise ValueError(f"no term of an equation: {term}")
        out[m[2]] = float(m[1])
    return float(first), out


def write_model(path: str, intercept: float, coefficients: dict[str, float], **more) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"intercept": intercept, "coefficients": coefficients, **more}, f, indent=1)


def read_model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


# --- queries --------------------------------------------------------------------------------------------------------
def _wide(spark, d):
    return imputed(wide_scores(labelled_sims(spark, d), METRICS).where("y is not null"), METRICS)


def fitting_sample(df: DataFrame, most: int, folds: int) -> DataFrame:
    """``most`` rows at most of (id1, id2, ...), the same ones each time, dealt evenly into folds (fold)."""
    order = [F.xxhash64("id1", "id2"), F.col("id1"), F.col("id2")]
    few = df.orderBy(*order).limit(most)
    return few.withColumn("fold", (F.row_number().over(Window.orderBy(*order)) - 1) % folds)


def _pair_examples(spark, d, least: int = 3):
    """(features of all pairs with ``least`` scores at least, labels (id1, id2, y)), the model fitted on the judged ones."""
    scores = reliable(labelled_sims(spark, d).select("metric", "id1", "id2", "x", "y"))
    known = scores.where(M.finite(F.col("x"))).groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    labels = scores.where("y is not null").groupBy("id1", "id2").agg(F.max("y").alias("y"))
    long = reliable(both_directions(scores, known, METRICS))
    return pair_features(long, fit_features(observed_pairs(long, labels))), labels


def q_ensemble_features(spark, d):
    """Four features of each component for every pair with three scores at least."""
    features = _pair_examples(spark, d)[0]
    return features.select("id1", "id2", "metric", *[F.round(n, 5).alias(n) for n in PAIR_FEATURES])


def _best_lists(spark, d, asked: Column):
    lists = table(spark, d, "neighbours").where(M.finite(F.col("score")) & asked & F.col("query_id").isNotNull() & F.col("id").isNotNull())
    best = lists.groupBy("query_id", "metric", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "metric").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= LIST_SIZE)


def _list_examples(spark, d, asked: Column):
    """Features of all ids of the asked lists; bounds and percentiles are of all lists, missing of the judged pairs."""
    every = reliable(_best_lists(spark, d, F.lit(True)))
    labels = table(spark, d, "gold").where("id1 is not null and id2 is not null and similarity is not null").groupBy(F.col("id1").alias("query_id"), F.col("id2").alias("id")).agg(F.avg("similarity").alias("y"))
    absent = labels.select("query_id", "id", "y", F.explode(F.array(*[F.lit(m) for m in LISTS])).alias("metric")).join(every, ["query_id", "id", "metric"], "left_anti")
    key = F.concat_ws("-", "query_id", "id").alias("key")
    seen = every.select("metric", key, F.col("score").alias("x"), F.lit(None).cast("double").alias("y"))
    model = fit_features(seen.unionByName(absent.select("metric", key, F.lit(None).cast("double").alias("x"), "y")))
    return list_features(in_lists(every.where(asked), LISTS), model)


def q_list_features(spark, d):
    """Three features of each component for every id that some list of a query holds."""
    return _list_examples(spark, d, F.lit(True)).select("query_id", "id", "metric", *[F.round(n, 5).alias(n) for n in LIST_FEATURES])


def q_ols_two(spark, d):
    """Predictions of the least squares of the label on two measures, from the moments of one pass."""
    wide = wide_scores(labelled_sims(spark, d), METRICS).where("y is not null and google is not null and esa is not null")
    b0, b = fit_from_moments(wide, ["google", "esa"], "y")
    return wide.select("id1", "id2", F.round(predict(b0, dict(zip(["google", "esa"], b))), 5).alias("predicted"))


def _wide_examples(spark, d):
    features, labels = _pair_examples(spark, d)
    wide = wide_features(features, ["id1", "id2"], METRICS, PAIR_FEATURES)
    return reliable(wide.join(labels, ["id1", "id2"]).na.fill(0.0, feature_columns(METRICS, PAIR_FEATURES)))


def q_ols_ensemble(spark, d):
    """The linear ensemble of pairs: least squares of the label on all features, colinear ones left out."""
    wide, columns = _wide_examples(spark, d), feature_columns(METRICS, PAIR_FEATURES)
    b0, b = fit_without_colinear(wide, columns, "y", ["id1", "id2"])
    return wide.select("id1", "id2", "y", F.round(predict(b0, b), 6).alias("predicted"))


def q_huber_ensemble(spark, d):
    """Support vector regression has no counterpart in the library; a robust loss with cross-validation stands in.

    Fitted on MAX_EXAMPLES judged pairs at most; all pairs are predicted. The robust loss knows no elastic net, so the
    grid is over its own epsilon and the squared penalty.
    """
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    # Short plans, as each of the many fits plans its input again.
    everything = reliable(VectorAssembler(inputCols=METRICS, outputCol="features").transform(_wide(spark, d)))
    sample = reliable(fitting_sample(everything, MAX_EXAMPLES, FOLDS))
    lr = LinearRegression(labelCol="y", loss="huber", maxIter=20)
    grid = ParamGridBuilder().addGrid(lr.epsilon, EPSILONS).addGrid(lr.regParam, PENALTIES).build()
    search = CrossValidator(
        estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y", metricName="mse"),
        numFolds=max(2, min(FOLDS, sample.count())), foldCol="fold", parallelism=4,
    )
    return search.fit(sample).transform(everything).select("id1", "id2", "y", F.round("prediction", 4).alias("predicted"))


def q_ensemble_merge(spark, d):
    """Lists of all metrics merged by id: the mean of all features, k best of each query.

    Ids that fewer lists hold than MIN_COMPONENTS are left out.
    """
    rated = _list_examples(spark, d, F.col("query_id") % SEARCH_STEP == 0)
    mean = sum((F.col(n) for n in LIST_FEATURES), F.lit(0.0)) / len(LIST_FEATURES)
    held = F.sum((F.col("rank") > M.rank_score(F.lit(2.0 * LIST_SIZE), 2 * LIST_SIZE)).cast("int"))
    merged = rated.groupBy("query_id", "id").agg(F.avg(mean).alias("s"), held.alias("n")).where(F.col("n") >= MIN_COMPONENTS)
    return top_k(merged.select("query_id", "id", F.round("s", 6).alias("score")), K)


def _als(spark, d, metric: str):
    from pyspark.ml.recommendation import ALS

    m = reliable(neighbour_matrix(spark, d, metric).select("row_id", "col_id", F.col("value").cast("float").alias("value")))
    return m, ALS(rank=8, maxIter=5, regParam=0.02, userCol="row_id", itemCol="col_id", ratingCol="value", seed=7, coldStartStrategy="drop").fit(m)


def q_als(spark, d):
    """Low-rank factors of each metric's neighbour matrix: one vector for each of its rows and each of its columns."""
    out = None
    for metric in LISTS:
        model = _als(spark, d, metric)[1]
        for side, f in (("row", model.userFactors), ("col", model.itemFactors)):
            part = f.select(F.lit(metric).alias("metric"), F.lit(side).alias("side"), "id", F.col("features").alias("factors"))
            out = part if out is None else out.unionByName(part)
    return out


def q_als_error(spark, d):
    """The error of the product of the factors, for each metric."""
    out = None
    for metric in LISTS:
        m, model = _als(spark, d, metric)
        error = model.transform(m).select(((F.col("prediction") - F.col("value")) ** 2).alias("e"))
        part = error.agg(F.count(F.lit(1)).alias("cells"), F.round(F.sqrt(F.avg("e")), 3).alias("rmse")).select(F.lit(metric).alias("metric"), "cells", "rmse")
        out = part if out is None else out.unionByName(part)
    return out


def _lda(spark, d):
    """(documents (doc_id, features), fitted terms, fitted topics), over all terms that pass minDF and maxDF.

    The model, of topics times terms, stands on the driver.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    from relata.functions import text as T

    docs = table(spark, d, "documents").select("doc_id", F.col("text").isNotNull().alias("has"), T.word_tokens(F.coalesce("text", F.lit(""))).alias("words"))
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=ALL_TERMS, minDF=5.0, maxDF=0.5)
    terms = counter.fit(docs.where("has"))
    counted = reliable(terms.transform(docs).drop("words"))
    return counted, terms, LDA(k=5, maxIter=5, optimizer="online", docConcentration=[0.1], topicConcentration=0.1, seed=7).fit(counted.where("has"))


def q_lda(spark, d):
    """(doc_id, topics): the share of each topic in each document, of sum 1; all 0 for documents without counted terms."""
    from pyspark.ml.functions import vector_to_array

    counted, _, model = _lda(spark, d)
    return model.transform(counted).select("doc_id", vector_to_array("topicDistribution").alias("topics"))


def q_lda_terms(spark, d):
    """The heaviest terms of each topic."""
    _, terms, model = _lda(spark, d)
    topics = model.describeTopics(TOPIC_TERMS).select("topic", F.posexplode("termIndices").alias("place", "at"))
    names = spark.createDataFrame(list(enumerate(terms.vocabulary)), "at int, term string")
    return topics.join(names, "at").select("topic", "place", "term")


def matrix_topics(m: DataFrame, topics: int = 20, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """((row_id, topics), (topic, place, col_id, weight)) of a sparse matrix (row_id, col_id, value >= 0): each row's shares of
    the topics, and the TOPIC_TERMS heaviest columns of each topic."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors, VectorUDT

    from relata.operators.matrix import dense_ids

    cells = reliable(m.where("value > 0").select("row_id", "col_id", F.col("value").cast("double").alias("value")))
    ids = reliable(dense_ids(cells, "col_id"))
    width = ids.count()
    if not width:
        raise ValueError("the matrix has no positive cells")
    vector = F.udf(lambda r: Vectors.sparse(width, sorted((int(c["dense_id"]), float(c["value"])) for c in r)), VectorUDT())
    rows = cells.join(ids, "col_id").groupBy("row_id").agg(F.collect_list(F.struct("dense_id", "value")).alias("cells"))
    rows = reliable(rows.select("row_id", vector("cells").alias("features")))
    model = LDA(k=topics, maxIter=rounds, optimizer="online", docConcentration=[0.1], topicConcentration=0.1, seed=7).fit(rows)
    shares = model.transform(rows).select("row_id", vector_to_array("topicDistribution").alias("topics"))
    heavy = model.describeTopics(TOPIC_TERMS).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t"))
    named = heavy.join(ids.select(F.col("dense_id").alias("at"), "col_id"), F.col("t.termIndices") == F.col("at"))
    return shares, named.select("topic", "place", "col_id", F.col("t.termWeights").alias("weight"))


QUERIES = {
    "ensemble_features": q_ensemble_features, "ensemble_list_features": q_list_features, "ols_two_measures": q_ols_two, "ols_linear_ensemble": q_ols_ensemble, "svr_analogue": q_huber_ensemble,
    "ensemble_merge_topk": q_ensemble_merge, "als_factorize": q_als, "als_error": q_als_error, "lda_topics": q_lda,
    "lda_terms": q_lda_terms,
}

_WIDE = f"""{SIMS_SQL}, w as (select id1, id2, max(y) as y, {', '.join(f"max(x) filter (metric = '{m}' and isfinite(x)) as {m}" for m in METRICS)} from s group by all)"""
#: Bounds and percentile knots of observed scores ``ob`` (metric, key, x, y).
_FEATURES_SQL = """bd as (select metric, min(x) filter (isfinite(x)) as low, max(x) filter (isfinite(x)) as high, coalesce(avg(y) filter (x is null or not isfinite(x)), 0) as missing from ob group by 1),
  sm as (select metric, x from (select *, row_number() over (partition by metric order by md5(key), key, x) as rn from ob where isfinite(x)) where rn <= 1000),
  pt as (select metric, x, avg(y) as y from (select metric, x, row_number() over (partition by metric order by x) / (count(*) over (partition by metric) + 1) as y from sm) group by all),
  sg as (select metric, x as x0, y as y0, lead(x) over v as x1, lead(y) over v as y1 from pt window v as (partition by metric order by x)),
  en as (select metric, min(x) as lo, max(x) as hi, arg_min(y, x) as ylo, arg_max(y, x) as yhi, case when max(x) > min(x) then (max(x) - min(x)) / 4 else 1 end as half from pt group by 1)"""


def _percentile_sql(rows: str, x: str, out: str) -> str:
    return f"""select t.*, case when {x} is null or not isfinite({x}) then null when {x} < lo then ylo + (1 - exp(-(lo - {x}) / half)) * (0 - ylo) when {x} > hi then yhi + (1 - exp(-({x} - hi) / half)) * (1 - yhi)
      when x1 is null then y0 else y0 + (y1 - y0) * ({x} - x0) / (x1 - x0) end as {out}
      from {rows} t left join en on en.metric = t.metric asof left join sg on t.metric = sg.metric and t.{x} >= sg.x0"""


def _scaled_sql(x: str) -> str:
    return f"case when high > low then -1 + 2 * ({x} - low) / (high - low) else 0 end"


_LISTS_SQL = f"""with bs as (select query_id, metric, id, max(score) as score from neighbours where isfinite(score) and query_id is not null and id is not null group by all),
  rk as (select * from (select *, row_number() over (partition by query_id, metric order by score desc, id) as rank from bs) where rank <= {LIST_SIZE}),
  lb as (select id1 as query_id, id2 as id, avg(similarity) as y from gold where id1 is not null and id2 is not null and similarity is not null group by all),
  ab as (select query_id, id, metric, y from (select *, unnest({LISTS}) as metric from lb) anti join rk using (query_id, id, metric)),
  ob as (select metric, query_id || '-' || id as key, score as x, null::double as y from rk union all select metric, query_id || '-' || id, null, y from ab), {_FEATURES_SQL},
  gr as (select query_id, id, unnest({LISTS}) as metric from (select distinct query_id, id from rk)),
  lg as (select gr.*, score, rank, low, high, missing from gr left join rk using (query_id, id, metric) join bd using (metric)), pc as ({_percentile_sql('lg', 'score', 'p')}),
  ft as (select query_id, id, metric, {_scaled_sql('coalesce(score, missing)')} as f1, (case when score is null then {ABSENT_PERCENTILE} else coalesce(p, 0.5) end - 0.5) * 2 as f2,
    ((ln({2 * LIST_SIZE + 2}) - ln(coalesce(rank - 1, {2 * LIST_SIZE}) + 1)) / ln({2 * LIST_SIZE + 2}) - 0.5) * 2 as f3 from pc)"""
SQL = {
    "ensemble_features": f"""{SIMS_SQL}, lb as (select id1, id2, max(y) as y from s where y is not null group by all), kp as (select id1, id2 from o group by all having count(*) >= 3),
      gr as (select id1, id2, unnest({METRICS}) as metric from kp), lg as (select gr.*, a.x as s1, b.x as s2 from gr left join o a using (id1, id2, metric) left join o b on b.id1 = gr.id2 and b.id2 = gr.id1 and b.metric = gr.metric),
      ob as (select metric, id1 || '-' || id2 as key, s1 as x, y from lg join lb using (id1, id2) union all select metric, id2 || '-' || id1 || '-r', s2, y from lg join lb using (id1, id2)),
      {_FEATURES_SQL}, fl as (select id1, id2, metric, low, high, coalesce(s1, missing) as s1, coalesce(s2, missing) as s2 from lg join bd using (metric)),
      p1 as ({_percentile_sql('fl', 's1', 'p1')}), p2 as ({_percentile_sql('p1', 's2', 'p2')}), r as (select *, {_scaled_sql('s1')} as r1, {_scaled_sql('s2')} as r2 from p2)
      select id1, id2, metric, round((r1 + r2) / 2, 5) as rangemean, round(greatest(r1, r2), 5) as rangemax, round(coalesce(((p1 + p2) / 2 - 0.5) * 2, 0), 5) as percentmean, round(coalesce((greatest(p1, p2) - 0.5) * 2, 0), 5) as percentmax from r""",
    "ensemble_list_features": f"""{_LISTS_SQL} select query_id, id, metric, round(f1, 5) as range, round(f2, 5) as percent, round(f3, 5) as rank from ft""",
    "ols_two_measures": f"""{_WIDE}, k as (select * from w where y is not null and google is not null and esa is not null),
      m as (select covar_pop(google, google) as gg, covar_pop(esa, esa) as ee, covar_pop(google, esa) as ge, covar_pop(google, y) as gy, covar_pop(esa, y) as ey, avg(google) as mg, avg(esa) as me, avg(y) as my from k),
      b as (select *, (gy * ee - ey * ge) / (gg * ee - ge * ge) as b1, (ey * gg - gy * ge) / (gg * ee - ge * ge) as b2 from m)
      select id1, id2, round(my - b1 * mg - b2 * me + b1 * google + b2 * esa, 5) as predicted from k, b""",
    "ensemble_merge_topk": f"""{_LISTS_SQL}, mg as (select query_id, id, round(avg((f1 + f2 + f3) / 3), 6) as score from ft where query_id % 50 = 0 group by all)
      select query_id, id, score, cast(rn as int) as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rn from mg) where rn <= 10""",
}
