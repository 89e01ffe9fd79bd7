"""Trainable maps from raw scores to calibrated ones: a model is a small table, its use a Column expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import maths as M
from relata.session import table

#: Points that a percentile or smoothing model holds at most for each metric.
SAMPLE = 1_000
EPSILON = 1e-10


# --- fitting: every model has one row a metric, with arrays of at most SAMPLE points ----------------------------
def observed(scores: DataFrame) -> DataFrame:
    """(metric, key, x[, y]) with finite x only."""
    return scores.where(M.finite(F.col("x")) & F.col("metric").isNotNull())


def ranges(scores: DataFrame) -> DataFrame:
    """(metric, low, high, n): true bounds of the finite scores."""
    return observed(scores).groupBy("metric").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))


def sampled(scores: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` scores of each metric, those with the least digest of their key: the same in every run.

    The rank filter prunes within each task before the shuffle.
    """
    w = Window.partitionBy("metric").orderBy(F.md5("key"), "key", "x")
    return observed(scores).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= size).drop("rn")


def missing_means(scores: DataFrame) -> DataFrame:
    """(metric, missing): mean label where the score is absent."""
    return scores.where("y is not null").groupBy("metric").agg(F.avg(F.when(~M.finite(F.col("x")), F.col("y"))).alias("missing"))


# --- using -----------------------------------------------------------------------------------------------------
def to_range(x: Column, low: Column, high: Column, new_low: float, new_high: float, truncate: bool = False) -> Column:
    """Linear onto [new_low, new_high]; NULL where all scores are equal or x is not finite."""
    y = F.when(M.finite(x) & (high > low), new_low + (new_high - new_low) * (x - low) / (high - low))
    return F.when(y.isNotNull(), F.least(F.greatest(y, F.lit(new_low)), F.lit(new_high))) if truncate else y


def from_range(y: Column, low: Column, high: Column, new_low: float, new_high: float) -> Column:
    return low + (y - new_low) * (high - low) / (new_high - new_low)


def log_scaled(x: Column, low: Column) -> Column:
    """0 below the constant or where the logarithm has no value, else ln(constant + x)."""
    return F.when((x < low) | (low + x <= 0), 0.0).otherwise(F.log(low + x))


def monotone(v: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    """Each value at least epsilon above the one before."""
    i = np.arange(len(v)) * epsilon
    return np.maximum.accumulate(np.asarray(v, float) - i) + i


def robust_mean(values: np.ndarray) -> float:
    v = np.sort(np.asarray(values, float))
    w = np.exp(-(((np.arange(len(v)) - len(v) // 2) / max(3, len(v) // 4)) ** 2) / 2)
    return float((v * w).sum() / w.sum())


def smoothed(x: np.ndarray, y: np.ndarray, points: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """About ``points`` places of sorted x, with the robust mean of the y around each; equal x share their mean."""
    order = np.lexsort((y, x))
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    width = min(20, len(x) // 10)
    at = np.arange(width // 2, max(width // 2 + 1, len(x) - width // 2), max(1, len(x) // (points + 1)))
    sx, sy = x[at], np.asarray([robust_mean(y[max(0, i - width // 2) : max(i + 1, min(len(y), i + width))]) for i in at])
    unique, inverse, counts = np.unique(sx, return_inverse=True, return_counts=True)
    return unique, np.bincount(inverse, weights=sy) / counts


def local_fit(x: np.ndarray, y: np.ndarray, share: float = 0.3) -> np.ndarray:
    """Locally weighted straight lines at the points themselves, tricube weights over the nearest share of points."""
    n = len(x)
    k = min(n, max(2, int(np.ceil(share * n))))
    out = np.empty(n)
    for i in range(n):
        d = np.abs(x - x[i])
        reach = np.sort(d)[k - 1] or 1.0
        w = np.clip(1 - (d / (reach * 1.0001)) ** 3, 0, None) ** 3
        mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
        sxx = (w * (x - mx) ** 2).sum()
        out[i] = my + ((w * (x - mx) * (y - my)).sum() / sxx * (x[i] - mx) if sxx > 1e-18 else 0.0)
    return out


def loess_points(x: np.ndarray, y: np.ndarray, log: bool = False, rising: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the smoothed map from x to the label y."""
    low = float(np.min(x))
    sx, sy = smoothed(np.log1p(np.asarray(x) - low) if log else x, y)
    sy = local_fit(sx, sy)
    return monotone(sx), monotone(sy) if rising else sy


# --- queries ------------------------------------------------------------------------------------------------------
def labelled_sims(spark, d) -> DataFrame:
    """(metric, key, id1, id2, x, y): each pair's greatest score by metric, with the mean label where it was judged."""
    sims = table(spark, d, "sims").where("id1 is not null and id2 is not null and metric is not null")
    said = sims.groupBy("metric", "id1", "id2").agg(F.max(F.when(~F.isnan("similarity"), F.col("similarity"))).alias("x"))
    gold = table(spark, d, "gold").where("id1 is not null and id2 is not null").groupBy("id1", "id2").agg(F.avg("similarity").alias("y"))
    return said.join(gold, ["id1", "id2"], "left").select("metric", F.concat_ws("-", "id1", "id2").alias("key"), "id1", "id2", "x", "y")


def q_norm_range(spark, d):
    s = labelled_sims(spark, d)
    joined = observed(s).join(F.broadcast(ranges(s)), "metric")  # one row a metric
    y = to_range(F.col("x"), F.col("low"), F.col("high"), -1.0, 1.0)
    return joined.select("metric", "id1", "id2", F.round(y, 6).alias("z"), F.round(from_range(y, F.col("low"), F.col("high"), -1.0, 1.0), 5).alias("back"))


def q_norm_log(spark, d):
    s = labelled_sims(spark, d)
    joined = observed(s).join(F.broadcast(ranges(s)), "metric")
    return joined.select("metric", "id1", "id2", F.round(log_scaled(F.col("x"), F.col("low")), 6).alias("z"))


def q_norm_percentile(spark, d):
    from relata.operators.calibrate import percentile_knots, percentiles

    s = observed(labelled_sims(spark, d))
    return percentiles(s.select("metric", "id1", "id2", "x"), percentile_knots(s)).select("metric", "id1", "id2", F.round("p", 6).alias("p"))


def q_norm_missing(spark, d):
    return missing_means(labelled_sims(spark, d)).select("metric", F.round("missing", 6).alias("missing"))


def rank_and_score_model(ranked: DataFrame) -> DataFrame:
    """(metric, b0, b1, b2, n): least squares of y on ln(1 + rank) and score, in closed form from sums of one pass."""
    r, s, y = F.log1p(F.col("rank").cast("double")), F.col("score"), F.col("y")
    sums = ranked.where("y is not null").groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(r, r).alias("rr"), F.covar_pop(s, s).alias("ss"), F.covar_pop(r, s).alias("rs"),
        F.covar_pop(r, y).alias("ry"), F.covar_pop(s, y).alias("sy"), F.avg(r).alias("mr"), F.avg(s).alias("ms"), F.avg(y).alias("my"),
    )
    det = F.col("rr") * F.col("ss") - F.col("rs") * F.col("rs")
    b1 = F.when(F.abs(det) > 1e-12, (F.col("ry") * F.col("ss") - F.col("sy") * F.col("rs")) / det)
    b2 = F.when(F.abs(det) > 1e-12, (F.col("sy") * F.col("rr") - F.col("ry") * F.col("rs")) / det)
    return sums.select("metric", "n", b1.alias("b1"), b2.alias("b2"), (F.col("my") - b1 * F.col("mr") - b2 * F.col("ms")).alias("b0"))


def _ranked(spark, d):
    w = Window.partitionBy("metric", "id1").orderBy(F.desc("x"), "id2")
    return observed(labelled_sims(spark, d)).select("metric", "id1", "id2", F.col("x").alias("score"), "y", (F.row_number().over(w) - 1).alias("rank"))


def q_norm_rank_score(spark, d):
    ranked = _ranked(spark, d)
    model = rank_and_score_model(ranked)
    z = F.col("b0") + F.col("b1") * F.log1p(F.col("rank").cast("double")) + F.col("b2") * F.col("score")
    return ranked.join(F.broadcast(model), "metric").select("metric", "id1", "id2", F.round(z, 5).alias("z"))


def _loess_knots(spark, d):
    """(metric, knot, x, y): the smoothed map of each metric, learned from a bounded sample of judged pairs."""
    s = sampled(observed(labelled_sims(spark, d)).where("y is not null"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = loess_points(rows["x"].to_numpy(float), rows["y"].to_numpy(float))
        return pd.DataFrame({"metric": rows["metric"].iloc[0], "knot": np.arange(len(x)), "x": x, "y": y})

    return s.groupBy("metric").applyInPandas(fit, "metric string, knot int, x double, y double")


def q_norm_loess(spark, d):
    return _loess_knots(spark, d).select("metric", "knot", F.round("x", 6).alias("x"), F.round("y", 5).alias("y"))


def q_norm_loess_apply(spark, d):
    """Every score of a metric through the metric's smoothed map."""
    from relata.operators.calibrate import smoothly

    scores = observed(labelled_sims(spark, d)).select("metric", "id1", "id2", "x")
    return smoothly(scores, _loess_knots(spark, d).select("metric", "x", "y")).select("metric", "id1", "id2", F.round("z", 4).alias("z"))


def q_empirical_percentile(spark, d):
    """(i + 1) / (n + 1) of each judged label, ties in order of the pair."""
    from relata.operators.ranks import distributed_ranks

    gold = table(spark, d, "gold").where("similarity is not null and id1 is not null and id2 is not null").groupBy("id1", "id2").agg(F.avg("similarity").alias("y"))
    ordered = gold.select(F.lit(0).alias("all"), F.struct("y", "id1", "id2").alias("by"))
    ranked = distributed_ranks(ordered, ["all"], "by", descending=False)
    return ranked.select("by.id1", "by.id2", F.round(F.col("rank") / (F.col("size") + 1), 6).alias("p"))


def q_math_functions(spark, d):
    s = observed(labelled_sims(spark, d)).where("x >= 0")  # logarithms of negative scores have no value
    x = F.col("x")
    return s.select(
        "metric", "id1", "id2", F.round(M.to_asymptote(x, 0.25, 0.1, 1.0), 6).alias("asymptote"), F.round(M.rank_score(x, 500), 6).alias("by_rank"),
        F.round(M.percentile_score(x), 6).alias("by_percentile"), F.round(M.log_boost(x, 2, 0.5), 6).alias("boost"),
        F.round(M.distance_score(x, F.lit(0.2)), 6).alias("by_distance"),
    )


def q_robust_mean(spark, d):
    """Mean of each query's scores by metric under a bell curve over their places; no list is gathered in a row."""
    from relata.operators.ranks import distributed_ranks

    s = observed(labelled_sims(spark, d)).select("metric", "id1", F.struct("x", "id2").alias("by"))
    placed = distributed_ranks(s, ["metric", "id1"], "by", descending=False)
    spread = F.greatest(F.lit(3.0), F.floor(F.col("size") / 4).cast("double"))
    weight = F.exp(-F.pow((F.col("rank") - 1 - F.floor(F.col("size") / 2)) / spread, F.lit(2.0)) / 2)
    sums = placed.select("metric", "id1", weight.alias("w"), (F.col("by.x") * weight).alias("wx")).groupBy("metric", "id1").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"))
    return sums.select("metric", "id1", F.round(F.col("wx") / F.col("w"), 5).alias("mean"))


def q_running_monotone(spark, d):
    """Scores of each query in rank order, forced to rise by at least 0.001 from one to the next."""
    w = Window.partitionBy("metric", "id1").orderBy("x", "id2")
    ranked = observed(labelled_sims(spark, d)).withColumn("i", F.row_number().over(w))
    up = F.max(F.col("x") - F.col("i") * 0.001).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i") * 0.001
    return ranked.select("metric", "id1", "id2", F.round(up, 6).alias("x"))


def q_smooth_window(spark, d):
    """Mean of a sliding window of 2 before and 3 after in order of the score."""
    w = Window.partitionBy("metric", "id1").orderBy("x", "id2").rowsBetween(-2, 3)
    return observed(labelled_sims(spark, d)).select("metric", "id1", "id2", F.round(F.avg("x").over(w), 5).alias("x"))


QUERIES = {
    "norm_range": q_norm_range, "norm_log": q_norm_log, "norm_percentile": q_norm_percentile, "norm_missing_mean": q_norm_missing,
    "norm_rank_score": q_norm_rank_score, "norm_loess": q_norm_loess, "norm_loess_apply": q_norm_loess_apply, "empirical_percentile": q_empirical_percentile, "math_functions": q_math_functions,
    "robust_mean": q_robust_mean, "running_monotone": q_running_monotone, "smooth_window": q_smooth_window,
}

SIMS_SQL = """with said as (select metric, id1, id2, max(case when not isnan(similarity) then similarity end) as x from sims
  where id1 is not null and id2 is not null and metric is not null group by all),
lab as (select id1, id2, avg(similarity) as y from gold where id1 is not null and id2 is not null group by all),
s as (select metric, id1 || '-' || id2 as key, id1, id2, x, y from said left join lab using (id1, id2)), o as (select * from s where isfinite(x)),
rng as (select metric, min(x) as low, max(x) as high from o group by 1)"""
_P = """smp as (select metric, x from (select *, row_number() over (partition by metric order by md5(key), key, x) as rn from o) where rn <= 1000),
pts as (select metric, x, avg(y) as y from (select metric, x, row_number() over (partition by metric order by x) / (count(*) over (partition by metric) + 1) as y from smp) group by all),
seg as (select metric, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from pts window w as (partition by metric order by x)),
ends as (select metric, min(x) as lo, max(x) as hi, min(y) as ylo, max(y) as yhi, (max(x) - min(x)) / 4 as half from pts group by 1)"""
_LOESS = """lp as (select *, row_number() over (partition by metric order by x, y) - 1 as i, count(*) over (partition by metric) as n from
  (select metric, x, y from (select *, row_number() over (partition by metric order by md5(key), key, x) as rn from o where y is not null) where rn <= 1000)),
lw as (select distinct metric, n, least(20, n // 10) as w from lp),
la as (select metric, n, w, unnest(range(w // 2, greatest(w // 2 + 1, n - w // 2), greatest(1, n // 11))) as c from lw),
lk as (select la.metric, c, w, y, row_number() over (partition by la.metric, c order by y) - 1 as r, count(*) over (partition by la.metric, c) as m
  from la join lp on lp.metric = la.metric and lp.i >= greatest(0, c - w // 2) and lp.i < greatest(c + 1, least(la.n, c + w))),
lm as (select metric, c, sum(y * g) / sum(g) as y from (select *, exp(-pow((r - m // 2) / greatest(3, m // 4), 2) / 2) as g from lk) group by all),
ls as (select lm.metric, lp.x, avg(lm.y) as y from lm join lp on lp.metric = lm.metric and lp.i = c group by all),
lq as (select metric, count(*) as m, least(count(*), greatest(2, cast(ceil(0.3::double * count(*)) as bigint))) as k from ls group by 1),
ld as (select a.metric, a.x as kx, b.x, b.y, abs(b.x - a.x) as d, row_number() over (partition by a.metric, a.x order by abs(b.x - a.x)) as r, k from ls a join ls b using (metric) join lq using (metric)),
lr as (select metric, kx, max(case when r = k then d end) as reach from ld group by all),
lg as (select metric, kx, x, y, pow(greatest(0, 1 - pow(d / (case when reach = 0 then 1 else reach end * 1.0001::double), 3)), 3) as g from ld join lr using (metric, kx)),
lc as (select metric, kx, sum(g * x) / sum(g) as mx, sum(g * y) / sum(g) as my from lg group by all),
lf as (select metric, kx as x, my + case when sxx > 1e-18 then sxy / sxx * (kx - mx) else 0 end as y from
  (select metric, kx, mx, my, sum(g * pow(x - mx, 2)) as sxx, sum(g * (x - mx) * (y - my)) as sxy from lg join lc using (metric, kx) group by all)),
kn as (select metric, knot, x, max(y - knot * 1e-10) over (partition by metric order by knot) + knot * 1e-10 as y from
  (select *, cast(row_number() over (partition by metric order by x) - 1 as int) as knot from lf))"""
SQL = {
    "norm_loess": f"{SIMS_SQL}, {_LOESS} select metric, knot, round(x, 6) as x, round(y, 5) as y from kn",
    "norm_loess_apply": f"""{SIMS_SQL}, {_LOESS}, sg as (select metric, x as x0, y as y0, lead(x) over v as x1, lead(y) over v as y1 from kn window v as (partition by metric order by x)),
      en as (select metric, min(x) as lo, max(x) as hi, arg_min(y, x) as ylo, arg_max(y, x) as yhi, (max(x) - min(x)) / 4 as half from kn group by 1)
      select o.metric, id1, id2, round(case when x < lo then ylo - (1 - exp(-(lo - x) / half)) * (yhi - ylo) / 10 when x > hi then yhi + (1 - exp(-(x - hi) / half)) * (yhi - ylo) / 10
        when x1 is null then y0 else y0 + (y1 - y0) * (x - x0) / (x1 - x0) end, 4) as z from o join en using (metric) asof left join sg on o.metric = sg.metric and o.x >= sg.x0""",
    "norm_range": f"{SIMS_SQL} select metric, id1, id2, round(-1 + 2 * (x - low) / (high - low), 6) as z, round(low + (-1 + 2 * (x - low) / (high - low) + 1) * (high - low) / 2, 5) as back from o join rng using (metric)",
    "norm_log": f"{SIMS_SQL} select metric, id1, id2, case when x < low or low + x <= 0 then 0.0 else round(ln(case when low + x > 0 then low + x else 1 end), 6) end as z from o join rng using (metric)",
    "norm_percentile": f"""{SIMS_SQL}, {_P} select metric, id1, id2, round(case when x < lo then ylo + (1 - exp(-(lo - x) / half)) * (0 - ylo) when x > hi then yhi + (1 - exp(-(x - hi) / half)) * (1 - yhi)
      when x1 is null then y0 else y0 + (y1 - y0) * (x - x0) / (x1 - x0) end, 6) as p
      from o join ends using (metric) asof left join seg on o.metric = seg.metric and o.x >= seg.x0""",
    "norm_missing_mean": f"{SIMS_SQL} select metric, round(avg(case when x is null or not isfinite(x) then y end), 6) as missing from s where y is not null group by 1",
    "norm_rank_score": f"""{SIMS_SQL}, rk as (select *, ln(row_number() over (partition by metric, id1 order by x desc, id2)) as r from o),
      c as (select metric, covar_pop(r, r) as rr, covar_pop(x, x) as ss, covar_pop(r, x) as rs, covar_pop(r, y) as ry, covar_pop(x, y) as sy, avg(r) as mr, avg(x) as ms, avg(y) as my
        from rk where y is not null group by 1),
      b as (select *, (ry * ss - sy * rs) / (rr * ss - rs * rs) as b1, (sy * rr - ry * rs) / (rr * ss - rs * rs) as b2 from c)
      select rk.metric, id1, id2, round(my - b1 * mr - b2 * ms + b1 * r + b2 * x, 5) as z from rk join b on b.metric = rk.metric""",
    "empirical_percentile": """with g as (select id1, id2, avg(similarity) as y from gold where similarity is not null and id1 is not null and id2 is not null group by all)
      select id1, id2, round(row_number() over (order by y, id1, id2) / (count(*) over () + 1), 6) as p from g""",
    "math_functions": f"""{SIMS_SQL} select metric, id1, id2, round(0.1 + (1 - exp(-x / 0.25)) * 0.9, 6) as asymptote, round(((ln(502) - ln(x + 1)) / ln(502) - 0.5) * 2, 6) as by_rank,
      round((x - 0.5) * 2, 6) as by_percentile, round(sqrt(ln(1 + ln(1 + x))), 6) as boost, round(ln(greatest(x, 0.2)) / ln(0.2), 6) as by_distance from o where x >= 0""",
    "robust_mean": f"""{SIMS_SQL}, k as (select metric, id1, x, row_number() over (partition by metric, id1 order by x) - 1 as i, count(*) over (partition by metric, id1) as n from o),
      w as (select metric, id1, x, exp(-pow((i - floor(n / 2)) / greatest(3, floor(n / 4)), 2) / 2) as w from k)
      select metric, id1, round(sum(x * w) / sum(w), 5) as mean from w group by all""",
    "running_monotone": f"""{SIMS_SQL}, k as (select *, row_number() over (partition by metric, id1 order by x, id2) as i from o)
      select metric, id1, id2, round(max(x - i * 0.001::double) over (partition by metric, id1 order by i) + i * 0.001::double, 6) as x from k""",
    "smooth_window": f"{SIMS_SQL} select metric, id1, id2, round(avg(x) over (partition by metric, id1 order by x, id2 rows between 2 preceding and 3 following), 5) as x from o",
}
