"""Normalizers as they are used: fitted once on judged scores, applied as expressions and one bounded broadcast."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import maths as M
from relata.operators import normalize as N

#: Places that the range of a model's points is divided into; a score looks at the few segments of its own place.
PLACES = 1_024
KINDS = ("identity", "range", "log", "percentile", "loess", "rankandscore")


def percentile_knots(scores: DataFrame, size: int = N.SAMPLE) -> DataFrame:
    """(metric, x, y): the sorted sample of each metric and (i + 1) / (n + 1) at its places; equal scores share their mean."""
    w = Window.partitionBy("metric")  # at most ``size`` rows a metric
    ranked = N.sampled(scores, size).select("metric", "x", (F.row_number().over(w.orderBy("x")) / (F.count(F.lit(1)).over(w) + 1)).alias("y"))
    return ranked.groupBy("metric", "x").agg(F.avg("y").alias("y"))


def interpolated(scores: DataFrame, knots: DataFrame, low_end: Column, high_end: Column, out: str = "p", x: str = "x") -> DataFrame:
    """``scores`` (metric, x, ...) with ``out``, linear between the knots (metric, x, y) of the metric.

    Beyond them it goes towards low_end and high_end, expressions of ylo and yhi, with a quarter of the width as
    half-life. NULL for scores that aren't finite and for metrics without knots. Knots are few (at most SAMPLE a
    metric), so the segments are broadcast; a score meets those of its own place of PLACES only.
    """
    w = Window.partitionBy("metric").orderBy("x")
    bounds = knots.groupBy("metric").agg(
        F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.min_by("y", "x").alias("ylo"), F.max_by("y", "x").alias("yhi")
    )
    place = lambda c: F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((c - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PLACES), F.lit(PLACES - 1))).otherwise(F.lit(0)).cast("int")
    segments = knots.select("metric", F.col("x").alias("_x0"), F.col("y").alias("_y0"), F.lead("x").over(w).alias("_x1"), F.lead("y").over(w).alias("_y1")).join(bounds, "metric")
    placed = segments.select("metric", "_x0", "_y0", "_x1", "_y1", F.explode(F.sequence(place(F.col("_x0")), place(F.coalesce("_x1", "_x0")))).alias("_place"))
    s = F.col(x)
    known = scores.join(F.broadcast(bounds), "metric", "left").withColumn("_place", F.when(M.finite(s) & (s >= F.col("_lo")) & (s <= F.col("_hi")), place(s)))
    inside = (F.col("s._place") == F.col("g._place")) & (F.col("s.metric") == F.col("g.metric")) & (F.col(f"s.{x}") >= F.col("g._x0")) & (F.col("g._x1").isNull() | (F.col(f"s.{x}") < F.col("g._x1")))
    joined = known.alias("s").join(F.broadcast(placed.alias("g")), inside, "left").select("s.*", "_x0", "_y0", "_x1", "_y1")
    half = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / 4).otherwise(F.lit(1.0))
    below = F.col("ylo") + (1 - F.exp(-(F.col("_lo") - s) / half)) * (low_end - F.col("ylo"))
    above = F.col("yhi") + (1 - F.exp(-(s - F.col("_hi")) / half)) * (high_end - F.col("yhi"))
    between = F.when(F.col("_x1").isNull(), F.col("_y0")).otherwise(F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (s - F.col("_x0")) / (F.col("_x1") - F.col("_x0")))
    value = F.when(~M.finite(s) | F.col("_lo").isNull(), None).when(s < F.col("_lo"), below).when(s > F.col("_hi"), above).otherwise(between)
    return joined.withColumn(out, value).drop("_lo", "_hi", "ylo", "yhi", "_place", "_x0", "_y0", "_x1", "_y1")


def percentiles(scores: DataFrame, knots: DataFrame, out: str = "p", x: str = "x") -> DataFrame:
    return interpolated(scores, knots, F.lit(0.0), F.lit(1.0), out, x)


def smoothly(scores: DataFrame, knots: DataFrame, out: str = "z", x: str = "x") -> DataFrame:
    """As :func:`interpolated`, beyond the knots up to a tenth of their height further."""
    tenth = (F.col("yhi") - F.col("ylo")) * 0.1
    return interpolated(scores, knots, F.col("ylo") - tenth, F.col("yhi") + tenth, out, x)


@dataclass
class Normalizer:
    """A fitted map of scores. ``on`` takes (score, ...), with rank from 1 where the kind asks for it."""

    kind: str
    low: float | None = None
    high: float | None = None
    missing: float | None = None
    coefficients: tuple[float, float, float] | None = None
    log: bool = False
    knots: DataFrame | None = None

    def on(self, df: DataFrame) -> DataFrame:
        if self.kind == "identity":
            return df
        s = F.col("score")
        absent = F.lit(self.missing).cast("double")
        if self.kind == "range":
            return df.withColumn("score", N.to_range(s, F.lit(self.low).cast("double"), F.lit(self.high).cast("double"), 0.0, 1.0, truncate=True))
        if self.kind == "log":
            return df.withColumn("score", F.when(M.finite(s) & F.lit(self.low is not None), N.log_scaled(s, F.lit(self.low).cast("double"))))
        if self.kind == "rankandscore":
            if "rank" not in df.columns:
                raise ValueError("rankAndScore rates lists only")
            b0, b1, b2 = (F.lit(v).cast("double") for v in self.coefficients or (None, None, None))
            return df.withColumn("score", F.when(M.finite(s), b0 + b1 * F.log(F.col("rank").cast("double")) + b2 * _logged(s, self.log, self.low)).otherwise(absent))
        asked = df.withColumns({"metric": F.lit("m"), "_x": _logged(s, self.log and self.kind == "loess", self.low)})
        found = (percentiles if self.kind == "percentile" else smoothly)(asked, self.knots, "_y", "_x")
        return found.withColumn("score", F.coalesce("_y", absent)).drop("metric", "_x", "_y")


def _logged(s: Column, log: bool, low: float | None) -> Column:
    return F.when(s >= F.lit(low), F.log(1 + s - F.lit(low))).otherwise(F.lit(0.0)) if log and low is not None else s


def parameters(spec: str | dict[str, Any] | None) -> dict[str, Any]:
    """{type, log, monotonic} of a normalizer's entry in a configuration: its name, or an object with a type."""
    spec = {"type": "identity"} if spec is None else {"type": spec} if isinstance(spec, str) else dict(spec)
    if not isinstance(spec.get("type"), str) or spec["type"].lower() not in KINDS:
        raise ValueError(f"unknown normalizer: {spec.get('type')}")
    if extra := set(spec) - {"type", "log", "monotonic"}:
        raise ValueError(f"unknown settings of a normalizer: {', '.join(sorted(extra))}")
    return {"type": spec["type"].lower(), "log": bool(spec.get("log", False)), "monotonic": bool(spec.get("monotonic", False))}


def fitted(spec: str | dict[str, Any] | None, observed: DataFrame) -> Normalizer:
    """The normalizer of ``spec`` for ``observed`` (key, x, y[, rank from 1]): scores, NULL where absent, and labels.

    Only sums and at most SAMPLE points reach the driver.
    """
    p = parameters(spec)
    if p["type"] == "identity":
        return Normalizer("identity")
    ok = M.finite(F.col("x"))
    stats = observed.agg(F.min(F.when(ok, F.col("x"))).alias("low"), F.max(F.when(ok, F.col("x"))).alias("high"), F.avg(F.when(~ok, F.col("y"))).alias("missing")).first()
    made = Normalizer(p["type"], stats["low"], stats["high"], stats["missing"], log=p["log"])
    named = observed.withColumn("metric", F.lit("m"))
    if p["type"] == "percentile":
        made.knots = percentile_knots(named)
    elif p["type"] == "loess":
        some = N.sampled(named.where("y is not null")).select("x", "y").toPandas()
        x, y = N.loess_points(some["x"].to_numpy(float), some["y"].to_numpy(float), p["log"], p["monotonic"]) if len(some) else (np.zeros(0), np.zeros(0))
        made.knots = observed.sparkSession.createDataFrame([("m", float(a), float(b)) for a, b in zip(x, y)], "metric string, x double, y double")
    elif p["type"] == "rankandscore":
        ranked = named.where(ok & F.col("rank").isNotNull()).select("metric", (F.col("rank") - 1).alias("rank"), _logged(F.col("x"), p["log"], made.low).alias("score"), "y")
        row = N.rank_and_score_model(ranked).first()
        made.coefficients = (row["b0"], row["b1"], row["b2"]) if row else None
    return made
