"""Judged pairs against measures: cleaning and combining labels, correlations, coverage, error figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import maths as M
from relata.functions import text as T
from relata.operators.normalize import SIMS_SQL, labelled_sims
from relata.operators.ranks import distributed_ranks
from relata.session import table

BINS = 4


def combined_gold(gold: DataFrame) -> DataFrame:
    """(a, b, label): labels scaled to 0..1 within each source, then the mean of repeated pairs."""
    a, b = T.clean_gold(F.col("phrase1"), F.col("phrase2"))
    labelled = gold.where("similarity is not null and phrase1 is not null and phrase2 is not null")
    rng = labelled.groupBy("source").agg(F.min("similarity").alias("low"), F.max("similarity").alias("high"))
    scaled = labelled.join(F.broadcast(rng), "source")  # one row a source
    label = F.when(F.col("high") > F.col("low"), (F.col("similarity") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    return scaled.select(a.alias("a"), b.alias("b"), label.alias("label")).groupBy("a", "b").agg(F.avg("label").alias("label"))


def stratified(pairs: DataFrame, bins: int = BINS, least: float | None = None) -> DataFrame:
    """Pairs in equal-width bins of their label, every bin cut to the size of the smallest one that isn't empty.

    Which pairs stay is decided by a digest, so every run keeps the same.
    """
    kept = pairs if least is None else pairs.where(F.col("label") >= least)
    bounds = kept.agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    binned = kept.join(F.broadcast(bounds)).withColumn("bin", F.floor((F.col("label") - F.col("lo")) / (0.0001 + F.col("hi") - F.col("lo")) * bins).cast("int"))
    size = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("most"))
    w = Window.partitionBy("bin").orderBy(F.md5(F.concat_ws("|", "a", "b")), "a", "b")
    ranked = binned.withColumn("rn", F.row_number().over(w)).join(F.broadcast(size))
    return ranked.where(F.col("rn") <= F.col("most")).select("a", "b", "label", "bin")


def average_ranks(df: DataFrame, group: str, column: str, out: str) -> DataFrame:
    """df with the rank of column within its group, ties sharing their average; no task holds a whole group."""
    return distributed_ranks(df, [group], column, descending=False).drop("size").withColumnRenamed("rank", out)


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; NULL where one side doesn't vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / F.when(spread > 0, spread))


def correlations(scores: DataFrame, least: int = 4) -> DataFrame:
    """(metric, n, coverage, pearson, spearman) of score x and label y; NULL below ``least`` usable points."""
    judged = scores.where("y is not null").withColumn("ok", M.finite(F.col("x")))
    cover = judged.groupBy("metric").agg(F.count(F.lit(1)).alias("asked"), F.sum(F.col("ok").cast("int")).alias("n"))
    ranked = average_ranks(average_ranks(judged.where("ok").select("metric", "x", "y"), "metric", "x", "rx"), "metric", "y", "ry")
    corr = ranked.groupBy("metric").agg(correlation("x", "y").alias("pearson"), correlation("rx", "ry").alias("spearman"))
    joined = cover.join(corr, "metric", "left")
    enough = lambda c: F.round(F.when(F.col("n") >= least, F.col(c)), 6).alias(c)
    return joined.select("metric", F.col("n").cast("bigint").alias("n"), F.round(F.col("n") / F.col("asked"), 6).alias("coverage"), enough("pearson"), enough("spearman"))


def q_gold_combine(spark, d):
    gold = table(spark, d, "gold").withColumn("source", F.coalesce((F.col("id1") % 3).cast("int"), F.lit(-1)))
    return combined_gold(gold).select("a", "b", F.round("label", 6).alias("label"))


def q_gold_stratified(spark, d):
    gold = table(spark, d, "gold").withColumn("source", F.lit(0))
    return stratified(combined_gold(gold)).select("a", "b", F.round("label", 6).alias("label"), "bin")


def q_correlation(spark, d):
    return correlations(labelled_sims(spark, d))


def q_score_stats(spark, d):
    s = labelled_sims(spark, d).where(M.finite(F.col("x")))
    return s.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 6).alias("low"), F.round(F.max("x"), 6).alias("high"),
        F.round(F.avg("x"), 5).alias("mean"), F.round(F.stddev_pop("x"), 5).alias("spread"),
    )


def q_errors(spark, d):
    """Mean squared error, its root and the size of the correlation between score and label."""
    s = labelled_sims(spark, d).where(M.finite(F.col("x")) & F.col("y").isNotNull())
    e = F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))
    return s.groupBy("metric").agg(F.round(e, 5).alias("mse"), F.round(F.sqrt(e), 5).alias("rmse"), F.round(F.abs(correlation("x", "y")), 6).alias("r"))


def wide_scores(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(id1, id2, y, one column for each metric): a pivot with the metrics given, so no pass is needed to find them."""
    usable = scores.withColumn("x", F.when(M.finite(F.col("x")), F.col("x")))
    return usable.groupBy("id1", "id2").pivot("metric", metrics).agg(F.max("x")).join(
        scores.where("y is not null").groupBy("id1", "id2").agg(F.max("y").alias("y")), ["id1", "id2"], "left"
    )


METRICS = ["category", "esa", "google", "lucene", "tfidf"]


def q_metric_matrix(spark, d):
    """Judged pairs with the label and each metric's score, the rows that every metric covers only."""
    wide = wide_scores(labelled_sims(spark, d), METRICS)
    return wide.dropna(how="any").select("id1", "id2", F.round("y", 6).alias("y"), *METRICS)


def q_list_correlation(spark, d):
    """Correlation of labels and ranks: the judged page's score in the query's list, the least score where it is missing."""
    gold = table(spark, d, "gold").where("id1 is not null and id2 is not null and similarity is not null").groupBy("id1", "id2").agg(F.avg("similarity").alias("y"))
    lists = table(spark, d, "neighbours").where(M.finite(F.col("score"))).groupBy("metric", F.col("query_id").alias("id1"), F.col("id").alias("id2")).agg(F.max("score").alias("x"))
    metrics = lists.groupBy("metric").agg(F.min("x").alias("least"))
    asked = gold.join(F.broadcast(metrics))  # one row a metric
    scored = asked.join(lists, ["metric", "id1", "id2"], "left").select("metric", "y", F.coalesce("x", "least").alias("x"))
    return correlations(scored)


def joint_fit(wide: DataFrame, columns: list[str], label: str, intercept: float, coefficients: dict[str, float]) -> DataFrame:
    """(metric, n, pearson, spearman, r2): each measure by itself and the fitted sum of all (``joint``) against the label,
    over rows that all measures cover."""
    fit = F.lit(float(intercept)) + sum((F.lit(float(coefficients[c])) * F.col(c) for c in columns), F.lit(0.0))
    covered = wide.dropna(subset=[*columns, label]).withColumn("joint", fit)
    long = covered.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in [*columns, "joint"]])).alias("e"), F.col(label).alias("y"))
    spread = covered.agg(F.avg((F.col(label) - fit) * (F.col(label) - fit)).alias("left"), F.var_pop(label).alias("all"))
    r2 = F.when(F.col("all") > 0, 1 - F.col("left") / F.col("all"))
    found = correlations(long.select("e.metric", "e.x", "y"))
    return found.join(F.broadcast(spread)).select("metric", "n", "pearson", "spearman", F.when(F.col("metric") == "joint", F.round(r2, 6)).alias("r2"))


def q_joint_fit(spark, d):
    """Two measures fitted together on the judged pairs both cover."""
    from relata.operators.ensemble import fit_from_moments

    two = ["esa", "google"]
    wide = wide_scores(labelled_sims(spark, d), METRICS).where("y is not null").dropna(subset=two).select("id1", "id2", "y", *two)
    b0, b = fit_from_moments(wide, two, "y")
    return joint_fit(wide, two, "y", b0, dict(zip(two, map(float, b))))


QUERIES = {
    "joint_fit": q_joint_fit, "gold_combine": q_gold_combine, "gold_stratified_filter": q_gold_stratified, "pearson_spearman_coverage": q_correlation, "score_statistics": q_score_stats,
    "prediction_errors": q_errors, "metric_matrix": q_metric_matrix, "list_correlation": q_list_correlation,
}

_GOLD = """g as (select *, {0} as source from gold where similarity is not null and phrase1 is not null and phrase2 is not null),
comb as (select a, b, avg(label) as label from (select lower(replace(least(phrase1, phrase2), '_', ' ')) as a, lower(replace(greatest(phrase1, phrase2), '_', ' ')) as b,
  case when hi > lo then (similarity - lo) / (hi - lo) else 0 end as label from g join (select source, min(similarity) as lo, max(similarity) as hi from g group by 1) using (source)) group by all)"""
_CORR = """jd as (select *, x is not null and isfinite(x) as ok from {0} where y is not null),
cov as (select metric, count(*) as asked, count(*) filter (ok) as n from jd group by 1),
rk as (select metric, x, y, rank() over (partition by metric order by x) + (count(*) over (partition by metric, x) - 1) / 2 as rx, rank() over (partition by metric order by y) + (count(*) over (partition by metric, y) - 1) / 2 as ry from jd where ok),
cr as (select metric, case when stddev_pop(x) > 0 and stddev_pop(y) > 0 then corr(x, y) end as p, case when stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then corr(rx, ry) end as sp from rk group by 1)
select metric, n, round(n / asked, 6) as coverage, round(case when n >= 4 then p end, 6) as pearson, round(case when n >= 4 then sp end, 6) as spearman from cov left join cr using (metric)"""
SQL = {
    "joint_fit": f"""{SIMS_SQL}, w as (select id1, id2, max(y) as y, max(x) filter (metric = 'esa' and isfinite(x)) as esa, max(x) filter (metric = 'google' and isfinite(x)) as google from s group by all),
      k as (select * from w where y is not null and esa is not null and google is not null),
      mo as (select covar_pop(google, google) as gg, covar_pop(esa, esa) as ee, covar_pop(google, esa) as ge, covar_pop(google, y) as gy, covar_pop(esa, y) as ey, avg(google) as mg, avg(esa) as me, avg(y) as my from k),
      be as (select *, (gy * ee - ey * ge) / (gg * ee - ge * ge) as b1, (ey * gg - gy * ge) / (gg * ee - ge * ge) as b2 from mo),
      p as (select k.*, my - b1 * mg - b2 * me + b1 * google + b2 * esa as joint from k, be), lo as (unpivot p on esa, google, joint into name metric value x),
      fi as (select metric, x, y from lo), co as ({_CORR.format('fi').replace('jd as', 'with jd as', 1)})
      select metric, n, pearson, spearman, case when metric = 'joint' then (select round(1 - avg((y - joint) * (y - joint)) / var_pop(y), 6) from p) end as r2 from co""",
    "gold_combine": "with " + _GOLD.format("coalesce(id1 % 3, -1)") + " select a, b, round(label, 6) as label from comb",
    "gold_stratified_filter": "with " + _GOLD.format("0") + f""", bn as (select *, cast(floor((label - lo) / (0.0001 + hi - lo) * {BINS}) as int) as bin from comb, (select min(label) as lo, max(label) as hi from comb)),
      rn as (select *, row_number() over (partition by bin order by md5(a || '|' || b), a, b) as rn from bn)
      select a, b, round(label, 6) as label, bin from rn where rn <= (select min(n) from (select count(*) as n from bn group by bin))""",
    "pearson_spearman_coverage": f"{SIMS_SQL}, {_CORR.format('s')}",
    "score_statistics": f"{SIMS_SQL} select metric, count(*) as n, round(min(x), 6) as low, round(max(x), 6) as high, round(avg(x), 5) as mean, round(stddev_pop(x), 5) as spread from o group by 1",
    "prediction_errors": f"{SIMS_SQL} select metric, round(avg((x - y) * (x - y)), 5) as mse, round(sqrt(avg((x - y) * (x - y))), 5) as rmse, round(abs(corr(x, y)), 6) as r from o where y is not null group by 1",
    "metric_matrix": f"""{SIMS_SQL}, w as (select id1, id2, max(y) as y, {', '.join(f"max(x) filter (metric = '{m}' and isfinite(x)) as {m}" for m in METRICS)} from s group by all)
      select id1, id2, round(y, 6) as y, {', '.join(METRICS)} from w where y is not null and {' and '.join(f'{m} is not null' for m in METRICS)}""",
    "list_correlation": f"""with l as (select metric, query_id as id1, id as id2, max(score) as x from neighbours where isfinite(score) group by all),
      g as (select id1, id2, avg(similarity) as y from gold where id1 is not null and id2 is not null and similarity is not null group by all),
      ms as (select metric, min(x) as low from l group by 1), sc as (select ms.metric, y, coalesce(x, low) as x from g cross join ms left join l on l.metric = ms.metric and l.id1 = g.id1 and l.id2 = g.id2), {_CORR.format('sc')}""",
}
