"""One ranking from scores of different scales: robust rank aggregation (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.operators.ranks import distributed_ranks
from relata.session import table


def order_statistic_significance(ranks: Column) -> Column:
    """Corrected least probability of a list of normalised ranks in (0, 1].

    The j-th smallest of k uniform ranks is at most r with the probability sum over i = j..k of C(k, i) r^i (1-r)^(k-i).
    The least of these over j, times k, at most 1, is the significance: small where the item ranks high more
    consistently than chance. An empty list gives 1.
    """
    k = F.size(ranks)
    ordered = F.array_sort(ranks)

    def choose(i: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), i), F.lit(1.0), lambda acc, t: acc * (k - i + t).cast("double") / t.cast("double")
        )

    def tail(r: Column, j: Column) -> Column:
        return F.aggregate(
            F.sequence(j + 1, k), F.lit(0.0),
            lambda acc, i: acc + choose(i) * F.pow(r, i.cast("double")) * F.pow(F.greatest(F.lit(0.0), F.lit(1.0) - r), (k - i).cast("double")),
        )

    least = F.array_min(F.transform(ordered, tail))
    return F.when(k > 0, F.least(F.lit(1.0), least * k)).otherwise(F.lit(1.0))


def combined_ranking(scores: DataFrame) -> DataFrame:
    """(query_id, id, significance, mean): one ranking of each query's ids over all its metrics.

    scores: (query_id, id, metric, score). NULL and NaN say nothing, of repeats the greatest score counts, infinities
    are ordinary values. Only the order within a query and metric matters, so no range can dominate. Ids that no metric
    says anything about come last. Equal significance is decided by the mean normalised rank, then by the id; both are rounded to twelve places first.
    """
    known = scores.where("query_id is not null and id is not null")
    said = (
        known.where("metric is not null and score is not null and not isnan(score)")
        .groupBy("query_id", "id", "metric")
        .agg(F.max("score").alias("score"))
    )
    ranks = distributed_ranks(said, ["query_id", "metric"], "score").select(
        "query_id", "id", (F.col("rank") / F.col("size")).alias("r")
    )
    silent = known.select("query_id", "id", F.lit(None).cast("double").alias("r")).distinct()
    lists = ranks.unionByName(silent).groupBy("query_id", "id").agg(F.collect_list("r").alias("ranks"), F.avg("r").alias("mean"))
    # collect_list leaves nulls out; a list has at most one rank a metric.
    return lists.select(
        "query_id", "id", order_statistic_significance(F.col("ranks")).alias("significance"), F.coalesce("mean", F.lit(1.0)).alias("mean")
    )


def first_of(rated: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("significance", 12), F.round("mean", 12), "id")
    return rated.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def _scores(spark, sf_dir: str) -> DataFrame:
    sims = table(spark, sf_dir, "sims").select(
        F.col("id1").alias("query_id"), F.col("id2").alias("id"), F.concat(F.lit("sims:"), "metric").alias("metric"), F.col("similarity").alias("score")
    )
    pairs = sims.select("query_id", "id").distinct()
    listed = table(spark, sf_dir, "neighbours").select(
        "query_id", "id", F.concat(F.lit("neighbours:"), "metric").alias("metric"), "score"
    )
    return sims.unionByName(listed.join(pairs, ["query_id", "id"], "left_semi"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return first_of(combined_ranking(_scores(spark, sf_dir)), 5).select("query_id", "id")


SQL = {
    "p4_found": """
with pairs as (select distinct id1 as query_id, id2 as id from sims),
said as (
  select query_id, id, metric, max(score) as score from (
    select id1 as query_id, id2 as id, 'sims:' || metric as metric, similarity as score from sims
    union all
    select query_id, id, 'neighbours:' || metric, score from neighbours semi join pairs using (query_id, id))
  where score is not null and not isnan(score) and metric is not null group by all),
ranked as (
  select query_id, id, (rank() over (partition by query_id, metric order by score desc)
    + (count(*) over (partition by query_id, metric, score) - 1) / 2.0) / count(*) over (partition by query_id, metric) as r
  from said),
placed as (
  select query_id, id, r, row_number() over (partition by query_id, id order by r) as j, count(*) over (partition by query_id, id) as k
  from ranked),
tails as (
  select query_id, id, r, k, (select sum(exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1)) * pow(r, i) * pow(greatest(0, 1 - r), k - i))
    from range(j, k + 1) t(i)) as p
  from placed),
rated as (
  select query_id, id, coalesce(least(1.0, min(p) * any_value(k)), 1.0) as significance, coalesce(avg(r), 1.0) as mean
  from pairs left join tails using (query_id, id) where query_id is not null and id is not null group by all)
select query_id, id from (
  select *, row_number() over (partition by query_id order by round(significance, 12), round(mean, 12), id) as n from rated)
where n <= 5"""
}
