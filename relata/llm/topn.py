"""The N highest-scoring items of every group (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.session import table


def top_n(df: DataFrame, group: list[str], item: str, score: str, n: int) -> DataFrame:
    """(group..., item, score, rn): per group the n items with the highest score, ties by the smaller item.

    Repeats of an item count once, with their greatest score. NULL and NaN scores never count, infinities are ordinary
    values, rows with a null item or a null part of the group are left out. Groups with fewer items give what they
    have. Other columns of ``df`` are ignored, whatever their names.

    Equal items are combined before and after a shuffle on group and item, so no task ever holds a whole group. The
    rank filter lets the optimiser put a group limit before the last shuffle: at most n rows of a group leave a task.
    """
    keys = [*group, item]
    counted = df.select(*keys, F.col(score).cast("double").alias("score")).where(
        F.col("score").isNotNull() & ~F.isnan("score") & F.expr(" and ".join(f"`{k}` is not null" for k in keys))
    )
    best = counted.groupBy(*keys).agg(F.max("score").alias("score"))
    w = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc(item))
    return best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def p7_found(spark, sf_dir: str) -> DataFrame:
    best = top_n(table(spark, sf_dir, "neighbours"), ["query_id", "metric"], "id", "score", 5)
    return best.select("query_id", "metric", "id")


SQL = {
    "p7_found": """
select query_id, metric, id from (
  select query_id, metric, id, row_number() over (partition by query_id, metric order by s desc, id) as rn from (
    select query_id, metric, id, max(score) as s from neighbours
    where score is not null and not isnan(score) and query_id is not null and metric is not null and id is not null
    group by all))
where rn <= 5"""
}
