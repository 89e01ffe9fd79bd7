"""Ranks within groups without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.session import reliable


def distributed_ranks(df: DataFrame, keys: list[str], score: str, partitions: int | None = None, descending: bool = True, spread: list[str] | None = None) -> DataFrame:
    """``df`` with rank (1 for the first score, ties share their average) and size of its group.

    Scores must not be null. Rows are range-partitioned by group, score and the columns ``spread`` (all others if not
    given), so a large group and a large tie lie in several partitions, and ranked within each. A group, or a tie, that
    lies in several partitions gets what earlier ones hold added: there are at most two such groups and ties a
    partition, whatever the data, so only those are broadcast.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in df.columns if c not in (*keys, score)] if spread is None else spread
    first = F.desc(score) if descending else F.asc(score)
    ranged = reliable(df.repartitionByRange(n, *keys, first, *others).withColumn("_part", F.spark_partition_id()))
    by_group = Window.partitionBy(*keys)
    earlier = Window.unboundedPreceding, -1
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min(score).alias("_low"), F.max(score).alias("_high"))
    pieces = reliable(
        counts.select(
            *keys, "_part", "_low", "_high", F.sum("_rows").over(by_group).alias("_size"), F.count(F.lit(1)).over(by_group).alias("_pieces"),
            F.coalesce(F.sum("_rows").over(by_group.orderBy("_part").rowsBetween(*earlier)), F.lit(0)).alias("_before"),
        ).where("_pieces > 1")
    )
    # Ties over a border are the least or the greatest score of a group within a partition.
    edges = pieces.select(*keys, F.explode(F.array("_low", "_high")).alias(score)).distinct()
    at_edges = ranged.join(F.broadcast(edges), [*keys, score], "left_semi").groupBy(*keys, score, "_part").agg(F.count(F.lit(1)).alias("_same"))
    by_tie = Window.partitionBy(*keys, score)
    ties = at_edges.select(
        *keys, score, "_part", F.sum("_same").over(by_tie).alias("_all"), F.coalesce(F.sum("_same").over(by_tie.orderBy("_part").rowsBetween(*earlier)), F.lit(0)).alias("_passed")
    )
    local = Window.partitionBy(*keys, "_part")
    ranked = ranged.withColumns(
        {
            "_first": F.rank().over(local.orderBy(first)),
            "_ties": F.count(F.lit(1)).over(Window.partitionBy(*keys, "_part", score)),
            "_here": F.count(F.lit(1)).over(local),
        }
    )
    split = pieces.select(*keys, "_part", "_size", "_before")
    joined = ranked.join(F.broadcast(split), [*keys, "_part"], "left").join(F.broadcast(ties), [*keys, score, "_part"], "left")
    strictly = F.coalesce("_before", F.lit(0)) + F.col("_first") - F.coalesce("_passed", F.lit(0))
    return joined.select(*df.columns, (strictly + (F.coalesce("_all", "_ties") - 1) / 2).alias("rank"), F.coalesce("_size", "_here").alias("size"))
