"""Full hierarchies from parent-child links by parallel tree contraction (problem 5).

Every round rakes the leaves and splices a random, independent part of the nodes that have one child out of their
chains, those with the least number of the round among their neighbours, so that the number of rounds grows with the
logarithm of the nodes, whatever the depth. Each removed node is recorded with the node it hung from. What can't be
contracted any more is a root, or a loop shrunk to one node that is its own parent. The records are then followed
together, twice as far each time, and give every node its root, depth and path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.functions.titles import canonical_category, present
from relata.session import reliable, table

#: More rounds than any forest of practical size needs; reached only if something is wrong.
MAX_ROUNDS = 400
#: Records lead on to later rounds only, so this many doublings are more than MAX_ROUNDS can need.
MAX_DOUBLINGS = 12


def parent_links(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, parent): one row per node; parent is NULL for those that have none.

    A row whose child or parent is NULL or '' links nothing, but its other end is a node. Repeated rows count once.
    Of several parents of one node the alphabetically first is taken.
    """
    ends = links.select(
        F.explode(
            F.array(
                F.struct(F.col(child).alias("node"), F.when(present(F.col(parent)), F.col(parent)).alias("parent")),
                F.struct(F.col(parent).alias("node"), F.lit(None).cast("string").alias("parent")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.where(present(F.col("node"))).groupBy("node").agg(F.min("parent").alias("parent"))


def _priority(column: str, turn: int):
    return F.xxhash64(F.col(column), F.lit(turn))


def _recovered(records: DataFrame, top: DataFrame, with_path: bool) -> DataFrame:
    """(node, root, depth[, path]) of the removed nodes, from their records (node, parent, steps[, via]).

    A record's parent was removed later, or is one of ``top``. Following records twice as far each time, all are held
    against ``top`` after a number of joins that grows with the logarithm of the rounds.
    """
    ways = records
    for _ in range(MAX_DOUBLINGS):
        on = ways.select(
            F.col("node").alias("parent"), F.col("parent").alias("up"), F.col("steps").alias("more"), *([F.concat("via", F.array("node")).alias("between")] if with_path else [])
        )
        hit = F.col("up").isNotNull()
        further = ways.join(on, "parent", "left").select(
            "node", F.coalesce("up", "parent").alias("parent"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            *([F.when(hit, F.concat("between", "via")).otherwise(F.col("via")).alias("via")] if with_path else []), hit.alias("moved"),
        )
        further = reliable(further)
        moved = further.where("moved").limit(1).count()
        ways = further.drop("moved")
        if not moved:
            break
    else:
        raise RuntimeError("the records don't end")
    above = top.select(F.col("node").alias("parent"), "root", F.col("depth").alias("up_depth"), *[F.col("path").alias("up_path")] * with_path)
    return ways.join(above, "parent").select(
        "node", "root", F.when(F.col("up_depth") < 0, F.lit(-1)).otherwise(F.col("up_depth") + F.col("steps")).cast("bigint").alias("depth"),
        *([F.concat("up_path", "via", F.array("node")).alias("path")] if with_path else []),
    )


def hierarchy(nodes: DataFrame, with_path: bool = False, through_loops: bool = False) -> DataFrame:
    """(node, root, depth[, path]) of each node of ``nodes`` (node, parent), at most one row a node.

    depth is the number of links to the root, 0 for the root itself. If the way up ends in a loop, root is the least
    node of that loop, depth is -1 and path is NULL. path lists the nodes from the root to the node itself. An empty
    table gives an empty result.

    With ``through_loops`` there is a path below and inside loops too: the way up is followed once round the loop, so
    that path starts below the node that would come a second time and holds each node once.
    """
    with_path = with_path or through_loops
    columns = ["node", "parent", "steps", "least"] + ["via"] * with_path
    active = nodes.select(
        "node", "parent", F.lit(1).cast("bigint").alias("steps"), F.col("node").alias("least"),
        *[F.array().cast("array<string>").alias("via")] * with_path,
    )
    records: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        kids = (
            active.where("parent is not null")
            .groupBy(F.col("parent").alias("node"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("only"))
        )
        inner = F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))
        lowest = (_priority("node", turn) < _priority("parent", turn)) & (_priority("node", turn) < _priority("only", turn))
        act = F.when(inner & F.col("n").isNull(), "rake").when(inner & (F.col("n") == 1) & lowest, "splice")
        state = reliable(active.join(kids, "node", "left").withColumn("act", act).drop("n"))
        tally = state.agg(F.count(F.when(inner, 1)).alias("inner")).first()
        if not tally["inner"]:
            active = state.select(*columns)
            break
        records.append(state.where("act is not null").select("node", "parent", "steps", *["via"] * with_path))
        spliced = state.where("act = 'splice'").select(
            F.col("only").alias("node"), F.col("parent").alias("up"), F.col("steps").alias("more"), F.col("least").alias("low"),
            *([F.concat("via", F.array("node")).alias("between")] if with_path else []),
        )
        kept = state.where("act is null").select(*columns).join(spliced, "node", "left")
        hit = F.col("up").isNotNull()
        active = kept.select(
            "node",
            F.when(hit, F.col("up")).otherwise(F.col("parent")).alias("parent"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.least("least", "low").alias("least"),
            *([F.when(hit, F.concat("between", "via")).otherwise(F.col("via")).alias("via")] if with_path else []),
        )
    else:
        raise RuntimeError("the contraction didn't end")

    looped = F.col("parent").isNotNull()
    top = active.select(
        "node", F.when(looped, F.col("least")).otherwise(F.col("node")).alias("root"),
        F.when(looped, F.lit(-1)).otherwise(F.lit(0)).cast("bigint").alias("depth"),
        *([F.when(F.lit(through_loops) | ~looped, F.array("node")).alias("path")] if with_path else []),
    )
    parts = [top] + ([_recovered(reduce(DataFrame.unionByName, records), top, with_path)] if records else [])
    whole = reduce(DataFrame.unionByName, parts)
    if not through_loops:
        return whole
    # Paths start at the node a loop shrunk to; its other members that don't follow on the way down stand before it.
    loops = active.where(looped).select(F.col("least").alias("root"), F.concat(F.array("node"), "via").alias("loop"))
    before = F.when(F.col("depth") < 0, F.array_except("loop", "path")).otherwise(F.array().cast("array<string>"))
    return whole.join(loops, "root", "left").select("node", "root", "depth", F.concat(before, "path").alias("path"))


def descendants(paths: DataFrame) -> DataFrame:
    """(node, descendant, distance): every pair of a node and one below it, from the paths of :func:`hierarchy`.

    Nodes without a path take no part: those whose way up ends in a loop, unless paths go through loops. Inside a loop
    each node is then below every other one, at the number of links between them, but not below itself.
    """
    pairs = paths.where("path is not null").select(F.col("node").alias("descendant"), (F.size("path") - 1).alias("last"), F.posexplode("path").alias("at", "node"))
    return pairs.where(F.col("at") < F.col("last")).select("node", "descendant", (F.col("last") - F.col("at")).alias("distance"))


def _links(spark, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "cat_parent").select(
        canonical_category(F.col("child")).alias("child"), canonical_category(F.col("parent")).alias("parent")
    )
    return parent_links(links, "child", "parent")


def p5_found(spark, sf_dir: str) -> DataFrame:
    found = hierarchy(_links(spark, sf_dir))
    return found.select(F.col("node").alias("cat"), "root", F.col("depth").cast("int").alias("depth"))


def p5_paths(spark, sf_dir: str) -> DataFrame:
    """Path of each category from its root, ' > ' between the names; below and inside loops once round the loop."""
    found = hierarchy(_links(spark, sf_dir), through_loops=True)
    return found.select(F.col("node").alias("cat"), "root", F.col("depth").cast("int").alias("depth"), F.array_join("path", " > ").alias("path"))


def p5_descendants(spark, sf_dir: str) -> DataFrame:
    """Every pair of a category and one below it, those below and inside loops too."""
    found = descendants(hierarchy(_links(spark, sf_dir), through_loops=True))
    return found.select(F.col("node").alias("cat"), "descendant", F.col("distance").cast("int").alias("distance"))


_CAT = "trim(regexp_replace(lower(trim(regexp_replace({0}, '[\\s_\\x{{a0}}]+', ' ', 'g'))), '^category ?: ?', ''))"
_TREE = f"""
with recursive ends as (select {_CAT.format('child')} as c, {_CAT.format('parent')} as p from cat_parent),
nodes as (select c as node, min(nullif(p, '')) as parent from
  (select c, p from ends union all select p, null from ends) where c <> '' group by 1),
climb as (
  select node as cat, node as cur, [node] as seen, false as looped from nodes
  union all
  select k.cat, n.parent, list_append(k.seen, n.parent), list_contains(k.seen, n.parent)
  from climb k join nodes n on n.node = k.cur where n.parent is not null and not k.looped),
tops as (select k.cat, k.cur, k.seen from climb k join nodes n on n.node = k.cur where n.parent is null and not k.looped),
loops as (select cat, cur, seen from climb where looped)
"""
SQL = {
    "p5_found": _TREE + "select cat, cur as root, cast(len(seen) - 1 as int) as depth from tops union all"
    " select cat, list_min(seen[list_position(seen, cur):]), -1 from loops",
    "p5_paths": _TREE + "select cat, cur as root, cast(len(seen) - 1 as int) as depth, array_to_string(list_reverse(seen), ' > ') as path from tops"
    " union all select cat, list_min(seen[list_position(seen, cur):]), -1, array_to_string(list_reverse(seen[:len(seen) - 1]), ' > ') from loops",
    "p5_descendants": _TREE + "select seen[i + 1] as cat, cat as descendant, cast(i as int) as distance from"
    " (select cat, seen, unnest(range(1, len(seen))) as i from tops union all select cat, seen, unnest(range(1, len(seen) - 1)) from loops)",
}
