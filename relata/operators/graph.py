"""The category graph: vocabulary, rank costs, distances upward, distances up and then down, similarity by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import maths as M
from relata.functions.titles import canonical_category, present
from relata.operators.matrix import dense_ids
from relata.operators.postings import K, SEARCH_STEP
from relata.session import reliable, table

DAMPING, ROUNDS = 0.85, 20
#: Ways of up to 2 ** SQUARINGS steps are joined at a time.
SQUARINGS = 3
#: Rounds after which distances that still change are an error.
MAX_ROUNDS = 10_000

# --- fixed values: names of the categories nearest the root ------------------------------------------------------
TOP_LEVEL = (
    "Agriculture", "Applied Sciences", "Arts", "Belief", "Business", "Chronology", "Computers", "Culture", "Education",
    "Environment", "Geography", "Health", "History", "Humanities", "Language", "Law", "Life", "Mathematics", "Nature",
    "People", "Politics", "Science", "Society", "Concepts", "Matter",
)


def memberships(page_cat: DataFrame) -> DataFrame:
    """(id, cat) without repeats, null and blank categories left out."""
    rows = page_cat.select(F.col("page_id").alias("id"), canonical_category(F.col("cat")).alias("cat"))
    return rows.where(present(F.col("cat")) & F.col("id").isNotNull()).distinct()


def parents(cat_parent: DataFrame) -> DataFrame:
    """(child, parent) without repeats and loops of one."""
    rows = cat_parent.select(canonical_category(F.col("child")).alias("child"), canonical_category(F.col("parent")).alias("parent"))
    return rows.where(present(F.col("child")) & present(F.col("parent")) & (F.col("child") != F.col("parent"))).distinct()


def vocabulary(up: DataFrame, member: DataFrame) -> DataFrame:
    """(cat, pages): every category named anywhere, with the number of its pages."""
    named = up.select(F.explode(F.array("child", "parent")).alias("cat"), F.lit(0).alias("one")).unionByName(member.select("cat", F.lit(1).alias("one")))
    return named.groupBy("cat").agg(F.sum("one").alias("pages"))


def rank_costs(cats: DataFrame, up: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(cat, cost): cost is 1 / -ln(rank). Rank flows from child to parent in equal parts; what has no parent keeps none.

    Ranks begin in proportion to 1 + the number of pages. A parent with millions of children is summed within tasks
    before the shuffle. Lineage is cut every fifth round.
    """
    total = cats.agg(F.count(F.lit(1)).alias("v"), F.sum("pages").alias("p"))
    start = reliable(cats.join(F.broadcast(total)).select("cat", ((1 + F.col("pages")) / (F.col("v") + F.col("p"))).alias("rank"), ((1 - damping) / F.col("v")).alias("base")))
    ways = up.groupBy("child").agg(F.count(F.lit(1)).alias("ways"))
    flow = reliable(up.join(ways, "child").select(F.col("child").alias("cat"), "parent", (F.lit(damping) / F.col("ways")).alias("share")))
    ranks, base = start.select("cat", "rank"), start.select("cat", F.col("base").alias("given"))
    for turn in range(1, rounds + 1):
        given = flow.join(ranks, "cat").select(F.col("parent").alias("cat"), (F.col("rank") * F.col("share")).alias("given"))
        # What a category has of its own is one more gift, so that a round is one join and one aggregate.
        ranks = given.unionByName(base).groupBy("cat").agg(F.sum("given").alias("rank"))
        if turn % 5 == 0:
            ranks = reliable(ranks)
    return ranks.select("cat", (1 / -F.log("rank")).alias("cost"))


def steps_up(up: DataFrame, costs: DataFrame, squarings: int = SQUARINGS) -> DataFrame:
    """(cat, top, d): the cheapest ways up of at most 2 ** squarings steps, by the costs of the categories entered.

    A bounded number of steps keeps this table near the size of the hierarchy, whatever its depth and its loops.
    """
    one = up.join(costs.select(F.col("cat").alias("parent"), "cost"), "parent")
    ways = one.select(F.col("child").alias("cat"), F.col("parent").alias("top"), F.col("cost").alias("d"))
    for _ in range(squarings):
        ways = reliable(ways)
        further = ways.select("cat", F.col("top").alias("mid"), "d").join(ways.select(F.col("cat").alias("mid"), "top", F.col("d").alias("e")), "mid")
        both = ways.unionByName(further.select("cat", "top", (F.col("d") + F.col("e")).alias("d")))
        ways = both.where("cat <> top").groupBy("cat", "top").agg(F.min("d").alias("d"))
    return reliable(ways)


def up_distances(member: DataFrame, costs: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, top, d): the distance from each page of ``member`` (id, cat) to each category above it.

    It is the least sum of the costs of the categories entered, the page's own category too. Only what the asked pages
    reach is held: what became cheaper in a round is all that goes on in the next one. Costs are positive, so loops
    end. It is an error if distances still change after MAX_ROUNDS rounds.
    """
    best = reliable(member.join(costs, "cat").groupBy("id", F.col("cat").alias("top")).agg(F.min("cost").alias("d")))
    edge = best
    for _ in range(MAX_ROUNDS):
        further = edge.withColumnRenamed("top", "cat").join(steps.withColumnRenamed("d", "e"), "cat")
        found = further.groupBy("id", "top").agg(F.min(F.col("d") + F.col("e")).alias("d"))
        edge = reliable(_cheaper(found, best, ["id", "top"]))
        if not edge.limit(1).count():
            return best
        best = reliable(best.unionByName(edge).groupBy("id", "top").agg(F.min("d").alias("d")))
    raise RuntimeError("distances didn't settle")


def _cheaper(found: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``found`` that are new or cheaper by more than what the order of a sum changes."""
    known = best.select(*keys, F.col("d").alias("was"))
    return found.join(known, keys, "left").where(F.col("was").isNull() | (F.col("d") < F.col("was") - 1e-12)).drop("was")


def pair_distances(pairs: DataFrame, pages: DataFrame, costs: DataFrame) -> DataFrame:
    """(id1, id2, distance): cheapest way through a shared category above both; infinite if there is none, 0 for equal ids."""
    a = pages.select(F.col("id").alias("id1"), "top", F.col("d").alias("da"))
    b = pages.select(F.col("id").alias("id2"), "top", F.col("d").alias("db"))
    met = pairs.join(a, "id1").join(b, ["id2", "top"]).join(costs.withColumnRenamed("cat", "top"), "top")
    best = met.groupBy("id1", "id2").agg(F.min(F.col("da") + F.col("db") - F.col("cost")).alias("distance"))
    out = pairs.join(best, ["id1", "id2"], "left")
    return out.select("id1", "id2", F.when(F.col("id1") == F.col("id2"), 0.0).otherwise(F.coalesce("distance", F.lit(float("inf")))).alias("distance"))


def most_similar_pages(asked: DataFrame, member: DataFrame, costs: DataFrame, up: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): the k pages nearest to each asked page, going up and then down, never up again.

    A search from all asked pages at once, step by step. Its state is the categories each query has met, on the way up
    or down. As soon as a query has met k pages, nothing farther than the k-th of them goes on. All pages of a category
    are equally far, so of each category only the k + 1 least ids can be among the k nearest: no category, however
    large, brings more rows to a query. The asked page itself is at distance 0.
    """
    w = Window.partitionBy("cat").orderBy("id")
    few = reliable(member.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1).drop("rn"))
    price = costs.select("cat", "cost")
    ways = reliable(
        up.join(price, up["parent"] == price["cat"]).select(F.col("child").alias("at"), F.col("parent").alias("cat"), F.col("cost").alias("e"), F.lit(False).alias("down"))
        .unionByName(up.join(price, up["child"] == price["cat"]).select(F.col("parent").alias("at"), F.col("child").alias("cat"), F.col("cost").alias("e"), F.lit(True).alias("down")))
    )
    mine = member.join(asked.select(F.col("query_id").alias("id")), "id", "left_semi").join(price, "cat")
    best = reliable(mine.groupBy(F.col("id").alias("query_id"), "cat").agg(F.min("cost").alias("d")).withColumn("down", F.lit(False)))
    edge, keys = best, ["query_id", "cat", "down"]

    def met(states: DataFrame) -> DataFrame:
        nearest = states.groupBy("query_id", "cat").agg(F.min("d").alias("d"))
        return nearest.join(few, "cat").where("id <> query_id").groupBy("query_id", "id").agg(F.min("d").alias("distance"))

    for _ in range(MAX_ROUNDS):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance"))
        far = met(best).withColumn("rn", rank).where(F.col("rn") == k).select("query_id", F.col("distance").alias("far"))
        here = edge.select("query_id", F.col("cat").alias("at"), "d", F.col("down").alias("fell"))
        found = here.join(ways, "at").where("down or not fell").groupBy(*keys).agg(F.min(F.col("d") + F.col("e")).alias("d"))
        near = found.join(far, "query_id", "left").where(F.col("far").isNull() | (F.col("d") <= F.col("far") + 1e-9)).drop("far")
        # What was met as cheaply on the way up may go anywhere that it may on the way down.
        risen = best.where("not down").select("query_id", "cat", F.col("d").alias("rose"))
        free = near.join(risen, ["query_id", "cat"], "left").where(~F.col("down") | F.col("rose").isNull() | (F.col("d") < F.col("rose") - 1e-12)).drop("rose")
        edge = reliable(_cheaper(free, best, keys).select(*best.columns))
        if not edge.limit(1).count():
            break
        best = reliable(best.unionByName(edge).groupBy(*keys).agg(F.min("d").alias("d")))
    else:
        raise RuntimeError("distances didn't settle")
    own = asked.select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("distance"))
    last = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return met(best).select("query_id", "id", "distance").unionByName(own).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


# --- queries ------------------------------------------------------------------------------------------------------
def _graph(spark, d):
    member, up = memberships(table(spark, d, "page_cat")), parents(table(spark, d, "cat_parent"))
    return member, up, vocabulary(up, member)


def _costs(spark, d):
    member, up, cats = _graph(spark, d)
    return member, up, reliable(rank_costs(cats, up))


def q_category_vocabulary(spark, d):
    member, up, cats = _graph(spark, d)
    top = [c.lower() for c in TOP_LEVEL]
    ways = up.groupBy(F.col("child").alias("cat")).agg(F.count(F.lit(1)).alias("parents"))
    kids = up.groupBy(F.col("parent").alias("cat")).agg(F.count(F.lit(1)).alias("children"))
    joined = cats.join(ways, "cat", "left").join(kids, "cat", "left").na.fill(0, ["parents", "children"])
    useful = (F.col("parents") > 0) | (F.col("children") > 0) | (F.col("pages") > 1)
    return joined.select("cat", F.col("pages").cast("bigint").alias("pages"), "parents", "children", useful.alias("useful"), F.col("cat").isin(top).alias("is_top"))


def q_category_cost(spark, d):
    return _costs(spark, d)[2].select("cat", F.round("cost", 6).alias("cost"))


def _asked(member: DataFrame) -> DataFrame:
    return member.where(F.col("id") % SEARCH_STEP == 0)


def q_category_up_distance(spark, d):
    """Every category above each fiftieth page."""
    member, up, costs = _costs(spark, d)
    return up_distances(_asked(member), costs, steps_up(up, costs)).select("id", "top", F.round("d", 6).alias("d"))


def known_or_zero(scored: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with an id that no page has score 0, other than pairs of equal ids."""
    for c in ("id1", "id2"):
        scored = scored.join(ids.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}")), c, "left")
    known = F.col("has_id1").isNotNull() & F.col("has_id2").isNotNull()
    return scored.select("id1", "id2", F.when(known | (F.col("id1") == F.col("id2")), F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def q_category_similarity(spark, d):
    member, up, costs = _costs(spark, d)
    pairs = table(spark, d, "gold").where("id1 is not null and id2 is not null").select("id1", "id2").distinct()
    wanted = pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    pages = up_distances(member.join(wanted, "id", "left_semi"), costs, steps_up(up, costs))
    least = costs.agg(F.min("cost").alias("least"))
    scored = pair_distances(pairs, pages, costs).join(F.broadcast(least))
    rated = scored.select("id1", "id2", F.round(M.distance_score(F.col("distance"), F.col("least")), 5).alias("score"))
    return known_or_zero(rated, table(spark, d, "pages").select("id").where("id is not null").distinct())


def q_category_most_similar(spark, d):
    member, up, costs = _costs(spark, d)
    asked = _asked(member).select(F.col("id").alias("query_id")).distinct()
    return most_similar_pages(asked, member, costs, up, K).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def category_dump(member: DataFrame, up: DataFrame, costs: DataFrame) -> dict[str, DataFrame]:
    """What a dump of the graph holds: links (cat, parent), ranked (place, cat, cost, pages), cheapest last, members (id, cat).

    Places come from a range partitioning, so no task ranks all categories.
    """
    pages = vocabulary(up, member)
    ordered = costs.join(pages, "cat").withColumn("by", F.struct("cost", "cat"))
    places = dense_ids(ordered, "by").select(F.col("by.cat").alias("cat"), (F.col("dense_id") + 1).alias("place"))
    return {"links": up.select(F.col("child").alias("cat"), "parent"), "ranked": costs.join(pages, "cat").join(places, "cat").select("place", "cat", "cost", "pages"), "members": member}


def q_category_dump(spark, d):
    """The dump's three parts as lines: what kind, then its columns."""
    member, up, costs = _costs(spark, d)
    parts = category_dump(member, up, reliable(costs.select("cat", F.round("cost", 6).alias("cost"))))
    ranked = parts["ranked"].select(F.lit("ranked").alias("part"), F.col("cat").alias("a"), F.concat_ws(" ", "place", "pages").alias("b"))
    links = parts["links"].select(F.lit("links").alias("part"), F.col("cat").alias("a"), F.col("parent").alias("b"))
    return ranked.unionByName(links).unionByName(parts["members"].select(F.lit("members").alias("part"), F.col("cat").alias("a"), F.col("id").cast("string").alias("b")))


def q_set_operations(spark, d):
    """Categories of judged pairs: how many they share, have together, and the first has alone."""
    sets = memberships(table(spark, d, "page_cat")).groupBy("id").agg(F.collect_set("cat").alias("s"))
    pairs = table(spark, d, "gold").where("id1 is not null and id2 is not null").select("id1", "id2").distinct()
    a, b = sets.select(F.col("id").alias("id1"), F.col("s").alias("a")), sets.select(F.col("id").alias("id2"), F.col("s").alias("b"))
    both = pairs.join(a, "id1").join(b, "id2")
    return both.select(
        "id1", "id2", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("together"),
        F.size(F.array_except("a", "b")).alias("first_only"), F.size(F.concat("a", "b")).alias("bag"),
    )


def q_unvisited(spark, d):
    """Categories of pages that no link of the hierarchy names: an anti join."""
    member, up, _ = _graph(spark, d)
    return member.select("cat").distinct().join(up.select(F.explode(F.array("child", "parent")).alias("cat")).distinct(), "cat", "left_anti")


QUERIES = {
    "category_vocabulary": q_category_vocabulary, "category_pagerank_cost": q_category_cost, "category_up_distance": q_category_up_distance,
    "category_dump": q_category_dump, "category_similarity": q_category_similarity, "category_most_similar": q_category_most_similar, "unvisited_anti_join": q_unvisited,
    "set_operations": q_set_operations,
}

_CAT = "trim(regexp_replace(lower(trim(regexp_replace({0}, '[\\s_\\x{{a0}}]+', ' ', 'g'))), '^category ?: ?', ''))"
_GRAPH = f"""with recursive member as (select distinct page_id as id, {_CAT.format('cat')} as cat from page_cat where {_CAT.format('cat')} <> '' and page_id is not null),
up as (select distinct child, parent from (select {_CAT.format('child')} as child, {_CAT.format('parent')} as parent from cat_parent) where child <> '' and parent <> '' and child <> parent),
cats as (select cat, cast(sum(one) as bigint) as pages from (select child as cat, 0 as one from up union all select parent, 0 from up union all select cat, 1 from member) group by 1),
ways as (select child, count(*) as ways from up group by 1), num as (select count(*) as v, sum(pages) as p from cats),
r0 as (select cat, (1 + pages) / (v + p) as rank from cats, num)"""
_RANKS = _GRAPH + "".join(
    f""", r{i} as materialized (select c.cat, {1 - DAMPING} / v + {DAMPING} * coalesce(g, 0) as rank from num, cats c left join
  (select parent as cat, sum(rank / ways) as g from up join ways using (child) join r{i - 1} on cat = child group by 1) x using (cat))"""
    for i in range(1, ROUNDS + 1)
) + f", costs as materialized (select cat, 1 / -ln(rank) as cost from r{ROUNDS})"
_UP = f"""{_RANKS}, climb as (select cat, cat as top, 0.0::double as d, [cat] as seen from costs
  union all select k.cat, u.parent, k.d + c.cost, list_append(k.seen, u.parent) from climb k join up u on u.child = k.top join costs c on c.cat = u.parent where not list_contains(k.seen, u.parent)),
dist as (select cat, top, min(d) as d from climb group by all)"""
_PAGES = "pup as (select m.id, t.top, min(c.cost + t.d) as d from member m join costs c using (cat) join dist t using (cat) group by all)"
SQL = {
    "category_vocabulary": f"""{_GRAPH} select cat, pages, coalesce(a.n, 0) as parents, coalesce(b.n, 0) as children, coalesce(a.n, 0) > 0 or coalesce(b.n, 0) > 0 or pages > 1 as useful,
      cat in ({', '.join(repr(c.lower()) for c in TOP_LEVEL)}) as is_top
      from cats left join (select child as cat, count(*) as n from up group by 1) a using (cat) left join (select parent as cat, count(*) as n from up group by 1) b using (cat)""",
    "category_pagerank_cost": f"{_RANKS} select cat, round(cost, 6) as cost from costs",
    "category_up_distance": f"{_UP}, {_PAGES} select id, top, round(d, 6) as d from pup where id % 50 = 0",
    "category_dump": f"""{_RANKS}, rc as (select cat, round(cost, 6) as cost, pages from costs join cats using (cat))
      select 'ranked' as part, cat as a, (row_number() over (order by cost, cat)) || ' ' || pages as b from rc union all select 'links', child, parent from up union all select 'members', cat, id || '' from member""",
    "category_similarity": f"""{_UP}, {_PAGES}, pairs as (select distinct id1, id2 from gold where id1 is not null and id2 is not null),
      met as (select id1, id2, min(a.d + b.d - c.cost) as distance from pairs join pup a on a.id = id1 join pup b on b.id = id2 and a.top = b.top join costs c on c.cat = a.top group by all)
      select id1, id2, case when id1 <> id2 and not (id1 in (select id from pages where id is not null) and id2 in (select id from pages where id is not null)) then 0.0
        when distance is null and id1 <> id2 then '-inf'::double else round(ln(greatest(case when id1 = id2 then 0 else distance end, least)) / ln(least), 5) end as score
      from pairs left join met using (id1, id2), (select min(cost) as least from costs)""",
    "category_most_similar": f"""{_UP}, {_PAGES}, down as (select t.cat, t.top, case when t.cat = t.top then 0 else t.d - a.cost + b.cost end as down from dist t join costs a on a.cat = t.top join costs b on b.cat = t.cat),
      reached as (select p.id as query_id, m.id, min(p.d + w.down) as distance from pup p join down w using (top) join member m on m.cat = w.cat where p.id % 50 = 0 and m.id <> p.id group by all
        union all select distinct id, id, 0 from member where id % 50 = 0)
      select query_id, id, round(distance, 6) as distance, cast(rn as int) as rank from (select *, row_number() over (partition by query_id order by round(distance, 9), id) as rn from reached) where rn <= 10""",
    "set_operations": f"""{_GRAPH}, st as (select id, list(cat) as s from member group by 1), pairs as (select distinct id1, id2 from gold where id1 is not null and id2 is not null)
      select id1, id2, cast(len(list_intersect(a.s, b.s)) as int) as shared, cast(len(list_distinct(list_concat(a.s, b.s))) as int) as together,
        cast(len(a.s) - len(list_intersect(a.s, b.s)) as int) as first_only, cast(len(a.s) + len(b.s) as int) as bag from pairs join st a on a.id = id1 join st b on b.id = id2""",
    "unvisited_anti_join": f"{_GRAPH} select distinct cat from member where cat not in (select child from up union select parent from up)",
}
