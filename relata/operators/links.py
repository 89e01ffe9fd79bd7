"""The link graph: resolved edges, in-links, set-overlap measures of pairs of pages, anchor texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import text as T
from relata.functions.titles import canonical_title, present
from relata.operators import postings as P
from relata.operators.corpus import _TYPE, CUR_SQL, current_pages, title_ids, with_type
from relata.session import table

MIN_INLINKS = 3
LIST_PART = 1_000


def named_edges(links: DataFrame) -> DataFrame:
    """(src, title) without repeats; null, blank and image targets are no links."""
    named = links.select(F.col("src_id").alias("src"), canonical_title(F.col("target_title")).alias("title"))
    return named.where(present(F.col("title")) & ~F.contains("title", F.lit(T.IMAGE)) & F.col("src").isNotNull()).distinct()


def edges(links: DataFrame, titles: DataFrame) -> DataFrame:
    """(src, dst) without repeats: link titles resolved to page ids by an inner join, unresolved ones dropped."""
    return named_edges(links).join(titles, "title").select("src", F.col("id").alias("dst")).distinct()


def inlink_counts(edge: DataFrame) -> DataFrame:
    return edge.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("ninlinks"))


def link_overlap(pairs: DataFrame, sets: DataFrame, pages: DataFrame, min_df: int = 0) -> DataFrame:
    """For each pair (id1, id2): sizes and weighted sums over the two sets of ``sets`` (id, link) and what they share,
    and whether both are among ``pages`` (id), each once.

    The link's document frequency is joined once to the sets of the pages asked for, so hub links are rows of those
    pages only.
    """
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    df = sets.groupBy("link").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    wanted = pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    own = sets.join(wanted, "id", "left_semi").join(df, "link").join(F.broadcast(n)).withColumns(
        {"idf2": 1 / F.greatest(F.lit(2.0), F.col("df").cast("double")), "info": F.log(F.col("df") / F.col("n"))}
    )
    sizes = own.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.sum("idf2").alias("idf2"))
    a = own.select(F.col("id").alias("id1"), "link", "idf2", "info")
    b = own.select(F.col("id").alias("id2"), "link")
    shared = pairs.join(a, "id1").join(b, ["id2", "link"]).groupBy("id1", "id2").agg(
        F.count(F.lit(1)).alias("both"), F.sum("idf2").alias("both_idf2"), F.sum("info").alias("both_info")
    )
    sa = sizes.select(F.col("id").alias("id1"), F.col("size").alias("na"), F.col("idf2").alias("ia"))
    sb = sizes.select(F.col("id").alias("id2"), F.col("size").alias("nb"), F.col("idf2").alias("ib"))
    joined = pairs.join(shared, ["id1", "id2"], "left").join(sa, "id1", "left").join(sb, "id2", "left").join(F.broadcast(n))
    for c in ("id1", "id2"):
        joined = joined.join(pages.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}")), c, "left")
    joined = joined.withColumn("known", F.col("has_id1").isNotNull() & F.col("has_id2").isNotNull()).drop("has_id1", "has_id2")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("both", "na", "nb")}
    return joined.withColumns(zero)


def _scored(value: Column) -> Column:
    """0 for pairs that share nothing, NULL if an id is no page's."""
    return F.when(~F.col("known"), None).when(F.col("both") == 0, 0.0).otherwise(F.round(value, 6))


def jaccard() -> Column:
    return _scored(F.col("both") / (F.col("na") + F.col("nb") - F.col("both") + 1))


def google(sigmoid: bool = True) -> Column:
    big, small = F.greatest("na", "nb"), F.least("na", "nb")
    spread = F.log("n") - F.log(small)
    d = F.when(spread > 0, (F.log(big) - F.log("both")) / spread).otherwise(F.lit(0.0))
    if sigmoid:
        d = F.when(d > 0.5, 1 / (1 + F.exp(-10 * (d - 0.5)))).otherwise(d)
    return _scored(1 - d)


def tfidf() -> Column:
    return _scored((10 + F.log(F.col("both_idf2") / F.sqrt(F.col("ia") * F.col("ib")))) / 10)


def log_odds() -> Column:
    v = F.col("both") * (F.log(1 / F.col("na")) + F.log(1 / F.col("nb"))) - 2 * F.col("both_info")
    return _scored(F.when(v > -1, F.least(F.lit(1.0), F.log(1 + v) / 7)))


# --- queries ------------------------------------------------------------------------------------------------------
def _edges(spark, d):
    return edges(table(spark, d, "links"), title_ids(table(spark, d, "pages")))


def page_ids(spark, d):
    return table(spark, d, "pages").select("id").where("id is not null").distinct()


def q_link_edges(spark, d):
    return _edges(spark, d)


def q_inlink_counts(spark, d):
    pages = table(spark, d, "pages").select("id").where("id is not null").distinct()
    return pages.join(inlink_counts(_edges(spark, d)), "id", "left").select("id", F.coalesce("ninlinks", F.lit(0)).alias("ninlinks"))


def q_inlink_lists(spark, d):
    """In-link lists as texts, in parts of the linking ids from LIST_PART * part on: at most LIST_PART ids in a row."""
    part = F.floor(F.col("src") / LIST_PART)
    lists = _edges(spark, d).groupBy(F.col("dst").alias("id"), part.alias("part")).agg(F.array_sort(F.collect_list("src")).alias("l"))
    return lists.select("id", "part", F.array_join(F.col("l").cast("array<string>"), ",").alias("inlinks"))


def q_minlinks_prune(spark, d):
    return q_inlink_counts(spark, d).where(F.col("ninlinks") >= MIN_INLINKS).select("id")


def q_link_neighbours(spark, d):
    """Out-links in first-seen order that exist as pages."""
    links = table(spark, d, "links").select("src_id", "pos", canonical_title(F.col("target_title")).alias("title"))
    first = links.where(present(F.col("title")) & ~F.contains("title", F.lit(T.IMAGE))).join(title_ids(table(spark, d, "pages")), "title")
    seen = first.groupBy("src_id", F.col("id").alias("dst")).agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("src_id").orderBy("pos", "dst")
    return seen.select("src_id", "dst", F.row_number().over(w).alias("place"))


def q_inbound_text(spark, d):
    """Anchor texts that point to a page, the most frequent first; appended to the page's text by an index."""
    links = table(spark, d, "links").select(canonical_title(F.col("target_title")).alias("title"), T.normalize_phrase(F.col("anchor")).alias("anchor"))
    named = links.where(present(F.col("title")) & present(F.col("anchor"))).join(title_ids(table(spark, d, "pages")), "title")
    return named.groupBy("id", "anchor").agg(F.count(F.lit(1)).alias("n"))


def _overlap(spark, d):
    e = _edges(spark, d)
    return link_overlap(P.gold_pairs(spark, d), e.select(F.col("src").alias("id"), F.col("dst").alias("link")), page_ids(spark, d))


def _measure(make):
    return lambda spark, d: _overlap(spark, d).select("id1", "id2", make().alias("score"))


def q_link_milne_witten(spark, d):
    e = _edges(spark, d)
    sets = e.select(F.col("dst").alias("id"), F.col("src").alias("link"))
    return link_overlap(P.gold_pairs(spark, d), sets, page_ids(spark, d), min_df=3).select("id1", "id2", google(sigmoid=False).alias("score"))


def q_link_most_similar(spark, d):
    """Most similar by shared out-links, each weighing ln(N / df): every fiftieth page against all."""
    index = _edges(spark, d).select(F.col("dst").alias("term"), F.col("src").alias("id"), F.lit(1).cast("bigint").alias("tf"))
    stats = P.with_size(P.term_stats(index), table(spark, d, "pages").select("id").where("id is not null").distinct())
    rule = P.TermRule(min_tf=1, max_percent=20.0)
    asked = P.select_terms(index.where(F.col("id") % P.SEARCH_STEP == 0), stats, rule).withColumnRenamed("id", "query_id")
    return P.top_k(P.matches(asked, index, stats), P.K)


def q_index_build(spark, d):
    """The main index: projected, filtered, with in-link counts and boost, in one plan instead of three passes."""
    cur = with_type(current_pages(table(spark, d, "pages")).where("ns = 0")).where("type = 'normal'").select("id", "title", "type")
    counted = cur.join(inlink_counts(_edges(spark, d)), "id", "left").withColumn("ninlinks", F.coalesce("ninlinks", F.lit(0)))
    boost = F.pow(F.log1p(F.log1p(F.col("ninlinks").cast("double"))), F.lit(0.5))
    return counted.where(F.col("ninlinks") >= MIN_INLINKS).withColumn("boost", F.round(boost, 6))


QUERIES = {
    "link_edges": q_link_edges, "inlink_counts": q_inlink_counts, "inlink_lists": q_inlink_lists, "minlinks_prune": q_minlinks_prune,
    "link_neighbours": q_link_neighbours, "inbound_text": q_inbound_text, "link_jaccard": _measure(jaccard), "link_google": _measure(google),
    "link_tfidf": _measure(tfidf), "link_logodds": _measure(log_odds), "link_milne_witten": q_link_milne_witten,
    "link_most_similar": q_link_most_similar, "index_build": q_index_build,
}

_CANON = "trim(regexp_replace(split_part({0}, '#', 1), '[\\s_\\x{{a0}}]+', ' ', 'g'))"
EDGES_SQL = f"""with {CUR_SQL}, titles as (select {_CANON.format('title')} as title, min(id) as id from cur where {_CANON.format('title')} <> '' group by 1),
named as (select src_id, pos, anchor, {_CANON.format('target_title')} as title from links where not contains({_CANON.format('target_title')}, 'Image:')),
e as (select distinct src_id as src, id as dst from named join titles using (title) where src_id is not null),
ids as (select distinct id from pages where id is not null), inl as (select i.id, count(dst) as ninlinks from ids i left join e on dst = id group by 1)"""


def _pairs_sql(sets: str, min_df: int, score: str) -> str:
    return f"""{EDGES_SQL}, sets as ({sets}), pairs as (select distinct id1, id2 from gold where id1 is not null and id2 is not null),
freq as (select link, count(*) as df from sets group by 1 having count(*) >= {min_df}), num as (select count(*) as n from ids),
own as (select id, link, 1.0 / greatest(2.0, df) as idf2, ln(df / n) as info from sets join freq using (link), num),
siz as (select id, count(*) as size, sum(idf2) as idf2 from own group by 1),
sh as (select id1, id2, count(*) as both_n, sum(a.idf2) as both_idf2, sum(a.info) as both_info from pairs join own a on a.id = id1 join own b on b.id = id2 and b.link = a.link group by all),
o as (select id1, id2, coalesce(both_n, 0) as i, both_idf2, both_info, coalesce(x.size, 0) as na, coalesce(y.size, 0) as nb, x.idf2 as ia, y.idf2 as ib, n
  from pairs left join sh using (id1, id2) left join siz x on x.id = id1 left join siz y on y.id = id2, num),
d as (select *, case when i > 0 and na > 0 and nb > 0 and ln(n) - ln(least(na, nb)) > 0 then (ln(greatest(na, nb)) - ln(i)) / (ln(n) - ln(least(na, nb))) else 0 end as dist from o)
select id1, id2, case when not (id1 in (select id from ids) and id2 in (select id from ids)) then null when i = 0 then 0.0 else round({score}, 6) end as score from d"""


_OUT, _IN = "select src as id, dst as link from e", "select dst as id, src as link from e"
_LOGODDS = "i * (ln(1.0 / na) + ln(1.0 / nb)) - 2 * both_info"
SQL = {
    "link_edges": f"{EDGES_SQL} select src, dst from e",
    "inlink_counts": f"{EDGES_SQL} select id, ninlinks from inl",
    "inlink_lists": f"{EDGES_SQL} select dst as id, cast(floor(src / {LIST_PART}) as bigint) as part, string_agg(cast(src as varchar), ',' order by src) as inlinks from e group by all",
    "minlinks_prune": f"{EDGES_SQL} select id from inl where ninlinks >= {MIN_INLINKS}",
    "link_neighbours": f"""{EDGES_SQL} select src_id, dst, cast(row_number() over (partition by src_id order by pos, dst) as int) as place from
      (select src_id, id as dst, min(pos) as pos from named join titles using (title) group by all)""",
    "inbound_text": rf"""{EDGES_SQL} select id, anchor, count(*) as n from (select id, trim(lower(regexp_replace(anchor, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) as anchor
      from (select anchor, {_CANON.format('target_title')} as title from links) join titles using (title)) where anchor <> '' group by all""",
    "link_jaccard": _pairs_sql(_OUT, 0, "i / (na + nb - i + 1)"),
    "link_google": _pairs_sql(_OUT, 0, "1 - case when dist > 0.5 then 1 / (1 + exp(-10 * (dist - 0.5))) else dist end"),
    "link_tfidf": _pairs_sql(_OUT, 0, "(10 + ln(both_idf2 / sqrt(ia * ib))) / 10"),
    "link_logodds": _pairs_sql(_OUT, 0, f"case when {_LOGODDS} > -1 then least(1.0, ln(1 + {_LOGODDS}) / 7) end"),
    "link_milne_witten": _pairs_sql(_IN, 3, "1 - dist"),
    "link_most_similar": f"""{EDGES_SQL}, post as (select dst as term, src as id from e), stats as (select term, count(*) as df, (select count(*) from ids) as n from post group by 1),
      w as (select id, term, df, n, ln(n / df) as w from post join stats using (term)), len as (select id, sqrt(sum(w * w)) as len from w group by 1),
      asked as (select id as query_id, term, w from (select *, row_number() over (partition by id order by round(1 + ln(n / (df + 1)), 6) desc, term) as rn from w
        where id % 50 = 0 and df >= 2 and df <= floor(n * 20.0 / 100)) where rn <= 100),
      qlen as (select query_id, sqrt(sum(w * w)) as qlen from asked group by 1),
      scored as (select query_id, id, round(dot / (qlen * len), 6) as score from (select a.query_id, d.id, sum(a.w * d.w) as dot from asked a join w d using (term) group by all)
        join qlen using (query_id) join len using (id) where qlen * len > 0)
      select query_id, id, score, cast(rn as int) as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rn from scored) where rn <= 10""",
    "index_build": f"""{EDGES_SQL} select id, title, 'normal' as type, ninlinks, round(pow(ln(1 + ln(1 + ninlinks)), 0.5), 6) as boost from (
      select * from cur where ns = 0) join inl using (id) where ninlinks >= {MIN_INLINKS} and redirect is null and id in (select id from cur where {_TYPE} = 'normal')""",
}
