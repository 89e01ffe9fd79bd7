"""From phrases to pages: anchor dictionaries, mappers and their combination, disambiguation of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import text as T
from relata.functions.titles import canonical_title, present
from relata.operators import links as L
from relata.operators import postings as P
from relata.operators.corpus import current_pages, follow_redirects, title_ids
from relata.operators.matrix import METRICS, matrix_sql, neighbour_matrix
from relata.session import reliable, table

MIN_COUNT, MIN_SHARE = 5, 0.01
CONCEPTS = 5
#: Length of a phrase's list in which another phrase's page is looked for.
TARGET_LIST = 500


def dictionary(links: DataFrame) -> DataFrame:
    """(text, article, num, den): how many of a normalized anchor's links point to each title."""
    named = links.select(T.normalize_phrase(F.col("anchor")).alias("text"), canonical_title(F.col("target_title")).alias("article"))
    named = named.where(present(F.col("text")) & present(F.col("article")) & ~F.contains("article", F.lit(T.IMAGE)))
    counts = named.groupBy("text", "article").agg(F.count(F.lit(1)).alias("num"))
    totals = counts.groupBy("text").agg(F.sum("num").alias("den"))
    return counts.join(totals, "text")


def retained(entries: DataFrame, least: int = MIN_COUNT, share: float = MIN_SHARE) -> DataFrame:
    """Entries frequent enough and not too small a share of their text."""
    return entries.where((F.col("num") >= least) & (F.col("num").cast("double") / F.col("den") > share))


def merge_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert that appends: counts of a text and article add up, totals follow."""
    both = old.select("text", "article", "num").unionByName(new.select("text", "article", "num"))
    summed = both.groupBy("text", "article").agg(F.sum("num").cast("bigint").alias("num"))
    return summed.join(summed.groupBy("text").agg(F.sum("num").cast("bigint").alias("den")), "text")


def map_phrases(phrases: DataFrame, entries: DataFrame, moves: DataFrame, titles: DataFrame, n: int) -> DataFrame:
    """(phrase, rank, id, score): the n articles a phrase most often links to, redirects followed.

    Shares are of all links of the phrase, those to missing articles included, which are then left out.
    """
    keyed = phrases.select("phrase", T.normalize_phrase(F.col("phrase")).alias("text"))
    hits = keyed.join(entries, "text").join(moves.select(F.col("title").alias("article"), "target"), "article", "left")
    summed = hits.groupBy("phrase", F.coalesce("target", "article").alias("title")).agg(F.sum("num").alias("num"))
    totals = summed.groupBy("phrase").agg(F.sum("num").alias("total"))
    shares = summed.join(totals, "phrase").join(titles, "title")
    scored = shares.select("phrase", "id", F.round(F.col("num") / F.col("total"), 6).alias("score")).groupBy("phrase", "id").agg(F.max("score").alias("score"))
    return best(scored, n)


def search_phrases(found: DataFrame, inlinks: DataFrame, n: int) -> DataFrame:
    """The n pages of a phrase's search results (query_id, id, score, rank) that are linked to most, as shares of their sum."""
    head = found.where(F.col("rank") <= 10 * n).select(F.col("query_id").alias("phrase"), "id", "score").join(inlinks, "id", "left")
    boosted = head.select("phrase", "id", F.round(F.col("score") * F.log1p(F.coalesce("ninlinks", F.lit(0)).cast("double")), 6).alias("score"))
    top = best(boosted.where("score > 0"), n)
    total = top.groupBy("phrase").agg(F.sum("score").alias("total"))
    return top.join(total, "phrase").select("phrase", "rank", "id", F.round(F.col("score") / F.col("total"), 6).alias("score"))


def best(scored: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("phrase").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("phrase", "rank", "id", "score")


def summed_mappers(n: int, *mapped: DataFrame) -> DataFrame:
    """The n best by the sum of the mappers' scores."""
    both = mapped[0].select("phrase", "id", "score")
    for m in mapped[1:]:
        both = both.unionByName(m.select("phrase", "id", "score"))
    return best(both.groupBy("phrase", "id").agg(F.round(F.sum("score"), 6).alias("score")), n)


def first_mapper(*mapped: DataFrame) -> DataFrame:
    """For each phrase the first mapper that knows it."""
    out = None
    for i, m in enumerate(mapped):
        part = m.select("phrase", "rank", "id", "score", F.lit(i).alias("turn"))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy("phrase").agg(F.min("turn").alias("turn"))
    return out.join(first, ["phrase", "turn"]).drop("turn")


def disambiguate(pairs: DataFrame, mapped: DataFrame, scored, n: int = CONCEPTS) -> DataFrame:
    """(a, b, id_a, id_b) for phrase pairs (a, b): the candidates with the greatest product of shares and similarity.

    At most n by n candidates a pair; scored gives (id1, id2, score) for id pairs. Without any similar candidates the
    best of each side stand; NULL if a side has none.
    """
    some = reliable(mapped.where(F.col("rank") <= n))
    a = some.select(F.col("phrase").alias("a"), F.col("id").alias("id1"), F.col("score").alias("sa"))
    b = some.select(F.col("phrase").alias("b"), F.col("id").alias("id2"), F.col("score").alias("sb"))
    grid = reliable(pairs.join(a, "a").join(b, "b"))
    sims = scored(grid.select("id1", "id2").distinct())
    rated = grid.join(sims, ["id1", "id2"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    product = F.round(F.col("sa") * F.col("sb") * F.col("score"), 9)
    w = Window.partitionBy("a", "b").orderBy(F.desc(product), F.desc("sa"), F.desc("sb"), "id1", "id2")
    top = rated.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("a", "b", F.col("id1").alias("id_a"), F.col("id2").alias("id_b"))
    return pairs.join(top, ["a", "b"], "left")


def targets_in_lists(pairs: DataFrame, lists: DataFrame, mapped: DataFrame) -> DataFrame:
    """(a, b, id, score, rank) for phrase pairs (a, b): of the list of a (phrase, id, score, rank) the page with the
    greatest product of its score and the share with which b stands for it (phrase, id, score); NULL if there is none."""
    list_of_a = lists.select(F.col("phrase").alias("a"), "id", "score", "rank")
    meant = mapped.select(F.col("phrase").alias("b"), "id", F.col("score").alias("share"))
    w = Window.partitionBy("a", "b").orderBy(F.desc(F.round(F.col("score") * F.col("share"), 9)), "rank", "id")
    hits = pairs.select("a", "b").distinct().join(meant, "b").join(list_of_a, ["a", "id"]).withColumn("rn", F.row_number().over(w))
    return pairs.select("a", "b").distinct().join(hits.where("rn = 1").select("a", "b", "id", "score", "rank"), ["a", "b"], "left")


def scores_in_lists(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(id1, id2, score, rank) for id pairs: where id2 stands in the list of id1 (query_id, id, score, rank from 1); rank is
    -1 and score NULL if the list lacks it. Pairs whose id1 has no list are left out."""
    known = pairs.join(lists.select(F.col("query_id").alias("id1")).distinct(), "id1", "left_semi")
    cells = lists.select(F.col("query_id").alias("id1"), F.col("id").alias("id2"), "score", "rank")
    return known.join(cells, ["id1", "id2"], "left").select("id1", "id2", "score", F.coalesce("rank", F.lit(-1)).alias("rank"))


# --- queries ------------------------------------------------------------------------------------------------------
def _phrases(spark, d):
    return P.phrases(spark, d)


def _moves(spark, d):
    cur = current_pages(table(spark, d, "pages").select("id", "title", "redirect", "touched", "loaded", F.lit(None).cast("string").alias("text")))
    moves = cur.select(canonical_title(F.col("title")).alias("title"), canonical_title(F.col("redirect")).alias("to"))
    moves = moves.where(present(F.col("title")) & present(F.col("to"))).groupBy("title").agg(F.min("to").alias("to"))
    return follow_redirects(moves)


def _mapped(spark, d, n=CONCEPTS):
    return map_phrases(_phrases(spark, d), dictionary(table(spark, d, "links")), _moves(spark, d), title_ids(table(spark, d, "pages")), n)


def _searched(spark, d, n=CONCEPTS):
    counts = L.inlink_counts(L.edges(table(spark, d, "links"), title_ids(table(spark, d, "pages"))))
    return search_phrases(P.phrase_vectors(spark, d, 10 * n), counts, n)


def q_dictionary(spark, d):
    return dictionary(table(spark, d, "links"))


def q_dictionary_retain(spark, d):
    return retained(dictionary(table(spark, d, "links")))


def q_dictionary_merge(spark, d):
    """Entries of the links loaded up to mid-2023 merged with those loaded later: the same as all at once."""
    links, cut = table(spark, d, "links"), F.col("loaded") < F.lit("2023-07-01").cast("timestamp_ntz")
    return merge_entries(dictionary(links.where(cut)), dictionary(links.where(~cut | F.col("loaded").isNull())))


def q_dictionary_map(spark, d):
    return _mapped(spark, d)


def q_title_map(spark, d):
    return _mapped(spark, d, 1)


def q_search_map(spark, d):
    return _searched(spark, d)


def q_ensemble_map(spark, d):
    return summed_mappers(CONCEPTS, _mapped(spark, d, 5 * CONCEPTS), _searched(spark, d, 5 * CONCEPTS))


def q_hierarchical_map(spark, d):
    return first_mapper(_mapped(spark, d), _searched(spark, d))


def q_single_disambiguate(spark, d):
    """The first mapped page of a phrase; judged pairs that carry ids keep them."""
    gold = table(spark, d, "gold").where("phrase1 is not null").select(F.col("phrase1").alias("phrase"), "id1").groupBy("phrase").agg(F.min("id1").alias("id1"))
    top = _mapped(spark, d, 1).select("phrase", "id")
    return gold.join(top, "phrase", "left").select("phrase", F.coalesce("id1", "id").alias("id"))


def q_pair_disambiguate(spark, d):
    pairs = table(spark, d, "gold").where("phrase1 is not null and phrase2 is not null").select(F.col("phrase1").alias("a"), F.col("phrase2").alias("b")).distinct()
    e = L.edges(table(spark, d, "links"), title_ids(table(spark, d, "pages"))).select(F.col("src").alias("id"), F.col("dst").alias("link"))
    n = L.page_ids(spark, d)
    return disambiguate(pairs, _mapped(spark, d), lambda ids: L.link_overlap(ids, e, n).select("id1", "id2", L.jaccard().alias("score")))


def q_dictionary_sorted(spark, d):
    """Entries of each text in order of their links, the most first."""
    w = Window.partitionBy("text").orderBy(F.desc("num"), "article")
    return dictionary(table(spark, d, "links")).select("text", "article", "num", F.row_number().over(w).alias("place"))


def _gold_phrases(spark, d):
    return table(spark, d, "gold").where("phrase1 is not null and phrase2 is not null").select(F.col("phrase1").alias("a"), F.col("phrase2").alias("b")).distinct()


def q_phrase_targets(spark, d):
    """The page of phrase a's search results that phrase b most likely stands for."""
    pairs = _gold_phrases(spark, d)
    lists = P.phrase_vectors(spark, d, TARGET_LIST, asked=pairs.select(F.col("a").alias("phrase")).distinct()).withColumnRenamed("query_id", "phrase")
    return targets_in_lists(pairs, lists, _mapped(spark, d, 2 * CONCEPTS))


def q_list_scorer(spark, d):
    """Where the second page of a judged pair stands in the first one's list of each metric."""
    pairs = table(spark, d, "gold").where("id1 is not null and id2 is not null").select("id1", "id2").distinct()
    lists = neighbour_matrix(spark, d).select("metric", F.col("row_id").alias("query_id"), F.col("col_id").alias("id"), F.col("value").alias("score"))
    w = Window.partitionBy("metric", "query_id").orderBy(F.desc("score"), "id")
    out = None
    ranked = lists.withColumn("rank", F.row_number().over(w))
    for metric in METRICS:
        part = scores_in_lists(pairs, ranked.where(F.col("metric") == metric).drop("metric")).select(F.lit(metric).alias("metric"), "id1", "id2", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def q_phrase_vectors_cosine(spark, d):
    """Cosine of the lists of two phrases, a phrase's list being that of the page it maps to, by the metric esa."""
    pages = _mapped(spark, d, 1).select(F.col("phrase").alias("query_id"), F.col("id").alias("row_id"))
    lists = pages.join(neighbour_matrix(spark, d, "esa"), "row_id").select("query_id", F.col("col_id").alias("id"), F.col("value").alias("score"))
    return P.vector_cosine(_gold_phrases(spark, d), reliable(lists))


QUERIES = {
    "dictionary_sorted": q_dictionary_sorted, "phrase_targets": q_phrase_targets, "list_scorer": q_list_scorer, "phrase_vectors_cosine": q_phrase_vectors_cosine,
    "dictionary_build": q_dictionary, "dictionary_retain": q_dictionary_retain, "dictionary_merge": q_dictionary_merge, "dictionary_map": q_dictionary_map,
    "title_map": q_title_map, "search_map": q_search_map, "ensemble_map": q_ensemble_map, "hierarchical_map": q_hierarchical_map,
    "single_disambiguate": q_single_disambiguate, "pair_disambiguate": q_pair_disambiguate,
}

_NORM = r"trim(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
_CANON = "trim(regexp_replace(split_part({0}, '#', 1), '[\\s_\\x{{a0}}]+', ' ', 'g'))"
_DICT = f"""cnt as (select text, article, count(*) as num from (select {_NORM.format('anchor')} as text, {_CANON.format('target_title')} as article from links)
  where text <> '' and article <> '' and not contains(article, 'Image:') group by all),
dict as (select text, article, num, cast(sum(num) over (partition by text) as bigint) as den from cnt)"""
_MAP = f"""{L.EDGES_SQL.replace('with ', 'with recursive ', 1)}, {_DICT},
mv as (select {_CANON.format('title')} as title, min({_CANON.format('redirect')}) as dest from cur where redirect is not null and {_CANON.format('title')} <> '' and {_CANON.format('redirect')} <> '' group by 1),
fl as (select title, dest as target, 1 as steps from mv union all select fl.title, mv.dest, steps + 1 from fl join mv on mv.title = fl.target where steps < 10),
mvs as (select title, arg_max(target, steps) as target from fl group by 1),
phr as (select distinct phrase from (select phrase1 as phrase from gold union all select phrase2 from gold) where phrase is not null),
hit as (select phrase, coalesce(target, article) as title, sum(num) as num from (select phrase, {_NORM.format('phrase')} as text from phr) join dict using (text) left join mvs on mvs.title = article group by all),
shr as (select phrase, id, max(round(num / total, 6)) as score from (select *, sum(num) over (partition by phrase) as total from hit) join titles using (title) group by all),
dm as (select phrase, cast(row_number() over (partition by phrase order by score desc, id) as int) as rank, id, score from shr)"""
_SEARCH = f"""docs as (select id, text from cur where text is not null and redirect is null), {P._INDEX}, {P._PHRASES.replace('phr as (select distinct phrase from (select phrase1 as phrase from gold union all select phrase2 from gold) where phrase is not null),', '')}, {P._matches('asked')}"""


def _search_map(n: int) -> str:
    return f"""bst{n} as (select phrase, id, score, row_number() over (partition by phrase order by score desc, id) as rank from (
  select query_id as phrase, id, round(score * ln(1 + coalesce(ninlinks, 0)), 6) as score from ranked left join inl using (id) where rank <= {10 * n}) where score > 0),
sm{n} as (select phrase, cast(rank as int) as rank, id, round(score / sum(score) over (partition by phrase), 6) as score from bst{n} where rank <= {n})"""


_LISTED = matrix_sql().replace("with ", "", 1) + ", ls as (select *, row_number() over (partition by metric, row_id order by value desc, col_id) as rank from m)"
SQL = {
    "dictionary_sorted": f"with {_DICT} select text, article, num, cast(row_number() over (partition by text order by num desc, article) as int) as place from dict",
    "phrase_targets": f"""{_MAP}, {_SEARCH}, pairs as (select distinct phrase1 as a, phrase2 as b from gold where phrase1 is not null and phrase2 is not null),
      ht as (select a, b, r.id, r.score, r.rank, row_number() over (partition by a, b order by round(r.score * m.score, 9) desc, r.rank, r.id) as rn
        from pairs join dm m on m.phrase = b and m.rank <= {2 * CONCEPTS} join ranked r on r.query_id = a and r.id = m.id and r.rank <= {TARGET_LIST})
      select a, b, id, score, cast(rank as int) as rank from pairs left join (select * from ht where rn = 1) using (a, b)""",
    "list_scorer": f"""with {_LISTED}, pairs as (select distinct id1, id2 from gold where id1 is not null and id2 is not null), kn as (select distinct metric, row_id as id1 from ls)
      select kn.metric, id1, id2, value as score, cast(coalesce(rank, -1) as int) as rank from pairs join kn using (id1) left join ls on ls.metric = kn.metric and ls.row_id = id1 and ls.col_id = id2""",
    "phrase_vectors_cosine": f"""{_MAP}, {matrix_sql('esa').replace('with ', '', 1)}, vec as (select phrase as query_id, col_id as id, value as score from dm join m on m.row_id = dm.id where rank = 1), {P._cosine('vec')}""",
    "dictionary_build": f"with {_DICT} select * from dict",
    "dictionary_retain": f"with {_DICT} select * from dict where num >= {MIN_COUNT} and num::double / den > {MIN_SHARE}",
    "dictionary_merge": f"with {_DICT} select * from dict",
    "dictionary_map": f"{_MAP} select * from dm where rank <= {CONCEPTS}",
    "title_map": f"{_MAP} select * from dm where rank <= 1",
    "search_map": f"{_MAP}, {_SEARCH}, {_search_map(5)} select * from sm5",
    "ensemble_map": f"""{_MAP}, {_SEARCH}, {_search_map(25)}, su as (select phrase, id, round(sum(score), 6) as score from (select phrase, id, score from dm where rank <= 25 union all select phrase, id, score from sm25) group by all)
      select * from (select phrase, cast(row_number() over (partition by phrase order by score desc, id) as int) as rank, id, score from su) where rank <= 5""",
    "hierarchical_map": f"""{_MAP}, {_SEARCH}, {_search_map(5)} select * from dm where rank <= 5 union all select * from sm5 where phrase not in (select phrase from dm)""",
    "single_disambiguate": f"""{_MAP} select phrase, coalesce(g.id1, dm.id) as id from (select phrase1 as phrase, min(id1) as id1 from gold where phrase1 is not null group by 1) g
      left join (select phrase, id from dm where rank = 1) dm using (phrase)""",
    "pair_disambiguate": f"""{_MAP}, pairs as (select distinct phrase1 as a, phrase2 as b from gold where phrase1 is not null and phrase2 is not null),
      grid as (select a, b, x.id as id1, x.score as sa, y.id as id2, y.score as sb from pairs join dm x on x.phrase = a and x.rank <= 5 join dm y on y.phrase = b and y.rank <= 5),
      deg as (select src, count(*) as n from e group by 1),
      sh as (select id1, id2, count(*) as i from (select distinct id1, id2 from grid) join e x on x.src = id1 join e y on y.src = id2 and y.dst = x.dst group by all),
      rt as (select grid.*, coalesce(round(i / (p.n + q.n - i + 1), 6), 0) as score from grid left join sh using (id1, id2) left join deg p on p.src = id1 left join deg q on q.src = id2)
      select a, b, id1 as id_a, id2 as id_b from pairs left join (select *, row_number() over (partition by a, b order by round(sa * sb * score, 9) desc, sa desc, sb desc, id1, id2) as rn from rt) using (a, b)
      where rn = 1 or rn is null""",
}
