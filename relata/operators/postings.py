"""Inverted index as tables, and what is most alike by text: term statistics, term selection, weighted matching.

Weights: w = (1 + ln tf) * ln(N / df) on both sides; a score is the product sum over shared terms divided by both
lengths. The query side uses its selected terms only, the record side all of its terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import text as T
from relata.operators.corpus import CUR_SQL, current_pages
from relata.session import reliable, table

SEARCH_STEP = 50  # searches take every record whose id is divisible by this
K = 10


@dataclass(frozen=True)
class TermRule:
    """Which terms of a record ask for others: frequent enough in it, neither rare nor common in the collection."""

    min_tf: int = 2
    min_df: int = 2
    max_percent: float = 10.0
    max_terms: int = 100


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, id, tf) of docs (id, ...): counts are combined within tasks before the shuffle."""
    return docs.select("id", F.explode(tokens).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(index: DataFrame) -> DataFrame:
    """(term, df); postings hold a pair of term and record once."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def with_size(stats: DataFrame, docs: DataFrame) -> DataFrame:
    """stats with the number of records n: a one-row table, broadcast whatever the data."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return stats.join(F.broadcast(n))


def rated(index: DataFrame, stats: DataFrame) -> DataFrame:
    """Postings with the statistics of their terms: (term, id, tf, df, n). Postings that have them stay as they are, so a
    search that reads its index several times joins them once."""
    return index if {"df", "n"} <= set(index.columns) else index.join(stats, "term")


def select_terms(index: DataFrame, stats: DataFrame, rule: TermRule) -> DataFrame:
    """(id, term, tf, df, n): at most max_terms terms a record, by tf * (1 + ln(n / (df + 1))), then by term."""
    fit = (F.col("tf") >= rule.min_tf) & (F.col("df") >= rule.min_df) & (F.col("df") <= F.floor(F.col("n") * rule.max_percent / 100))
    w = Window.partitionBy("id").orderBy(F.desc(F.round(F.col("tf") * (1 + F.log(F.col("n") / (F.col("df") + 1))), 6)), "term")
    ranked = rated(index, stats).where(fit).withColumn("rn", F.row_number().over(w))
    return ranked.where(F.col("rn") <= rule.max_terms).drop("rn")


def fallback_terms(queries: DataFrame, docs: DataFrame, wider: DataFrame, stats: DataFrame, rule: TermRule) -> DataFrame:
    """(query_id, term, tf, df, n) of queries (query_id) that aren't among ``docs`` (id) but in the postings ``wider``:
    their terms are rated by the statistics of the index that is searched."""
    absent = queries.join(docs.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(F.col("query_id").alias("id"))
    return select_terms(wider.join(absent, "id", "left_semi"), stats, rule).withColumnRenamed("id", "query_id")


def weight() -> Column:
    return (1 + F.log("tf")) * F.log(F.col("n") / F.col("df"))


def lengths(index: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, len): length of each record's weights over all its terms."""
    return rated(index, stats).groupBy("id").agg(F.sqrt(F.sum(weight() * weight())).alias("len"))


def matches(asked: DataFrame, index: DataFrame, stats: DataFrame, weighted: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): cosine of selected query terms and all records that share one of them.

    asked: (query_id, term, tf, df, n). Common terms were left out when the terms were selected, so no posting list
    that is joined holds more than the rule's share of all records.
    """
    asked = asked.select("query_id", "term", weight().alias("wq"))
    qlen = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qlen"))
    docs = rated(index, stats).select("term", "id", weight().alias("wd"))
    dots = asked.join(docs, "term").groupBy("query_id", "id").agg(F.sum(F.col("wq") * F.col("wd")).alias("dot"))
    scored = dots.join(qlen, "query_id").join(weighted if weighted is not None else lengths(index, stats), "id")
    divisor = F.col("qlen") * F.col("len")
    return scored.select("query_id", "id", F.round(F.when(divisor > 0, F.col("dot") / divisor), 6).alias("score")).where("score is not null")


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best of each query, score first, then the smaller id, with their rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prune_tail(ranked: DataFrame, span: int = 100, share: float = 0.005) -> DataFrame:
    """Ranked lists (query_id, rank from 1, score) cut where scores flatten.

    At the first place whose score exceeds that of ``span`` places later by less than ``share`` of the best score, the
    list ends ``span`` places later. Lists that never flatten stay whole.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    best = F.first("score").over(w)
    flat = F.col("score") - F.lead("score", span).over(w) < share * best
    marked = ranked.withColumn("flat", F.when(flat, F.col("rank")))
    ends = marked.groupBy("query_id").agg(F.min("flat").alias("cut"))
    return marked.join(ends, "query_id").where(F.col("cut").isNull() | (F.col("rank") <= F.col("cut") + span - 1)).drop("flat", "cut")


def vector_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, score) of pairs (a, b) whose ends have vectors (query_id, id, score); NULL if one is empty."""
    norm = vectors.groupBy("query_id").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("len"))
    va = vectors.select(F.col("query_id").alias("a"), "id", F.col("score").alias("sa"))
    vb = vectors.select(F.col("query_id").alias("b"), "id", F.col("score").alias("sb"))
    dots = pairs.join(va, "a").join(vb, ["b", "id"]).groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("dot"))
    na, nb = norm.select(F.col("query_id").alias("a"), F.col("len").alias("la")), norm.select(F.col("query_id").alias("b"), F.col("len").alias("lb"))
    joined = pairs.join(dots, ["a", "b"], "left").join(na, "a", "left").join(nb, "b", "left")
    divisor = F.col("la") * F.col("lb")
    return joined.select("a", "b", F.round(F.when(divisor > 0, F.coalesce("dot", F.lit(0.0)) / divisor), 6).alias("score"))


# --- queries ------------------------------------------------------------------------------------------------------
def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null")


def _doc_index(spark, d):
    docs = _docs(spark, d)
    return _materialized(docs)


def _materialized(docs):
    """(docs, postings, statistics): the postings are written once with the statistics of their terms, as searches read
    them several times."""
    index = postings(docs, T.word_tokens(F.col("text")))
    return _searchable(docs, index)


def _searchable(docs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = reliable(index)
    stats = with_size(term_stats(raw), docs)
    return docs, reliable(rated(raw, stats)), stats


def _page_index(spark, d):
    return _materialized(_texts(spark, d))


def q_doc_count(spark, d):
    return _docs(spark, d).agg(F.count(F.lit(1)).alias("n"))


def q_term_doc_freq(spark, d):
    return term_stats(postings(_docs(spark, d), T.word_tokens(F.col("text"))))


def q_term_freq(spark, d):
    return postings(_docs(spark, d), T.word_tokens(F.col("text"))).groupBy("term").agg(F.sum("tf").cast("bigint").alias("total"), F.max("tf").alias("most"))


def q_mlt_term_selection(spark, d):
    docs, index, stats = _doc_index(spark, d)
    return select_terms(index.where(F.col("id") % SEARCH_STEP == 0), stats, TermRule()).select("id", "term", "tf", "df")


def most_similar_documents(spark, d, every: int = SEARCH_STEP):
    """(query_id, id, score, rank): for each document whose id is divisible by ``every`` its nearest, of all documents."""
    docs, index, stats = _doc_index(spark, d)
    return top_k(matches(select_terms(index.where(F.col("id") % every == 0), stats, TermRule()).withColumnRenamed("id", "query_id"), index, stats), K)


def q_text_most_similar_topk(spark, d):
    return most_similar_documents(spark, d)


def gold_pairs(spark, d):
    return table(spark, d, "gold").where("id1 is not null and id2 is not null").select("id1", "id2").distinct()


def q_text_similarity_pairs(spark, d):
    """Text similarity of judged pairs: id1 asks, id2 answers; 0 where they share no selected term."""
    docs, index, stats = _page_index(spark, d)
    pairs = gold_pairs(spark, d)
    here = docs.select("id")
    known = pairs.join(here.withColumnRenamed("id", "id1"), "id1", "left_semi").join(here.withColumnRenamed("id", "id2"), "id2", "left_semi")
    asking = index.join(known.select(F.col("id1").alias("id")).distinct(), "id", "left_semi")
    asked = select_terms(asking, stats, TermRule()).withColumnRenamed("id", "query_id")
    answering = index.join(known.select(F.col("id2").alias("id")).distinct(), "id", "left_semi")
    scored = matches(asked, answering, stats, lengths(answering, stats)).select(F.col("query_id").alias("id1"), F.col("id").alias("id2"), "score")
    return known.join(scored, ["id1", "id2"], "left").select("id1", "id2", F.coalesce("score", F.lit(0.0)).alias("score"))


def phrases(spark, d):
    gold = table(spark, d, "gold")
    return gold.select(F.explode(F.array("phrase1", "phrase2")).alias("phrase")).where("phrase is not null").distinct()


def _texts(spark, d):
    return current_pages(table(spark, d, "pages")).where("text is not null and redirect is null").select("id", "text")


def phrase_vectors(spark, d, limit, prune=False, asked=None):
    """Records for each phrase, best first: (query_id = the phrase, id, score, rank)."""
    from relata.operators import search

    return search.most_similar(phrases(spark, d) if asked is None else asked, _texts(spark, d), limit, prune)


def _phrase_cosines(spark, d, limit, prune=False):
    from relata.operators import search

    pairs = table(spark, d, "gold").where("phrase1 is not null and phrase2 is not null").select(F.col("phrase1").alias("a"), F.col("phrase2").alias("b")).distinct()
    return search.cosines(pairs, _texts(spark, d), limit, prune)


def q_text_phrase_cosine(spark, d):
    return _phrase_cosines(spark, d, 100_000)


def q_esa_concept_vector(spark, d):
    return phrase_vectors(spark, d, 5_000, prune=True).select("query_id", "id", "rank", "score")


def q_esa_phrase_similarity(spark, d):
    return _phrase_cosines(spark, d, 5_000, prune=True)


def q_esa_most_similar(spark, d):
    """Most similar by concept vectors for phrases: the head of the pruned vector."""
    return phrase_vectors(spark, d, 5_000, prune=True).where(F.col("rank") <= K).select("query_id", "id", "rank", "score")


def q_valid_id_filter(spark, d):
    """Search among allowed ids only: the restriction is a semi join on the postings, below the aggregate."""
    docs, index, stats = _page_index(spark, d)
    allowed = table(spark, d, "gold").where("id2 is not null").select(F.col("id2").alias("id")).distinct()
    asked = select_terms(index.where(F.col("id") % SEARCH_STEP == 0), stats, TermRule()).withColumnRenamed("id", "query_id")
    inside = index.join(allowed, "id", "left_semi")
    return top_k(matches(asked, inside, stats, lengths(inside, stats)), K)


def _esa_index(spark, d):
    """(concepts, their postings, statistics, postings of all pages): concepts are pages with enough words and links;
    stop words are left out."""
    from relata.operators.corpus import MIN_LINKS, MIN_WORDS, included

    pages = current_pages(table(spark, d, "pages")).where("text is not null and redirect is null")
    every = reliable(postings(pages.select("id", "text"), T.remove_words(T.word_tokens(F.col("text")), T.STANDARD_STOP_WORDS)))
    docs = reliable(included(pages, min_words=MIN_WORDS, min_links=MIN_LINKS).select("id"))
    return *_searchable(docs, every.join(docs, "id", "left_semi")), every


def q_esa_id_most_similar(spark, d):
    """The concepts nearest to each fiftieth page, lists cut where they flatten. Pages that are no concepts ask with
    their own text (fallback)."""
    docs, index, stats, every = _esa_index(spark, d)
    asked = every.where(F.col("id") % SEARCH_STEP == 0).select(F.col("id").alias("query_id")).distinct()
    own = select_terms(index.where(F.col("id") % SEARCH_STEP == 0), stats, TermRule()).withColumnRenamed("id", "query_id").withColumn("fallback", F.lit(False))
    other = fallback_terms(asked, docs, every, stats, TermRule()).withColumn("fallback", F.lit(True))
    terms = own.unionByName(other)
    found = prune_tail(reliable(top_k(matches(terms.drop("fallback"), index, stats), 5_000))).where(F.col("rank") <= K)
    return found.join(terms.select("query_id", "fallback").distinct(), "query_id").select("query_id", "id", "score", "rank", "fallback")


def q_inbound_postings(spark, d):
    """(term, id, tf) of pages with the texts of the links to them appended. Texts are never joined into one: counts are."""
    from relata.functions.titles import canonical_title, present
    from relata.operators.corpus import title_ids

    docs = current_pages(table(spark, d, "pages")).where("text is not null and redirect is null").select("id", "text")
    links = table(spark, d, "links").select(canonical_title(F.col("target_title")).alias("title"), F.col("anchor").alias("text"))
    named = links.where(present(F.col("title")) & F.col("text").isNotNull()).join(title_ids(table(spark, d, "pages")), "title")
    inbound = postings(named.select("id", "text"), T.word_tokens(F.col("text"))).join(docs.select("id"), "id", "left_semi")
    own = postings(docs, T.word_tokens(F.col("text")))
    return own.unionByName(inbound.select(*own.columns)).groupBy("term", "id").agg(F.sum("tf").alias("tf"))


def q_boosted_most_similar(spark, d):
    """Nearest pages by text, scores multiplied by the page's boost, a slow function of the links to it."""
    from relata.functions.maths import log_boost
    from relata.operators.links import _edges, inlink_counts

    docs, index, stats = _page_index(spark, d)
    asked = select_terms(index.where(F.col("id") % SEARCH_STEP == 0), stats, TermRule()).withColumnRenamed("id", "query_id")
    found = matches(asked, index, stats).join(inlink_counts(_edges(spark, d)), "id", "left")
    boosted = F.round(F.col("score") * (1 + log_boost(F.coalesce("ninlinks", F.lit(0)), 2, 0.5)), 6)
    return top_k(found.select("query_id", "id", boosted.alias("score")), K)


QUERIES = {
    "esa_id_most_similar": q_esa_id_most_similar, "inbound_postings": q_inbound_postings, "boosted_most_similar": q_boosted_most_similar,
    "doc_count": q_doc_count, "term_doc_freq": q_term_doc_freq, "term_freq": q_term_freq, "mlt_term_selection": q_mlt_term_selection,
    "text_most_similar_topk": q_text_most_similar_topk, "text_similarity_pairs": q_text_similarity_pairs,
    "text_phrase_cosine": q_text_phrase_cosine, "esa_concept_vector": q_esa_concept_vector, "esa_phrase_similarity": q_esa_phrase_similarity,
    "esa_most_similar": q_esa_most_similar, "valid_id_filter": q_valid_id_filter,
}

_TOKENS = T.WORD_TOKENS_SQL
_INDEX = f"""
post as (select term, id, count(*) as tf from (select id, unnest({_TOKENS}) as term from docs) group by all),
stats as (select term, count(*) as df, (select count(*) from docs) as n from post group by 1),
w as (select id, term, tf, df, n, (1 + ln(tf)) * ln(n / df) as w from post join stats using (term)),
len as (select id, sqrt(sum(w * w)) as len from w group by 1)
"""
DOC_INDEX_SQL = f"with docs as (select doc_id as id, text from documents where text is not null), {_INDEX}"
PAGE_INDEX_SQL = f"with {CUR_SQL}, docs as (select id, text from cur where text is not null and redirect is null), {_INDEX}"
_SELECTED = """selected as (select * from (select *, row_number() over (partition by id order by round(tf * (1 + ln(n / (df + 1))), 6) desc, term) as rn from w
  where tf >= 2 and df >= 2 and df <= floor(n * 10.0 / 100)) where rn <= 100)"""


def _matches(asked: str, docs: str = "w") -> str:
    """CTE ``scored`` from a CTE of asked terms (query_id, term, w)."""
    return f"""qlen as (select query_id, sqrt(sum(w * w)) as qlen from {asked} group by 1),
scored as (select query_id, id, round(dot / (qlen * len), 6) as score from (
  select a.query_id, d.id, sum(a.w * d.w) as dot from {asked} a join {docs} d using (term) group by all)
  join qlen using (query_id) join len using (id) where qlen * len > 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored)"""


_ASKED = "asked as (select id as query_id, term, w from selected where id % 50 = 0)"
_PHRASES = f"""phr as (select distinct phrase from (select phrase1 as phrase from gold union all select phrase2 from gold) where phrase is not null),
asked as (select query_id, term, (1 + ln(tf)) * ln(n / df) as w from (select phrase as query_id, term, count(*) as tf from
  (select phrase, unnest({_TOKENS.replace('(text,', '(phrase,')}) as term from phr) group by all) join stats using (term))"""
_PRUNED = """best as (select query_id, max(score) as top from ranked group by 1),
cuts as (select query_id, min(rank) as cut from (select *, lead(score, 100) over (partition by query_id order by rank) as later from ranked where rank <= 5000)
  join best using (query_id) where score - later < 0.005 * top group by 1),
vec as (select r.* from ranked r left join cuts using (query_id) where rank <= 5000 and (cut is null or rank <= cut + 99))"""


def _cosine(vec: str) -> str:
    return f"""vlen as (select query_id, sqrt(sum(score * score)) as len from {vec} group by 1),
pairs as (select distinct phrase1 as a, phrase2 as b from gold where phrase1 is not null and phrase2 is not null),
dots as (select a, b, sum(x.score * y.score) as dot from pairs join {vec} x on x.query_id = a join {vec} y on y.query_id = b and y.id = x.id group by all)
select a, b, round(case when x.len * y.len > 0 then coalesce(dot, 0) / (x.len * y.len) end, 6) as score
from pairs left join dots using (a, b) left join vlen x on x.query_id = a left join vlen y on y.query_id = b"""


def _esa_sql() -> str:
    from relata.operators.corpus import SQL as PAGES

    stop = ", ".join(f"'{w}'" for w in T.STANDARD_STOP_WORDS)
    fit = PAGES["page_filter"]
    fit = fit[fit.index("select id, title from cur"):].replace("select id, title from cur", "select id from cur")
    return f"""with {CUR_SQL}, fit as ({fit} and text is not null),
      ev as (select term, id, count(*) as tf from (select id, unnest({_TOKENS}) as term from cur where text is not null and redirect is null) where term not in ({stop}) group by all),
      post as (select * from ev where id in (select id from fit)), stats as (select term, count(*) as df, (select count(*) from fit) as n from post group by 1),
      w as (select id, term, tf, df, n, (1 + ln(tf)) * ln(n / df) as w from post join stats using (term)), len as (select id, sqrt(sum(w * w)) as len from w group by 1),
      we as (select id, term, tf, df, n, (1 + ln(tf)) * ln(n / df) as w from ev join stats using (term) where id % 50 = 0),
      asked as (select query_id, term, w, fallback from (select id as query_id, term, w, id not in (select id from fit) as fallback,
        row_number() over (partition by id order by round(tf * (1 + ln(n / (df + 1))), 6) desc, term) as rn from we where tf >= 2 and df >= 2 and df <= floor(n * 10.0 / 100)) where rn <= 100),
      {_matches('asked')}, {_PRUNED} select query_id, id, score, cast(rank as int) as rank, fallback from vec join (select distinct query_id, fallback from asked) using (query_id) where rank <= 10"""


def _linked_sql(start: str) -> str:
    """The CTEs of linking pages before those of ``start``, which begin with the current pages too."""
    from relata.operators.links import EDGES_SQL

    return EDGES_SQL + start.removeprefix(f"with {CUR_SQL}")


_CANONICAL = "trim(regexp_replace(split_part(target_title, '#', 1), '[\\s_\\x{a0}]+', ' ', 'g'))"


SQL = {
    "doc_count": "select count(*) as n from documents where text is not null",
    "term_doc_freq": f"{DOC_INDEX_SQL} select term, df from stats",
    "term_freq": f"{DOC_INDEX_SQL} select term, cast(sum(tf) as bigint) as total, max(tf) as most from post group by 1",
    "mlt_term_selection": f"{DOC_INDEX_SQL}, {_SELECTED} select id, term, tf, df from selected where id % 50 = 0",
    "text_most_similar_topk": f"{DOC_INDEX_SQL}, {_SELECTED}, {_ASKED}, {_matches('asked')} select query_id, id, score, cast(rank as int) as rank from ranked where rank <= 10",
    "text_similarity_pairs": f"""{PAGE_INDEX_SQL}, {_SELECTED}, pairs as (select distinct id1, id2 from gold where id1 in (select id from docs) and id2 in (select id from docs)),
      asked as (select id as query_id, term, w from selected where id in (select id1 from pairs)), {_matches('asked')}
      select id1, id2, coalesce(score, 0.0) as score from pairs left join scored on query_id = id1 and id = id2""",
    "text_phrase_cosine": f"{PAGE_INDEX_SQL}, {_PHRASES}, {_matches('asked')}, {_cosine('ranked')}",
    "esa_concept_vector": f"{PAGE_INDEX_SQL}, {_PHRASES}, {_matches('asked')}, {_PRUNED} select query_id, id, cast(rank as int) as rank, score from vec",
    "esa_phrase_similarity": f"{PAGE_INDEX_SQL}, {_PHRASES}, {_matches('asked')}, {_PRUNED}, {_cosine('vec')}",
    "esa_most_similar": f"{PAGE_INDEX_SQL}, {_PHRASES}, {_matches('asked')}, {_PRUNED} select query_id, id, cast(rank as int) as rank, score from vec where rank <= 10",
    "valid_id_filter": f"""{PAGE_INDEX_SQL}, {_SELECTED}, {_ASKED}, inside as (select * from w where id in (select id2 from gold)), {_matches('asked', 'inside')}
      select query_id, id, score, cast(rank as int) as rank from ranked where rank <= 10""",
}


def linked_sql() -> dict[str, str]:
    """SQL of the queries that join links too, and of those that need other modules' SQL."""
    anchors = _TOKENS.replace("(text,", "(anchor,")
    return {
        "esa_id_most_similar": _esa_sql(),
        "inbound_postings": _linked_sql(f"with {CUR_SQL}, docs as (select id, text from cur where text is not null and redirect is null)")
        + f""" select term, id, count(*) as tf from (select unnest({_TOKENS}) as term, id from docs union all
          select unnest({anchors}), id from (select anchor, {_CANONICAL} as title from links where anchor is not null) join titles using (title) where id in (select id from docs)) group by all""",
        "boosted_most_similar": _linked_sql(PAGE_INDEX_SQL) + f""", {_SELECTED}, {_ASKED}, {_matches('asked')},
          bo as (select query_id, id, round(score * (1 + sqrt(ln(1 + ln(1 + coalesce(ninlinks, 0))))), 6) as score from scored left join inl using (id))
          select query_id, id, score, cast(rn as int) as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rn from bo) where rn <= 10""",
    }
