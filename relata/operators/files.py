"""Queries that run the line formats of readers and writers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from relata.functions import query as Q
from relata.functions import text as T
from relata.functions.stemmer import analyzed
from relata.operators import links as L
from relata.operators.evaluate import METRICS, wide_scores
from relata.operators.normalize import SIMS_SQL, labelled_sims
from relata.operators.corpus import _TYPE, current_pages, title_ids, with_type
from relata.operators.matrix import matrix_sql, neighbour_matrix
from relata.sources import readers, writers
from relata.session import table


def q_gold_lines(spark, d):
    lines = table(spark, d, "gold").select(F.concat_ws("\t", "phrase1", "phrase2", F.col("similarity").cast("string")).alias("value"))
    return readers.parse_gold(lines)


def q_id_lines(spark, d):
    return readers.parse_ids(table(spark, d, "gold").select(F.concat(F.lit(" "), F.coalesce(F.col("id2").cast("string"), F.lit("none")), F.lit(" ")).alias("value")))


def q_dictionary_lines(spark, d):
    """Anchors written as dictionary lines and read again."""
    from relata.operators.concepts import dictionary

    entries = dictionary(table(spark, d, "links"))
    lines = entries.select(
        F.concat(
            "text", F.lit("\t"), F.format_string("%.6f", F.col("num").cast("double") / F.col("den")), F.lit(" "), F.translate("article", " ", "_"),
            F.lit(" W:"), F.col("num").cast("string"), F.lit("/"), F.col("den").cast("string"),
        ).alias("value")
    )
    return readers.parse_dictionary(lines).select("text", "article", "num", "den", F.round(F.col("fraction").cast("double"), 5).alias("fraction"))


def q_phrase_lines(spark, d):
    lines = table(spark, d, "gold").select(F.concat_ws("\t", F.col("id1").cast("string"), "phrase1").alias("value"))
    return readers.parse_phrases(lines).distinct()


def q_topic_lines(spark, d):
    return writers.topic_lines(neighbour_matrix(spark, d), ("metric",))


def q_matrix_summary(spark, d):
    return writers.matrix_summary(neighbour_matrix(spark, d), by=("metric",))


def q_result_lines(spark, d):
    gold = table(spark, d, "gold").groupBy("phrase1", "phrase2").agg(F.max("similarity").alias("gold"), F.min("id1").alias("id1"), F.min("id2").alias("id2"))
    sims = table(spark, d, "sims").where("metric is not null").groupBy("metric", "id1", "id2").agg(F.max(F.when(~F.isnan("similarity"), F.col("similarity"))).alias("score"))
    return writers.result_lines(gold.join(sims, ["id1", "id2"]), "metric")


def q_arff_lines(spark, d):
    """Scores of all measures of a pair and its label as data lines, counted."""
    wide = wide_scores(labelled_sims(spark, d), METRICS)
    return writers.arff_lines(wide, METRICS, "y", decimals=4).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def q_query_language(spark, d):
    pages = with_type(current_pages(table(spark, d, "pages"))).select("id", "title", "type")
    counted = pages.join(L.inlink_counts(L.edges(table(spark, d, "links"), title_ids(table(spark, d, "pages")))), "id", "left").na.fill(0, ["ninlinks"])
    return counted.where(Q.parse("type:normal AND ninlinks:[3 TO 20]")).select("id", "title", "ninlinks")


def q_standard_analyzer(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select(F.explode(analyzed(F.col("text"), T.STANDARD_STOP_WORDS)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def q_stemmed_analyzer(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    words = analyzed(F.col("text"), readers.stop_words(), stemming=True)
    return docs.select(F.explode(words).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


def q_link_flags(spark, d):
    num, den = T.link_fraction(F.col("flag"))
    flags = table(spark, d, "neighbours").select(F.format_string("KB W:%d/%d x", F.abs(F.col("rank")), F.col("query_id")).alias("flag"), "query_id").where("rank is not null and query_id is not null")
    return flags.groupBy("query_id").agg(F.max(num).alias("num"), F.max(den).alias("den"))


QUERIES = {
    "gold_lines": q_gold_lines, "id_lines": q_id_lines, "dictionary_lines": q_dictionary_lines, "phrase_lines": q_phrase_lines, "topic_lines": q_topic_lines,
    "matrix_summary": q_matrix_summary, "result_lines": q_result_lines, "arff_lines": q_arff_lines, "query_language": q_query_language,
    "standard_analyzer": q_standard_analyzer, "stemmed_analyzer": q_stemmed_analyzer, "link_flags": q_link_flags,
}

_DICT = r"""cnt as (select text, article, count(*) as num from (select trim(lower(regexp_replace(anchor, '[^\p{L}\p{N}]+', ' ', 'g'))) as text,
  trim(regexp_replace(split_part(target_title, '#', 1), '[\s_\x{a0}]+', ' ', 'g')) as article from links) where text <> '' and article <> '' and not contains(article, 'Image:') group by all),
dict as (select text, article, num, cast(sum(num) over (partition by text) as bigint) as den from cnt)"""
SQL = {
    "gold_lines": "select trim(phrase1) as phrase1, trim(phrase2) as phrase2, similarity from gold where phrase1 is not null and phrase2 is not null and similarity is not null",
    "id_lines": "select distinct id2 as id from gold where id2 is not null",
    "dictionary_lines": f"with {_DICT} select text, replace(article, ' ', '_') as article, cast(num as int) as num, cast(den as int) as den, round(num / den, 5) as fraction from dict",
    "phrase_lines": "select distinct cast(id1 as varchar) as client_id, trim(phrase1) as phrase from gold where id1 is not null and phrase1 is not null",
    "topic_lines": f"{matrix_sql()} select metric, row_id, '| ' || string_agg(col_id || ':' || format('{{:.6f}}', value), ' ' order by col_id) as value from m group by all",
    "matrix_summary": f"""{matrix_sql()}, s as (select metric, col_id, count(*) as cells, round(sum(value), 6) as total from m group by all)
      select metric, ranked_by, col_id, cells, total from (select *, 'cells' as ranked_by, row_number() over (partition by metric order by cells desc, col_id) as rn from s
        union all select *, 'total', row_number() over (partition by metric order by total desc, col_id) from s) where rn <= 100""",
    "result_lines": """select metric, phrase1, phrase2, score, gold from (select phrase1, phrase2, max(similarity) as gold, min(id1) as id1, min(id2) as id2 from gold group by all)
      join (select metric, id1, id2, max(similarity) filter (not isnan(similarity)) as score from sims where metric is not null group by all) using (id1, id2) where isfinite(score)""",
    "arff_lines": f"""{SIMS_SQL}, w as (select id1, id2, max(y) as y, {', '.join(f"max(x) filter (metric = '{m}' and isfinite(x)) as {m}" for m in METRICS)} from s group by all)
      select concat_ws(',', {', '.join(f"coalesce(format('{{:.4f}}', {m} + 0.0), '?')" for m in [*METRICS, 'y'])}) as value, count(*) as n from w group by 1""",
    "query_language": L.EDGES_SQL + f", tp as (select id, title, {_TYPE} as type from cur) select id, title, ninlinks from tp join inl using (id) where type = 'normal' and ninlinks between 3 and 20",
    "standard_analyzer": f"select term, count(*) as n from (select unnest({T.WORD_TOKENS_SQL}) as term from documents) where term not in ({', '.join(repr(w) for w in T.STANDARD_STOP_WORDS)}) group by 1",
    "link_flags": "select query_id, max(abs(rank)) as num, max(query_id) as den from neighbours where rank is not null and query_id is not null group by 1",
}
