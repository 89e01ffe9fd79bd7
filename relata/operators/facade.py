"""Queries that go through the engine and through files, so that both are compared with SQL over whole tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from relata.operators import concepts, links, postings
from relata.operators.corpus import CUR_SQL, current_pages
from relata.operators.ensemble import _percentile_sql
from relata.operators.matrix import matrix_sql, neighbour_matrix
from relata.session import shared_folder, table
from relata.sources import readers, writers


def _engine(spark, d, metrics: dict | None = None):
    from relata.config import Config
    from relata.engine import Engine

    return Engine(spark, d, Config({"metrics": metrics} if metrics else {}))


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _rated(spark, d, name: str, metrics: dict | None = None):
    e = _engine(spark, d, metrics)
    return e.measure(name).similarity(e.gold()).select("id1", "id2", F.round("score", 6).alias("score"))


def q_engine_links(spark, d):
    return _rated(spark, d, "links")


def q_engine_range(spark, d):
    return _rated(spark, d, "l", {"l": {"type": "links", "similarityNormalizer": "range"}})


def q_engine_percentile(spark, d):
    return _rated(spark, d, "l", {"l": {"type": "links", "similarityNormalizer": {"type": "percentile"}}})


def q_engine_split(spark, d):
    """Pairs of a split measure, which come from the first of its two."""
    return _rated(spark, d, "s", {"s": {"type": "split", "delegates": ["links", "text"]}})


def q_engine_text_lists(spark, d):
    e = _engine(spark, d)
    asked = e.measure("text").docs.where(F.col("id") % postings.SEARCH_STEP == 0).select(F.col("id").alias("query_id"))
    return e.measure("text").most_similar(asked, postings.K)


def q_engine_rank_and_score(spark, d):
    """Lists of the metric pairwise, calibrated by a fit of the label on rank and score over the judged pairs."""
    e = _engine(spark, d, {"k": {"type": "known", "matrix": "pairwise", "mostSimilarNormalizer": {"type": "rankAndScore"}}})
    m = e.measure("k")
    return m.most_similar(m.m.select(F.col("row_id").alias("query_id")), postings.K).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def q_engine_cached(spark, d):
    """Lists computed before stand in for a search: those of the metric text, among judged pages only."""
    e = _engine(spark, d)
    m = e.measure("text")
    m.cached = neighbour_matrix(spark, d, "text").select(F.col("row_id").alias("query_id"), F.col("col_id").alias("id"), F.col("value").alias("score"))
    return m.most_similar(m.cached, postings.K, e.gold().select(F.col("id2").alias("id")))


def q_engine_phrases(spark, d):
    """Judged phrase pairs by the measure jaccard: mapped, disambiguated and rated."""
    e = _engine(spark, d, {"j": {"type": "links", "similarity": "jaccard"}})
    pairs = e.table("gold").where("phrase1 is not null and phrase2 is not null").select(F.col("phrase1").alias("a"), F.col("phrase2").alias("b")).distinct()
    return e.phrase_similarity(pairs, "j")


def _rooted(batches):
    """One element around the pages of each file."""
    yield pd.DataFrame({"value": ["<mediawiki>"]})
    yield from batches
    yield pd.DataFrame({"value": ["</mediawiki>"]})


def _mapped(spark, d, kind: str):
    from relata.config import Config
    from relata.engine import Engine

    e = Engine(spark, d, Config({"concept-mappers": {"main": {"type": kind, "delegates": ["dictionary", "search"]}}}))
    return e.map_phrases(postings.phrases(spark, d)).select("phrase", "rank", "id", "score")


def q_engine_summed_mapper(spark, d):
    return _mapped(spark, d, "ensemble")


def q_engine_first_mapper(spark, d):
    return _mapped(spark, d, "hierarchical")


def q_dump_roundtrip(spark, d):
    """Current pages written as an XML dump and read again."""
    pages = current_pages(table(spark, d, "pages")).where("title is not null and ns is not null")
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")
    clean = lambda c: F.regexp_replace(c, r"[^\x09\x0A\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    moved = F.when(F.col("redirect").isNotNull(), F.concat(F.lit('<redirect title="'), escaped(F.col("redirect")), F.lit('"/>'))).otherwise(F.lit(""))
    xml = F.concat(
        F.lit("<page><title>"), escaped(F.col("title")), F.lit("</title><ns>"), F.col("ns").cast("string"), F.lit("</ns><id>"), F.col("id").cast("string"),
        F.lit("</id>"), moved, F.lit("<revision><text>"), escaped(clean(F.coalesce("text", F.lit("")))), F.lit("</text></revision></page>"),
    )
    path = _scratch(spark, "dump")
    pages.select(xml.alias("value")).mapInPandas(_rooted, "value string").write.text(path)
    return readers.read_dump(spark, path).select("id", "ns", F.trim("title").alias("title"), F.col("redirect").isNotNull().alias("moved"))


def q_sparse_roundtrip(spark, d):
    path = _scratch(spark, "sparse")
    writers.write_sparse(neighbour_matrix(spark, d, "links"), path, quantize=True)
    return readers.read_sparse(spark, path).select("row_id", "col_id", F.round(F.col("value").cast("double"), 3).alias("value"))


def q_dense_roundtrip(spark, d):
    path = _scratch(spark, "dense")
    rows = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"))
    writers.write_dense(rows, list(range(64)), path)
    back, columns = readers.read_dense(spark, path)
    return back.select("row_id", F.posexplode("v").alias("at", "x")).select("row_id", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("at") + 1).alias("col_id"), F.round(F.col("x").cast("double"), 5).alias("value"))


QUERIES = {
    "engine_links": q_engine_links, "engine_range": q_engine_range, "engine_percentile": q_engine_percentile, "engine_split": q_engine_split,
    "engine_text_lists": q_engine_text_lists, "engine_rank_and_score": q_engine_rank_and_score, "engine_cached": q_engine_cached, "engine_phrases": q_engine_phrases,
    "engine_summed_mapper": q_engine_summed_mapper, "engine_first_mapper": q_engine_first_mapper,
    "dump_roundtrip": q_dump_roundtrip, "sparse_roundtrip": q_sparse_roundtrip, "dense_roundtrip": q_dense_roundtrip,
}

_RAW = links.SQL["link_google"]
_LAB = "lab as (select id1, id2, avg(similarity) as y from gold where id1 is not null and id2 is not null and similarity is not null group by all)"
_KNOWN = matrix_sql("pairwise").replace("with ", "", 1) + """, sy as (select row_id, col_id, round(sum(value) / 2, 6) as value from (select * from m union all select col_id, row_id, value from m) group by all),
  rk as (select row_id as query_id, col_id as id, value as score, row_number() over (partition by row_id order by value desc, col_id) as rank from sy)"""
SQL = {
    "engine_links": f"select * from ({_RAW}) semi join (select id1, id2 from gold where similarity is not null) using (id1, id2)",
    "engine_split": f"select * from ({_RAW}) semi join (select id1, id2 from gold where similarity is not null) using (id1, id2)",
    "engine_range": f"""with gl as (select * from ({_RAW}) semi join (select id1, id2 from gold where similarity is not null) using (id1, id2)), bd as (select min(score) as low, max(score) as high from gl where isfinite(score))
      select id1, id2, round(case when isfinite(score) then least(greatest((score - low) / (high - low), 0), 1) end, 6) as score from gl, bd""",
    "engine_percentile": f"""with {_LAB}, gl as (select 'm' as metric, r.*, r.id1 || '-' || r.id2 as key, y from ({_RAW}) r join lab using (id1, id2)),
      sm as (select metric, score as x from (select *, row_number() over (partition by metric order by md5(key), key, score) as rn from gl where isfinite(score)) where rn <= 1000),
      pt as (select metric, x, avg(y) as y from (select metric, x, row_number() over (partition by metric order by x) / (count(*) over (partition by metric) + 1) as y from sm) group by all),
      sg as (select metric, x as x0, y as y0, lead(x) over v as x1, lead(y) over v as y1 from pt window v as (partition by metric order by x)),
      en as (select metric, min(x) as lo, max(x) as hi, arg_min(y, x) as ylo, arg_max(y, x) as yhi, case when max(x) > min(x) then (max(x) - min(x)) / 4 else 1 end as half from pt group by 1),
      pc as ({_percentile_sql('gl', 'score', 'p')}) select id1, id2, round(coalesce(p, (select avg(y) from gl where score is null or not isfinite(score))), 6) as score from pc""",
    "engine_text_lists": f"""{postings.PAGE_INDEX_SQL}, {postings._SELECTED}, {postings._ASKED}, {postings._matches('asked')} select query_id, id, score, cast(rank as int) as rank from ranked where rank <= 10""",
    "engine_rank_and_score": f"""with {_LAB}, {_KNOWN}, ex as (select ln(rank) as r, score as s, y from lab join (select * from rk where rank <= 500) k on k.query_id = id1 and k.id = id2),
      c as (select covar_pop(r, r) as rr, covar_pop(s, s) as ss, covar_pop(r, s) as rs, covar_pop(r, y) as ry, covar_pop(s, y) as sy, avg(r) as mr, avg(s) as ms, avg(y) as my from ex),
      b as (select *, (ry * ss - sy * rs) / (rr * ss - rs * rs) as b1, (sy * rr - ry * rs) / (rr * ss - rs * rs) as b2 from c)
      select query_id, id, round(my - b1 * mr - b2 * ms + b1 * ln(rank) + b2 * score, 5) as score, cast(rank as int) as rank from rk, b where rank <= 10""",
    "engine_cached": f"""{matrix_sql('text')} select query_id, id, score, cast(rank as int) as rank from (select row_id as query_id, col_id as id, value as score,
      row_number() over (partition by row_id order by value desc, col_id) as rank from m where col_id in (select id2 from gold where id1 is not null and id2 is not null and similarity is not null)) where rank <= 10""",
    "engine_phrases": concepts.SQL["pair_disambiguate"].replace("select a, b, id1 as id_a, id2 as id_b from pairs", "select a, b, case when id1 is not null then score end as score from pairs"),
    "engine_summed_mapper": concepts.SQL["ensemble_map"],
    "engine_first_mapper": concepts.SQL["hierarchical_map"],
    "dump_roundtrip": f"with {CUR_SQL} select id, ns, trim(title) as title, redirect is not null as moved from cur where title is not null and ns is not null",
    "sparse_roundtrip": f"{matrix_sql('links')}, c as (select row_id, col_id, cast(trunc((least(greatest(value, -1.1::double), 1.1::double) + 1.1::double) / 2.2::double * 65535.0::double - 32768.0::double) as smallint) as code from m) select row_id, col_id, round(cast((code + 32768.0::double) / 65535.0::double * 2.2::double - 1.1::double as float)::double, 3) as value from c",
    "dense_roundtrip": "select vec_id as row_id, cast(i - 1 as int) as col_id, round(embedding[i]::double, 5) as value from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings where vec_id is not null and embedding is not null)",
}
