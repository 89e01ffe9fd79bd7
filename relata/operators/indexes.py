"""Indexes as a configuration describes them: which pages, which fields, how texts are read, and how pages are boosted."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.functions import maths as M
from relata.functions import text as T
from relata.functions.stemmer import analyzed
from relata.functions.titles import canonical_title, present
from relata.operators import links as L
from relata.operators import postings as P
from relata.operators.corpus import CUR_SQL, MIN_LINKS, MIN_WORDS, SQL as PAGES_SQL, current_pages, included, title_ids
from relata.session import table
from relata.sources import readers

#: Settings that an index may have.
SETTINGS = {"fields", "type", "namespaces", "skipLists", "skipRedirects", "skipDabs", "minWords", "minLinks", "titleMultiplier", "addInLinksToText", "booster", "analyzer", "similarity"}
FIELDS = ("id", "ns", "title", "redirect", "text", "type", "ninlinks", "inlinks", "links", "boost")


def checked(settings: dict[str, Any]) -> dict[str, Any]:
    """The settings, or an error for those that aren't known or have unknown values."""
    if extra := set(settings) - SETTINGS:
        raise ValueError(f"unknown settings of an index: {', '.join(sorted(extra))}")
    if settings.get("analyzer", "standard") not in ("standard", "ESA"):
        raise ValueError(f"unknown analyzer: {settings['analyzer']}")
    if settings.get("similarity", "ESA") != "ESA":
        raise ValueError(f"unknown similarity: {settings['similarity']}")
    booster = settings.get("booster", {"type": "inlink"})
    if booster.get("type") != "inlink" or set(booster) - {"type", "numLogs", "pow"}:
        raise ValueError(f"unknown booster: {booster}")
    if unknown := set(settings.get("fields", [])) - set(FIELDS):
        raise ValueError(f"unknown fields of an index: {', '.join(sorted(unknown))}")
    return settings


def documents(pages: DataFrame, links: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """The pages of an index with its fields: filtered, titles repeated, in-links counted and boosts computed in one plan."""
    s = checked(settings)
    current = current_pages(pages)
    fit = included(
        current, tuple(s.get("namespaces", (0,))), s.get("skipLists", False), s.get("skipRedirects", True), s.get("skipDabs", False), s.get("minWords", 0), s.get("minLinks", 0)
    )
    fields = list(s.get("fields", ["id", "title", "text"]))
    fit = fit.withColumns({
        "type": T.page_type(F.col("title"), F.col("redirect"), F.col("text")), "links": T.anchor_targets(F.col("text")),
        "text": T.repeat_title(F.col("text"), F.col("title"), s["titleMultiplier"]) if s.get("titleMultiplier") else F.col("text"),
    })
    if "booster" in s and "boost" not in fields:
        fields.append("boost")
    if {"ninlinks", "inlinks", "boost"} & set(fields):
        edges = L.edges(links, title_ids(pages))
        fit = fit.join(L.inlink_counts(edges), "id", "left").withColumn("ninlinks", F.coalesce("ninlinks", F.lit(0)))
        b = s.get("booster", {})
        fit = fit.withColumn("boost", M.log_boost(F.col("ninlinks"), b.get("numLogs", 2), b.get("pow", 0.5)))
        if "inlinks" in fields:
            fields[fields.index("inlinks")] = "ninlinks"  # the list itself is the edges' table, a row an in-link
    return fit.select(*dict.fromkeys(fields))


def index_postings(pages: DataFrame, links: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """(term, id, tf) of the texts of an index, with those of the links to its pages if so asked."""
    s = checked(settings)
    tokens = (lambda c: analyzed(c, readers.stop_words(), stemming=True)) if s.get("analyzer") == "ESA" else T.word_tokens
    docs = documents(pages, links, s | {"fields": ["id", "text"]}).where("text is not null").select("id", "text")
    own = P.postings(docs, tokens(F.col("text")))
    if not s.get("addInLinksToText"):
        return own
    named = links.select(canonical_title(F.col("target_title")).alias("title"), F.col("anchor").alias("text")).where(present(F.col("title")) & F.col("text").isNotNull())
    shown = named.join(title_ids(pages), "title").select("id", "text").join(docs.select("id"), "id", "left_semi")
    return own.unionByName(P.postings(shown, tokens(F.col("text"))).select(*own.columns)).groupBy("term", "id").agg(F.sum("tf").alias("tf"))


BOOSTED = {"namespaces": [0], "skipLists": True, "skipDabs": True, "minWords": MIN_WORDS, "minLinks": MIN_LINKS, "fields": ["id", "title", "ninlinks"], "booster": {"type": "inlink", "numLogs": 2, "pow": 0.5}}
REPEATED = {"namespaces": [0], "titleMultiplier": 2, "skipRedirects": True, "addInLinksToText": True}


def q_configured_index(spark, d):
    found = documents(table(spark, d, "pages"), table(spark, d, "links"), BOOSTED)
    return found.select("id", "title", "ninlinks", F.round("boost", 6).alias("boost"))


def q_configured_postings(spark, d):
    """Terms of articles with the title twice behind the text and the texts of the links to them."""
    return index_postings(table(spark, d, "pages"), table(spark, d, "links"), REPEATED)


QUERIES = {"configured_index": q_configured_index, "configured_postings": q_configured_postings}

_FIT = PAGES_SQL["page_filter"].split("select id, title from cur", 1)[1]
_DOCS = f"with {CUR_SQL}, docs as (select id, text || repeat(chr(10) || title, 2) as text from cur where ns = 0 and redirect is null)"
SQL = {
    "configured_index": f"{L.EDGES_SQL}, fit as (select id, title from cur {_FIT}) select id, title, ninlinks, round(sqrt(ln(1 + ln(1 + ninlinks))), 6) as boost from fit join inl using (id)",
    "configured_postings": P._linked_sql(_DOCS) + f""" select term, id, count(*) as tf from (select unnest({P._TOKENS}) as term, id from docs where text is not null union all
      select unnest({P._TOKENS.replace('(text,', '(anchor,')}), id from (select anchor, {P._CANONICAL} as title from links where anchor is not null) join titles using (title)
      where id in (select id from docs where text is not null)) group by all""",
}
