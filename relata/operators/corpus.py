"""Pages as they stand: current rows, filters for what belongs into an index, projections, id and title lookups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import balanced
from relata.functions import text as T
from relata.functions.titles import canonical_title, present
from relata.session import reliable, table

MIN_WORDS, MIN_LINKS = 20, 2


def current_pages(pages: DataFrame) -> DataFrame:
    """The current row of each page: greatest ``touched``, then greatest ``loaded``; ties by content.

    The rank filter prunes older rows within each task before the shuffle. Rows without an id are left out.
    """
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("touched"), F.desc_nulls_last("loaded"), F.desc("tie"))
    ranked = pages.where("id is not null").withColumn("tie", F.xxhash64("text", "redirect")).withColumn("rn", F.row_number().over(w))
    return ranked.where("rn = 1").drop("rn", "tie")


def narrow_current(pages: DataFrame, *columns: str) -> DataFrame:
    """As :func:`current_pages` with ``columns`` only, so that texts are not shuffled unless asked for."""
    return current_pages(pages).select(*columns)


def with_type(pages: DataFrame) -> DataFrame:
    return pages.withColumn("type", T.page_type(F.col("title"), F.col("redirect"), F.col("text")))


def included(
    pages: DataFrame, namespaces: tuple[int, ...] = (0,), skip_lists: bool = True, skip_redirects: bool = True,
    skip_dabs: bool = True, min_words: int = 0, min_links: int = 0,
) -> DataFrame:
    """Pages that belong into an index: one conjunct, so that each part can be pushed down. Null texts have no words."""
    keep = F.col("ns").isin(*namespaces)
    if skip_lists:
        keep &= ~F.coalesce(T.is_list_title(F.col("title")), F.lit(False))
    if skip_redirects:
        keep &= ~T.is_redirect(F.col("redirect"))
    if skip_dabs:
        keep &= ~F.coalesce(T.is_disambiguation(F.col("text")), F.lit(False))
    if min_words:
        keep &= F.coalesce(T.unique_words(F.col("text")), F.lit(0)) >= min_words
    if min_links:
        keep &= F.coalesce(F.size(F.array_distinct(F.transform(T.anchor_targets(F.col("text")), T.strip_fragment))), F.lit(0)) >= min_links
    return pages.where(keep)


def title_ids(pages: DataFrame) -> DataFrame:
    """(title, id): the least id of each canonical title among current rows."""
    titled = current_pages(pages.select("id", "title", "redirect", "touched", "loaded", F.lit(None).cast("string").alias("text")))
    return titled.select(canonical_title(F.col("title")).alias("title"), "id").where(present(F.col("title"))).groupBy("title").agg(F.min("id").alias("id"))


def follow_redirects(moves: DataFrame, hops: int = 10, known: DataFrame | None = None) -> DataFrame:
    """(title, target, steps): each title followed through ``moves`` (title, to) for at most ``hops`` hops.

    A loop just stops after so many hops. Each title has one row in moves. Ways of 1, 2, 4 ... hops are joined, so ten
    hops take four joins. If ``known`` (title) is given, target is NULL where the way ends at a title that isn't in it.
    """
    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        on = second.select(F.col("title").alias("at"), F.col("target").alias("next"), F.col("steps").alias("more"))
        return first.join(on, first["target"] == on["at"], "left").select(
            "title", F.coalesce("next", "target").alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
        )

    power = moves.select("title", F.col("to").alias("target"), F.lit(1).alias("steps"))
    out = None
    while hops:
        if hops & 1:
            out = power if out is None else then(out, power)
        hops >>= 1
        power = reliable(then(power, power)) if hops else power
    if known is None:
        return out
    here = known.select(F.col("title").alias("target"), F.lit(True).alias("here"))
    return out.join(here, "target", "left").select("title", F.when(F.col("here"), F.col("target")).alias("target"), "steps")


# --- queries ------------------------------------------------------------------------------------------------------
def _pages(spark, d):
    return table(spark, d, "pages")


def _cur(spark, d):
    return current_pages(_pages(spark, d))


def q_txt_links(spark, d):
    links = _cur(spark, d).select("id", F.explode(T.anchor_targets(F.col("text"))).alias("link"))
    return links.select("id", T.strip_fragment(F.col("link")).alias("link")).groupBy("id", "link").agg(F.count(F.lit(1)).alias("n"))


def q_txt_linktext(spark, d):
    return _cur(spark, d).select("id", F.explode(T.anchor_texts(F.col("text"))).alias("shown")).groupBy("id", "shown").agg(F.count(F.lit(1)).alias("n"))


def q_txt_categories(spark, d):
    return _cur(spark, d).select("id", F.explode(T.category_names(F.col("text"))).alias("cat")).distinct()


def q_txt_page_type(spark, d):
    return with_type(_cur(spark, d)).select(
        "id", "type", T.is_redirect(F.col("redirect")).alias("is_redirect"), T.is_list_title(F.col("title")).alias("is_list"),
        T.is_disambiguation(F.col("text")).alias("is_dab"),
    )


def q_txt_dab_links(spark, d):
    dabs = with_type(_cur(spark, d)).where("type = 'dab'")
    return dabs.select("id", F.explode(T.disambiguation_links(F.col("text"))).alias("link")).groupBy("id", "link").agg(F.count(F.lit(1)).alias("n"))


def q_txt_unique_words(spark, d):
    return _cur(spark, d).where("text is not null").select("id", T.unique_words(F.col("text")).cast("bigint").alias("words"))


def q_txt_repeat_title(spark, d):
    return _cur(spark, d).select("id", T.repeat_title(F.col("text"), F.col("title"), 3).alias("text"))


def q_txt_strip_html(spark, d):
    return _cur(spark, d).select("id", F.md5(T.strip_html(F.col("text"))).alias("digest"))


def q_txt_strip_refs(spark, d):
    return _cur(spark, d).select("id", F.md5(T.strip_refs(F.col("text"))).alias("digest"))


def q_txt_strip_comments(spark, d):
    return _cur(spark, d).select("id", F.md5(T.strip_comments(F.col("text"))).alias("digest"))


def q_txt_strip_external_links(spark, d):
    return _cur(spark, d).select("id", F.md5(T.strip_external_links(F.col("text"))).alias("digest"))


def q_txt_strip_formatting(spark, d):
    return _cur(spark, d).select("id", F.md5(T.strip_formatting(F.col("text"))).alias("digest"))


def q_txt_collapse_newlines(spark, d):
    return _cur(spark, d).select("id", F.md5(T.collapse_newlines(F.col("text"))).alias("digest"))


def q_txt_strip_lines(spark, d):
    """List items, orphaned brackets and magic words."""
    s = T.strip_magic_words(T.strip_orphaned_brackets(T.strip_list_items(F.col("text"))))
    return _cur(spark, d).select("id", F.md5(s).alias("digest"))


def q_txt_strip_sections(spark, d):
    return _cur(spark, d).select("id", T.strip_sections(F.col("text")).alias("text"))


def q_txt_strip_start(spark, d):
    return _cur(spark, d).select("id", T.strip_indented_start(F.col("text")).alias("text"))


def _stripped(strip):
    return lambda spark, d: _cur(spark, d).select("id", strip(F.col("text")).alias("text"))


def q_txt_strip_everything(spark, d):
    return _cur(spark, d).select("id", balanced.strip_everything(F.col("text")).alias("text"))


def q_phrase_normalize(spark, d):
    gold = table(spark, d, "gold")
    both = gold.select(F.explode(F.array("phrase1", "phrase2")).alias("phrase")).distinct()
    return both.select("phrase", T.normalize_phrase(F.col("phrase")).alias("normal"))


def q_title_spaces(spark, d):
    return _pages(spark, d).select("title").distinct().select("title", T.spaced_title(F.col("title")).alias("spaced"), canonical_title(F.col("title")).alias("canonical"))


def q_category_clean(spark, d):
    return table(spark, d, "page_cat").select("cat").distinct().select("cat", T.clean_category(F.col("cat")).alias("clean"))


def q_page_filter(spark, d):
    return included(_cur(spark, d), min_words=MIN_WORDS, min_links=MIN_LINKS).select("id", "title")


def q_index_projection(spark, d):
    """Fields of a named index, absent ones left out."""
    return _cur(spark, d).select("id", "ns", "title", F.size(T.anchor_targets(F.col("text"))).cast("bigint").alias("n_links"))


def q_id_title_lookup(spark, d):
    found = title_ids(_pages(spark, d))
    wanted = table(spark, d, "deletions").select(canonical_title(F.col("title")).alias("title")).where(present(F.col("title"))).distinct()
    return wanted.join(found, "title", "left")


def q_redirect_follow(spark, d):
    cur = current_pages(_pages(spark, d).select("id", "title", "redirect", "touched", "loaded", F.lit(None).cast("string").alias("text")))
    moves = cur.select(canonical_title(F.col("title")).alias("title"), canonical_title(F.col("redirect")).alias("to"))
    moves = moves.where(present(F.col("title")) & present(F.col("to"))).groupBy("title").agg(F.min("to").alias("to"))
    return follow_redirects(moves, known=title_ids(_pages(spark, d)).select("title"))


def q_gold_clean(spark, d):
    a, b = T.clean_gold(F.col("phrase1"), F.col("phrase2"))
    return table(spark, d, "gold").select(a.alias("a"), b.alias("b"), "similarity")


def q_valid_titles(spark, d):
    """Titles fit as ids of concepts: normal pages that begin with neither a year nor a month and aren't digits only."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    normal = with_type(_cur(spark, d)).where("type = 'normal' and ns = 0 and title is not null")
    return normal.where(~F.col("title").rlike(f"^(?:[0-9]{{4}}|{months})") & ~F.col("title").rlike("^[0-9]+$")).select("id", "title")


QUERIES = {
    "txt_links": q_txt_links, "txt_linktext": q_txt_linktext, "txt_categories": q_txt_categories, "txt_page_type": q_txt_page_type,
    "txt_dab_links": q_txt_dab_links, "txt_unique_words": q_txt_unique_words, "txt_repeat_title": q_txt_repeat_title,
    "txt_strip_html": q_txt_strip_html, "txt_strip_refs": q_txt_strip_refs, "txt_strip_comments": q_txt_strip_comments,
    "txt_strip_external_links": q_txt_strip_external_links, "txt_strip_formatting": q_txt_strip_formatting,
    "txt_collapse_newlines": q_txt_collapse_newlines, "txt_strip_lines": q_txt_strip_lines, "txt_strip_sections": q_txt_strip_sections,
    "txt_strip_start": q_txt_strip_start, "txt_strip_templates": _stripped(balanced.strip_templates), "txt_strip_tables": _stripped(balanced.strip_tables),
    "txt_strip_links": _stripped(balanced.strip_links), "txt_strip_isolated_links": _stripped(balanced.strip_isolated_links),
    "txt_strip_non_article_links": _stripped(balanced.strip_non_article_links), "txt_strip_images": _stripped(balanced.strip_image_links),
    "txt_strip_everything": q_txt_strip_everything,
    "phrase_normalize": q_phrase_normalize, "title_canonicalize": q_title_spaces, "category_clean": q_category_clean,
    "page_filter": q_page_filter, "index_projection": q_index_projection, "id_title_lookup": q_id_title_lookup,
    "redirect_follow": q_redirect_follow, "gold_clean": q_gold_clean, "valid_titles": q_valid_titles,
}

CUR_SQL = """
cur as (select * exclude (rn) from (select *, row_number() over (partition by id order by touched desc nulls last, loaded desc nulls last) as rn
  from pages where id is not null) where rn = 1)
"""
_C = f"with {CUR_SQL} "
_CANON = "trim(regexp_replace(split_part({0}, '#', 1), '[\\s_\\x{{a0}}]+', ' ', 'g'))"
_LINKS = r"""regexp_extract_all(text, '\[\[([^\]]*)\]\]', 1)"""
_TARGETS = f"list_transform(list_filter({_LINKS}, lambda x: not contains(split_part(x, '|', 1), 'Image:')), lambda x: regexp_replace(trim(split_part(x, '|', 1)), '\\s+', '_', 'g'))"
# RE2 has no look-ahead: "dab" not followed by "link", and "disambig..." that isn't "disambiguation needed".
_DAB = (
    r"coalesce(list_bool_or(list_transform(regexp_extract_all(lower(text), '\{\s*\{\s*((?:disambiguation needed|dablink|[a-z]+))', 1), "
    "lambda x: x not in ('disambiguation needed', 'dablink') and not starts_with(x, 'dablink') and ("
    + " or ".join(f"starts_with(x, '{p}')" for p in T.DAB_PREFIXES)
    + "))), false)"
)
_LISTED = "regexp_matches(lower(title), '(?:^|[^a-z0-9])list[^a-z0-9]+of(?:[^a-z0-9]|$)')"
_TYPE = f"case when redirect is not null then 'redirect' when {_DAB} then 'dab' when {_LISTED} then 'list' else 'normal' end"
_BULLET = r"""\*(?:[ "'']*)?\s*\[\[([^\]]+?)\]\](?:[ ''"]*)?"""
_REFS = r"""regexp_replace(regexp_replace(regexp_replace({0}, '<ref\\>', '', 'g'), '<ref>(.*?)</ref>', '', 'gs'), '<ref\s(.*?)>(.*?)</ref>', '', 'gs')"""
_COMMENTS = "regexp_replace({0}, '<!--(.*?)-->', '', 'gs')"
_FORMAT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '''{2,}', '', 'g'), '={2,}', '', 'g'), '\n:+', chr(10), 'g'), '\n(\*+)[^a-zA-Z0-9_]*', chr(10), 'g')"""
_WORDS = r"len(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))"


def _digest(expr: str) -> str:
    return f"{_C} select id, md5({expr}) as digest from cur"


def _balanced_ctes(source: str, out: str, opener: str, closer: str, by: str) -> str:
    """CTEs from ``source`` (id, text) to ``out`` (id, text): outermost balanced spans by running sums, the depth after each
    mark being its sum less the least sum so far.

    ``by`` is an expression of inside, before (all text before the span) and after (all text behind it).
    """
    marks, o = f"{re.escape(opener)}|{re.escape(closer)}", out
    return rf"""{o}_cut as (select id, text, regexp_split_to_array(text, '{marks}') as parts, regexp_extract_all(text, '{marks}') as marks from {source} where text is not null),
      {o}_flat as (select id, text, unnest(range(0, len(parts))) as i, unnest(parts) as part, unnest(list_prepend('', marks)) as mark from {o}_cut),
      {o}_summed as (select *, sum(case mark when '{opener}' then 1 when '{closer}' then -1 else 0 end) over w as s, sum(length(mark) + length(part)) over w - length(part) as spot from {o}_flat window w as (partition by id order by i)),
      {o}_least as (select *, s - least(0, min(s) over (partition by id order by i)) as depth from {o}_summed),
      {o}_marked as (select *, lag(depth, 1, 0) over (partition by id order by i) as above, max(i) filter (depth = 0) over (partition by id) as settled from {o}_least),
      {o}_spans as (select *, count(*) filter (above = 0 and depth = 1) over (partition by id order by i) as span from {o}_marked where i <= settled),
      {o}_texts as (select id, text, span, string_agg(case when above = 0 and depth = 1 then part when depth = 0 and above = 1 then '' else mark || part end, '' order by i) as inside,
          min(spot) - 2 as b, max(spot) as e from {o}_spans where depth > 0 or (depth = 0 and above = 1) group by all),
      {o}_swapped as (select id, span, {by} as new from (select *, left(text, cast(b as bigint)) as before, substr(text, cast(e as bigint) + 1) as after from {o}_texts)),
      {o}_pieces as (select id, i, case when above = 0 then mark || part else part end as piece from {o}_spans where depth = 0
        union all select id, s.i, w.new from {o}_spans s join {o}_swapped w using (id, span) where s.above = 0 and s.depth = 1
        union all select id, i, mark || part from {o}_marked where i > settled),
      {o} as (select id, string_agg(piece, '' order by i) as text from {o}_pieces group by id union all select id, null from {source} where text is null)"""


def _balanced_sql(opener: str, closer: str, by: str) -> str:
    return f"{_C}, {_balanced_ctes('cur', 'stripped', opener, closer, by)} select id, text from stripped"


def _sections_sql(text: str) -> str:
    """Without back-references: the levels are spelled out, the deepest first, as a greedy run of marks tries them."""
    levels = [f"={{{n}}}" for n in range(8, 1, -1)]
    for name in T.DROPPED_SECTIONS:
        title = name.replace(" ", "[ ]")
        inner = "|".join(rf"{h}\s*{title}\s*{h}.*?([^=]{h}[^=])" for h in levels)
        last = "|".join(rf"{h}\s*{title}\s*{h}\W*.*?\n\n" for h in levels)
        kept = "".join(rf"\{i + 1}" for i in range(len(levels)))
        text = f"regexp_replace(regexp_replace({text}, '{inner}', '{kept}', 'gis'), '{last}', chr(10) || chr(10), 'gis')"
    return text


_SHOWN = """case when position(':' in inside) > 1 then substr(inside, position(':' in inside) + 1) else inside end"""
_AFTER_PIPE = f"case when regexp_matches({_SHOWN}, '(?s)^.+[|]') then regexp_replace({_SHOWN}, '(?s)^.*[|]', '') else {_SHOWN} end"

_LINK_TEXT = f"case when lower(left(inside, 6)) = 'image:' then '' else {_AFTER_PIPE} end"
_ISOLATED = r"""case when right(before, 1) = chr(10) and (length(after) <= 1
      or regexp_matches(left(after, cast(least(10, length(after) - 1) as bigint)), '\A\W*(?:\n|\z)')) then '' else '[[' || inside || ']]' end"""


SQL = {
    "txt_strip_start": rf"""{_C} select id, regexp_replace(text, '\A(?:[^\w\n]*(?:[:*][^\n]*)?\n)+', '') as text from cur""",
    "txt_strip_sections": f"{_C} select id, {_sections_sql('text')} as text from cur",
    "txt_strip_everything": f"""{_C}, {_balanced_ctes('cur', 't', '{{', '}}', "''")}, {_balanced_ctes(f"(select id, {_sections_sql('text')} as text from t)", 'b', '{|', '|}', "''")},
      {_balanced_ctes('b', 'a', '[[', ']]', _ISOLATED)}, {_balanced_ctes('a', 'l', '[[', ']]', _LINK_TEXT)},
      h as (select id, regexp_replace(regexp_replace({_REFS.format(_COMMENTS.format('text'))}, '<(.*?)>', '', 'g'), '\\[(http|www)(.*?)\\]', '', 'g') as text from l)
      select id, regexp_replace({_FORMAT}, '\\n{{3,}}', chr(10) || chr(10), 'g') as text from h""",
    "txt_strip_templates": _balanced_sql("{{", "}}", "''"),
    "txt_strip_tables": _balanced_sql("{|", "|}", "''"),
    "txt_strip_links": _balanced_sql("[[", "]]", _LINK_TEXT),
    "txt_strip_isolated_links": _balanced_sql("[[", "]]", _ISOLATED),
    "txt_strip_non_article_links": _stripped(balanced.strip_non_article_links), "txt_strip_images": _stripped(balanced.strip_image_links),
    "txt_strip_everything": q_txt_strip_everything,
    "phrase_normalize": q_phrase_normalize, "title_canonicalize": q_title_spaces, "category_clean": q_category_clean,
    "page_filter": q_page_filter, "index_projection": q_index_projection, "id_title_lookup": q_id_title_lookup,
    "redirect_follow": q_redirect_follow, "gold_clean": q_gold_clean, "valid_titles": q_valid_titles,
}

CUR_SQL = """
cur as (select * exclude (rn) from (select *, row_number() over (partition by id order by touched desc nulls last, loaded desc nulls last) as rn
  from pages where id is not null) where rn = 1)
"""
_C = f"with {CUR_SQL} "
_CANON = "trim(regexp_replace(split_part({0}, '#', 1), '[\\s_\\x{{a0}}]+', ' ', 'g'))"
_LINKS = r"""regexp_extract_all(text, '\[\[([^\]]*)\]\]', 1)"""
_TARGETS = f"list_transform(list_filter({_LINKS}, lambda x: not contains(split_part(x, '|', 1), 'Image:')), lambda x: regexp_replace(trim(split_part(x, '|', 1)), '\\s+', '_', 'g'))"
# RE2 has no look-ahead: "dab" not followed by "link", and "disambig..." that isn't "disambiguation needed".
_DAB = (
    r"coalesce(list_bool_or(list_transform(regexp_extract_all(lower(text), '\{\s*\{\s*((?:disambiguation needed|dablink|[a-z]+))', 1), "
    "lambda x: x not in ('disambiguation needed', 'dablink') and not starts_with(x, 'dablink') and ("
    + " or ".join(f"starts_with(x, '{p}')" for p in T.DAB_PREFIXES)
    + "))), false)"
)
_LISTED = "regexp_matches(lower(title), '(?:^|[^a-z0-9])list[^a-z0-9]+of(?:[^a-z0-9]|$)')"
_TYPE = f"case when redirect is not null then 'redirect' when {_DAB} then 'dab' when {_LISTED} then 'list' else 'normal' end"
_BULLET = r"""\*(?:[ "'']*)?\s*\[\[([^\]]+?)\]\](?:[ ''"]*)?"""
_REFS = r"""regexp_replace(regexp_replace(regexp_replace({0}, '<ref\\>', '', 'g'), '<ref>(.*?)</ref>', '', 'gs'), '<ref\s(.*?)>(.*?)</ref>', '', 'gs')"""
_COMMENTS = "regexp_replace({0}, '<!--(.*?)-->', '', 'gs')"
_FORMAT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '''{2,}', '', 'g'), '={2,}', '', 'g'), '\n:+', chr(10), 'g'), '\n(\*+)[^a-zA-Z0-9_]*', chr(10), 'g')"""
_WORDS = r"len(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))"


def _digest(expr: str) -> str:
    return f"{_C} select id, md5({expr}) as digest from cur"


def _balanced_ctes(source: str, out: str, opener: str, closer: str, by: str) -> str:
    """CTEs from ``source`` (id, text) to ``out`` (id, text): outermost balanced spans by running sums, the depth after each
    mark being its sum less the least sum so far.

    ``by`` is an expression of inside, before (all text before the span) and after (all text behind it).
    """
    marks, o = f"{re.escape(opener)}|{re.escape(closer)}", out
    return rf"""{o}_cut as (select id, text, regexp_split_to_array(text, '{marks}') as parts, regexp_extract_all(text, '{marks}') as marks from {source} where text is not null),
      {o}_flat as (select id, text, unnest(range(0, len(parts))) as i, unnest(parts) as part, unnest(list_prepend('', marks)) as mark from {o}_cut),
      {o}_summed as (select *, sum(case mark when '{opener}' then 1 when '{closer}' then -1 else 0 end) over w as s, sum(length(mark) + length(part)) over w - length(part) as spot from {o}_flat window w as (partition by id order by i)),
      {o}_least as (select *, s - least(0, min(s) over (partition by id order by i)) as depth from {o}_summed),
      {o}_marked as (select *, lag(depth, 1, 0) over (partition by id order by i) as above, max(i) filter (depth = 0) over (partition by id) as settled from {o}_least),
      {o}_spans as (select *, count(*) filter (above = 0 and depth = 1) over (partition by id order by i) as span from {o}_marked where i <= settled),
      {o}_texts as (select id, text, span, string_agg(case when above = 0 and depth = 1 then part when depth = 0 and above = 1 then '' else mark || part end, '' order by i) as inside,
          min(spot) - 2 as b, max(spot) as e from {o}_spans where depth > 0 or (depth = 0 and above = 1) group by all),
      {o}_swapped as (select id, span, {by} as new from (select *, left(text, cast(b as bigint)) as before, substr(text, cast(e as bigint) + 1) as after from {o}_texts)),
      {o}_pieces as (select id, i, case when above = 0 then mark || part else part end as piece from {o}_spans where depth = 0
        union all select id, s.i, w.new from {o}_spans s join {o}_swapped w using (id, span) where s.above = 0 and s.depth = 1
        union all select id, i, mark || part from {o}_marked where i > settled),
      {o} as (select id, string_agg(piece, '' order by i) as text from {o}_pieces group by id union all select id, null from {source} where text is null)"""


def _balanced_sql(opener: str, closer: str, by: str) -> str:
    return f"{_C}, {_balanced_ctes('cur', 'stripped', opener, closer, by)} select id, text from stripped"


def _sections_sql(text: str) -> str:
    """Without back-references: the levels are spelled out, the deepest first, as a greedy run of marks tries them."""
    levels = [f"={{{n}}}" for n in range(8, 1, -1)]
    for name in T.DROPPED_SECTIONS:
        title = name.replace(" ", "[ ]")
        inner = "|".join(rf"{h}\s*{title}\s*{h}.*?([^=]{h}[^=])" for h in levels)
        last = "|".join(rf"{h}\s*{title}\s*{h}\W*.*?\n\n" for h in levels)
        kept = "".join(rf"\{i + 1}" for i in range(len(levels)))
        text = f"regexp_replace(regexp_replace({text}, '{inner}', '{kept}', 'gis'), '{last}', chr(10) || chr(10), 'gis')"
    return text


_SHOWN = """case when position(':' in inside) > 1 then substr(inside, position(':' in inside) + 1) else inside end"""
_AFTER_PIPE = f"case when regexp_matches({_SHOWN}, '(?s)^.+[|]') then regexp_replace({_SHOWN}, '(?s)^.*[|]', '') else {_SHOWN} end"

_LINK_TEXT = f"case when lower(left(inside, 6)) = 'image:' then '' else {_AFTER_PIPE} end"
_ISOLATED = r"""case when right(before, 1) = chr(10) and (length(after) <= 1
      or regexp_matches(left(after, cast(least(10, length(after) - 1) as bigint)), '\A\W*(?:\n|\z)')) then '' else '[[' || inside || ']]' end"""


SQL = {
    "txt_strip_start": rf"""{_C} select id, regexp_replace(text, '\A(?:[^\w\n]*(?:[:*][^\n]*)?\n)+', '') as text from cur""",
    "txt_strip_sections": f"{_C} select id, {_sections_sql('text')} as text from cur",
    "txt_strip_everything": f"""{_C}, {_balanced_ctes('cur', 't', '{{', '}}', "''")}, {_balanced_ctes(f"(select id, {_sections_sql('text')} as text from t)", 'b', '{|', '|}', "''")},
      {_balanced_ctes('b', 'a', '[[', ']]', _ISOLATED)}, {_balanced_ctes('a', 'l', '[[', ']]', _LINK_TEXT)},
      h as (select id, regexp_replace(regexp_replace({_REFS.format(_COMMENTS.format('text'))}, '<(.*?)>', '', 'g'), '\\[(http|www)(.*?)\\]', '', 'g') as text from l)
      select id, regexp_replace({_FORMAT}, '\\n{{3,}}', chr(10) || chr(10), 'g') as text from h""",
    "txt_strip_templates": _balanced_sql("{{", "}}", "''"),
    "txt_strip_tables": _balanced_sql("{|", "|}", "''"),
    "txt_strip_links": _balanced_sql("[[", "]]", f"case when lower(left(inside, 6)) = 'image:' then '' else {_AFTER_PIPE} end"),
    "txt_strip_isolated_links": _balanced_sql("[[", "]]", r"""case when right(before, 1) = chr(10) and (length(after) <= 1
      or regexp_matches(left(after, cast(least(10, length(after) - 1) as bigint)), '\A\W*(?:\n|\z)')) then '' else '[[' || inside || ']]' end"""),
    "txt_strip_non_article_links": _balanced_sql("[[", "]]", f"case when position(':' in inside) = 0 then '[[' || inside || ']]' when position(':' in inside) > 1 then '' else {_AFTER_PIPE} end"),
    "txt_strip_images": _balanced_sql("[[", "]]", "case when lower(left(inside, 6)) = 'image:' then '' else '[[' || inside || ']]' end"),
    "txt_links": f"{_C} select id, split_part(link, '#', 1) as link, count(*) as n from (select id, unnest({_TARGETS}) as link from cur) group by all",
    "txt_linktext": f"""{_C} select id, shown, count(*) as n from (select id, unnest(list_transform(list_filter({_LINKS},
      lambda x: not contains(split_part(x, '|', 1), 'Image:')), lambda x: regexp_replace(x, '^[^|]*\\|', ''))) as shown from cur) group by all""",
    "txt_categories": f"""{_C} select distinct id, substr(link, 10) as cat from (select id, split_part(unnest({_TARGETS}), '#', 1) as link from cur)
      where lower(link) like 'category:%'""",
    "txt_page_type": f"{_C} select id, {_TYPE} as type, redirect is not null as is_redirect, {_LISTED} as is_list, case when text is null then null else {_DAB} end as is_dab from cur",
    "txt_dab_links": f"""{_C}, b as (select id, text, regexp_extract(text, '(?s)^(.*?){_BULLET}', 1) as lead0, regexp_matches(text, '{_BULLET}') as has
        from cur where {_TYPE} = 'dab')
      select id, split_part(link, '#', 1) as link, count(*) as n from (
        select id, unnest({_TARGETS}) as link from (select id, case when has then lead0 else '' end as text from b)
        union all
        select id, split_part(x, '|', 1) from (select id, unnest(regexp_extract_all(text, '{_BULLET}', 1)) as x from b) where not contains(split_part(x, '|', 1), 'Image:'))
      group by all""",
    "txt_unique_words": f"{_C} select id, {_WORDS} as words from cur where text is not null",
    "txt_repeat_title": f"{_C} select id, text || repeat(chr(10) || title, 3) as text from cur",
    "txt_strip_html": _digest("regexp_replace(" + _REFS.format(_COMMENTS.format("text")) + ", '<(.*?)>', '', 'g')"),
    "txt_strip_refs": _digest(_REFS.format("text")),
    "txt_strip_comments": _digest(_COMMENTS.format("text")),
    "txt_strip_external_links": _digest(r"regexp_replace(text, '\[(http|www)(.*?)\]', '', 'g')"),
    "txt_strip_formatting": _digest(_FORMAT),
    "txt_collapse_newlines": _digest(r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')"),
    "txt_strip_lines": _digest(
        r"regexp_replace(regexp_replace(regexp_replace(text, '\n\s*[#*]+\s*(.*?)\n', chr(10), 'g'), '\([^a-zA-Z0-9_]*?\)', '', 'g'), '__([A-Z]+__)', '', 'g')"
    ),
    "phrase_normalize": r"""select phrase, trim(lower(regexp_replace(phrase, '[^\p{L}\p{N}]+', ' ', 'g'))) as normal
      from (select phrase1 as phrase from gold union select phrase2 from gold)""",
    "title_canonicalize": f"select distinct title, replace(title, '_', ' ') as spaced, {_CANON.format('title')} as canonical from pages",
    "category_clean": "select distinct cat, regexp_replace(lower(replace(cat, '_', ' ')), '^category:', '') as clean from page_cat",
    "page_filter": f"""{_C} select id, title from cur where ns = 0 and redirect is null and not coalesce({_LISTED}, false) and not {_DAB}
      and coalesce({_WORDS}, 0) >= {MIN_WORDS} and len(list_distinct(list_transform({_TARGETS}, lambda x: split_part(x, '#', 1)))) >= {MIN_LINKS}""",
    "index_projection": f"{_C} select id, ns, title, case when text is null then null else len({_TARGETS}) end as n_links from cur",
    "id_title_lookup": f"""{_C}, t as (select {_CANON.format('title')} as title, min(id) as id from cur group by 1)
      select w.title, t.id from (select distinct {_CANON.format('title')} as title from deletions) w left join t using (title) where w.title <> ''""",
    "redirect_follow": f"""with recursive {CUR_SQL}, m as (select {_CANON.format('title')} as title, min({_CANON.format('redirect')}) as dest from cur
        where redirect is not null and {_CANON.format('title')} <> '' and {_CANON.format('redirect')} <> '' group by 1),
      f as (select title, dest as target, 1 as steps from m
        union all select f.title, m.dest, steps + 1 from f join m on m.title = f.target where steps < 10)
      select title, case when target in (select {_CANON.format('title')} from cur) then target end as target, steps from (select title, arg_max(target, steps) as target, max(steps) as steps from f group by 1)""",
    "gold_clean": """select lower(replace(least(phrase1, phrase2), '_', ' ')) as a, lower(replace(greatest(phrase1, phrase2), '_', ' ')) as b, similarity from gold""",
    "valid_titles": f"""{_C} select id, title from cur where {_TYPE} = 'normal' and ns = 0 and title is not null
      and not regexp_matches(title, '^(?:[0-9]{{4}}|January|February|March|April|May|June|July|August|September|October|November|December)')
      and not regexp_matches(title, '^[0-9]+$')""",
}
