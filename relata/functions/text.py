"""Scalar functions on page text, titles and phrases, as Column expressions that stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: template prefixes that mark a disambiguation page, and those that only look like it ---------
DAB_PREFIXES = (
    "disambiguation", "disambig", "dab", "disamb", "dmbox", "geodis", "numberdis", "mathdab", "hndis",
    "hospitaldis", "mountainindex", "roaddis", "schooldis", "shipindex",
)
NOT_DAB_PREFIXES = ("dablink", "disambiguation needed")
#: Sections that carry no running text.
DROPPED_SECTIONS = ("see also", "references", "further reading", "external links")
#: File-like link targets are no links.
IMAGE = "Image:"

#: A small list for analyzers that keep most words.
STANDARD_STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]

LINK = r"\[\[([^\]]*)\]\]"
BULLET_LINK = r"\*(?:[ \"']*)?\s*\[\[([^\]]+?)\]\](?:[ '\"]*)?"


def _target(inner: Column) -> Column:
    """The target of a link's inside: cut at the first pipe."""
    return F.substring_index(inner, "|", 1)


def anchor_targets(text: Column) -> Column:
    """Targets of all links, white space as ``_``, image links left out, fragments kept; NULL for NULL."""
    targets = F.transform(F.regexp_extract_all(text, F.lit(LINK), 1), _target)
    kept = F.filter(targets, lambda t: ~F.contains(t, F.lit(IMAGE)))
    return F.transform(kept, lambda t: F.regexp_replace(F.trim(t), r"\s+", "_"))


def strip_fragment(link: Column) -> Column:
    return F.substring_index(link, "#", 1)


def anchor_texts(text: Column) -> Column:
    """Display texts of all links: what follows the first pipe, else the whole inside; image links left out."""
    inner = F.filter(F.regexp_extract_all(text, F.lit(LINK), 1), lambda x: ~F.contains(_target(x), F.lit(IMAGE)))
    return F.transform(inner, lambda x: F.when(F.contains(x, F.lit("|")), F.regexp_replace(x, r"^[^|]*\|", "")).otherwise(x))


def category_names(text: Column) -> Column:
    """Names of the categories a page links to, without their prefix and fragment."""
    links = F.transform(anchor_targets(text), strip_fragment)
    cats = F.filter(links, lambda t: F.lower(t).startswith("category:"))
    return F.transform(cats, lambda t: F.substring(t, 10, 1_000_000))


def is_list_title(title: Column) -> Column:
    return F.lower(title).rlike(r"(?:^|[^a-z0-9])list[^a-z0-9]+of(?:[^a-z0-9]|$)")


def is_redirect(redirect: Column) -> Column:
    return redirect.isNotNull()


_DAB = r"\{\s*\{\s*(?:(?!" + "|".join(NOT_DAB_PREFIXES) + ")(?:" + "|".join(DAB_PREFIXES) + "))"


def is_disambiguation(text: Column) -> Column:
    return F.lower(text).rlike(_DAB)


def disambiguation_links(text: Column) -> Column:
    """Bulleted links, and before them all links that come before the first bulleted one; fragments cut."""
    bulleted = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(BULLET_LINK), 1), _target), lambda t: ~F.contains(t, F.lit(IMAGE))
    )
    first = F.regexp_instr(text, F.lit(BULLET_LINK))
    lead = F.when(first > 1, F.substring(text, F.lit(1), first - 1)).otherwise(F.lit(""))
    return F.transform(F.concat(anchor_targets(lead), bulleted), strip_fragment)


def page_type(title: Column, redirect: Column, text: Column) -> Column:
    """redirect before dab before list before normal."""
    return (
        F.when(is_redirect(redirect), "redirect").when(is_disambiguation(text), "dab").when(is_list_title(title), "list").otherwise("normal")
    )


def unique_words(text: Column) -> Column:
    """Number of different words of the raw text, split at white space, case counts."""
    return F.size(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != "")))


def repeat_title(text: Column, title: Column, times: int) -> Column:
    """The text with the title appended ``times`` times, each on a line of its own."""
    return F.concat(text, F.repeat(F.concat(F.lit("\n"), title), times))


def normalize_phrase(s: Column) -> Column:
    """Runs of what is neither letter nor digit become one space; lower case; trimmed."""
    return F.trim(F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")))


def spaced_title(s: Column) -> Column:
    return F.translate(s, "_", " ")


def clean_category(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.translate(s, "_", " ")), "^category:", "")


# --- what the stripping of markup takes away, as far as regular expressions can; the patterns are fixed values -----
def strip_refs(s: Column) -> Column:
    for pattern in (r"<ref\\>", r"(?s)<ref>(.*?)</ref>", r"(?s)<ref\s(.*?)>(.*?)</ref>"):
        s = F.regexp_replace(s, pattern, "")
    return s


def strip_comments(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)<!--(.*?)-->", "")


def strip_html(s: Column) -> Column:
    """Comments, references, then any tag that ends on its line."""
    return F.regexp_replace(strip_refs(strip_comments(s)), r"<(.*?)>", "")


def strip_external_links(s: Column) -> Column:
    return F.regexp_replace(s, r"\[(http|www)(.*?)\]", "")


def strip_formatting(s: Column) -> Column:
    """Quotes of bold and italic, heading marks, indents and list markers."""
    for pattern, by in ((r"'{2,}", ""), (r"={2,}", ""), (r"\n:+", "\n"), (r"\n(\*+)\W*", "\n")):
        s = F.regexp_replace(s, pattern, by)
    return s


def collapse_newlines(s: Column) -> Column:
    return F.regexp_replace(s, r"\n{3,}", "\n\n")


def strip_list_items(s: Column) -> Column:
    return F.regexp_replace(s, r"\n\s*[#*]+\s*(.*?)\n", "\n")


def strip_orphaned_brackets(s: Column) -> Column:
    return F.regexp_replace(s, r"\(\W*?\)", "")


def strip_magic_words(s: Column) -> Column:
    return F.regexp_replace(s, r"__([A-Z]+__)", "")


def strip_headings(s: Column) -> Column:
    return F.regexp_replace(s, r"(={2,})([^=]+)(\1)", "")


def strip_section(s: Column, name: str) -> Column:
    """A section up to the next heading of its level; if it is the last one, its title and the paragraph below."""
    s = F.regexp_replace(s, rf"(?is)(={{2,}})\s*{name}\s*\1.*?([^=]\1[^=])", "$2")
    return F.regexp_replace(s, rf"(?is)(={{2,}})\s*{name}\s*\1\W*.*?\n\n", "\n\n")


def strip_sections(s: Column) -> Column:
    return reduce(strip_section, DROPPED_SECTIONS, s)


def strip_indented_start(s: Column) -> Column:
    """Whole lines at the beginning go that hold no word, or none before their first colon or asterisk."""
    return F.regexp_replace(s, r"\A(?:[^\w\n]*(?:[:*][^\n]*)?\n)+", "")


# --- terms and phrases --------------------------------------------------------------------------------------------
def word_tokens(text: Column) -> Column:
    """Runs of letters, marks and digits of any script, in lower case; the last form of sigma and the dotted capital I
    are folded, as their lower case depends on where they stand and on the language."""
    spaced = F.translate(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", " "), "\u0130", "I")
    return F.filter(F.split(F.translate(F.lower(spaced), "\u03c2", "\u03c3"), " "), lambda t: t != "")


#: The same in the SQL that queries are compared with, of a column ``text``.
WORD_TOKENS_SQL = (
    "list_filter(string_split(replace(lower(replace(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'), '\u0130', 'I')), '\u03c2', '\u03c3'), ' '), lambda t: t <> '')"
)


def remove_words(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(words))


def link_fraction(flags: Column) -> tuple[Column, Column]:
    """(numerator, denominator) of the flag ``W:num/den``; NULL where there is none."""
    pattern = r"(?:^|\s)W:(\d+)/(\d+)(?:\s|$)"
    part = lambda i: F.when(flags.rlike(pattern), F.regexp_extract(flags, pattern, i).cast("int"))
    return part(1), part(2)


def clean_gold(a: Column, b: Column) -> tuple[Column, Column]:
    """The two phrases ordered as they stand, then with ``_`` as space and in lower case."""
    clean = lambda c: F.lower(F.translate(c, "_", " "))
    return clean(F.least(a, b)), clean(F.greatest(a, b))


def feature_slug(name: str, position: int | None = None) -> str:
    """Lower-case letters of a metric's name; with its position, as names that differ in digits only would collide."""
    slug = re.sub(r"[^a-z]", "", name.lower())
    return slug if position is None else f"{slug}_{position}"
