"""Markup that regular expressions can't balance: nested templates, tables and links, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from relata.functions import text as T


def outermost(s: str, opener: str, closer: str) -> list[tuple[int, int]]:
    """Spans (begin, end) of the outermost balanced ``opener ... closer``. A closer without an opener is text; from an
    opener that never closes on, nothing is balanced."""
    spans: list[tuple[int, int]] = []
    depth = begin = 0
    for m in re.finditer(f"{re.escape(opener)}|{re.escape(closer)}", s):
        if m.group() == opener:
            begin = begin if depth else m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                spans.append((begin, m.end()))
    return spans


def replaced(s: str, opener: str, closer: str, by: Callable[[str, int, int], str]) -> str:
    """s with each outermost balanced span replaced by ``by(inside, begin, end)``."""
    out, at = [], 0
    for begin, end in outermost(s, opener, closer):
        out += [s[at:begin], by(s[begin + len(opener) : end - len(closer)], begin, end)]
        at = end
    return "".join(out) + s[at:]


def cut_balanced(s: str, opener: str, closer: str) -> str:
    return replaced(s, opener, closer, lambda inside, begin, end: "")


def shown(inside: str, dropped: tuple[str, ...] | None) -> str:
    """The text of a link: what follows the first colon, of that what follows the last pipe. A link whose part before
    the colon is one of ``dropped``, in any case, has none, nor has one with any such part if ``dropped`` is None.
    A colon or pipe in the first place doesn't count."""
    prefix, colon, rest = inside.partition(":")
    if colon and prefix:
        if dropped is None or prefix.lower() in dropped:
            return ""
        inside = rest
    before, pipe, after = inside.rpartition("|")
    return after if pipe and before else inside


#: How far an isolated link is looked around for the end of its line.
NEARBY = 10


def isolated(s: str, begin: int, end: int) -> bool:
    """A link that begins its line, on a line after the first, with no word between its end and that of the line."""
    after = s[end : min(len(s) - 1, end + NEARBY)]
    blank = re.match(r"\W*", after, re.A)[0]
    return s[max(0, begin - 1) : begin] == "\n" and (end >= len(s) - 1 or "\n" in blank or blank == after)


def replace_links(s: str, kind: str = "all") -> str:
    """Outermost links replaced. ``all``: by their text, image links by none; ``isolated``: those alone on their line go;
    ``prefixed``: links with a colon by their text if nothing stands before it, else by none; ``images``: image links go.
    """

    def by(inside: str, begin: int, end: int) -> str:
        kept = f"[[{inside}]]"
        if kind == "isolated":
            return "" if isolated(s, begin, end) else kept
        if kind == "images":
            return "" if inside.lower().startswith("image:") else kept
        if kind == "prefixed":
            return shown(inside, None) if ":" in inside else kept
        return shown(inside, ("image",))

    return replaced(s, "[[", "]]", by)


def _udf(f):
    @pandas_udf(StringType())
    def apply(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return apply


strip_templates = _udf(lambda s: cut_balanced(s, "{{", "}}"))
strip_tables = _udf(lambda s: cut_balanced(s, "{|", "|}"))
strip_links = _udf(lambda s: replace_links(s))
strip_isolated_links = _udf(lambda s: replace_links(s, "isolated"))
strip_non_article_links = _udf(lambda s: replace_links(s, "prefixed"))
strip_image_links = _udf(lambda s: replace_links(s, "images"))


def strip_everything(s: Column) -> Column:
    """Templates, text-less sections, tables, links alone on a line, links, HTML, external links, formatting and
    surplus newlines, in this order. NULL stays NULL, '' stays ''."""
    s = T.strip_sections(strip_templates(s))
    s = strip_links(strip_isolated_links(strip_tables(s)))
    return T.collapse_newlines(T.strip_formatting(T.strip_external_links(T.strip_html(s))))


def strip_everything_python(s: str) -> str:
    """The balanced part of :func:`strip_everything` on one string, for tests."""
    return replace_links(replace_links(cut_balanced(cut_balanced(s, "{{", "}}"), "{|", "|}"), "isolated"))


