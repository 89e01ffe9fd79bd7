"""Clean text and structural elements out of wiki, HTML, Markdown and LaTeX markup (problem 1).

One page is read in three steps. First every opaque region (comment, code block, formula, literal passage, script,
footnote) is swapped for a marker, leftmost region first, so that nothing inside it can be taken for markup. Then
templates and tables go, and with them the markers inside. At last the markers that are left, the line
markup of the page's own syntax and the HTML that every syntax may embed yield the elements.

The method named for this problem (inferring union-free regular expressions by aligning pages of one host) learns
which parts of a page belong to a site's template. It can't tell a heading from a list item nor a code block from a
formula, and these tables have no host column, so this recogniser is used instead; see the README.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.session import table

# --- fixed values: names defined by the four syntaxes ----------------------------------------------------------
TEX_CODE = "verbatim|Verbatim|lstlisting|minted|alltt"
TEX_MATH = "equation|align|gather|multline|displaymath|math|eqnarray|alignat|flalign"
TEX_DROP = "tabular|tabularx|table|longtable|figure|thebibliography|comment"
TEX_LISTS = "itemize|enumerate|description"
TEX_SILENT = "label|cite|citep|citet|ref|eqref|pageref|index|vspace|hspace|input|include|usepackage|documentclass|bibliography"
HIDDEN_LINKS = "file|image|category|media"
# ----------------------------------------------------------------------------------------------------------------

MARK = re.compile("\x01(\\d+)\x02")
#: Characters that stand for something of our own below; those of a text become spaces.
_OWN_MARKS = re.compile("[\x01-\x06]")
_ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_OPAQUE_HTML = (
    r"<!--.*?(?:-->|\Z)"
    r"|<nowiki\s*>(?P<nowiki>.*?)(?:</nowiki\s*>|\Z)"
    rf"|<pre(?=[\s>]){_ATTRS}>(?P<pre>.*?)(?:</pre\s*>|\Z)"
    rf"|<(?P<src>source|syntaxhighlight)(?=[\s>]){_ATTRS}(?<!/)>(?P<source>.*?)(?:</(?P=src)\s*>|\Z)"
    rf"|<math(?=[\s>]){_ATTRS}>(?P<math>.*?)(?:</math\s*>|\Z)"
    rf"|<(?P<mute>script|style)(?=[\s>]){_ATTRS}>.*?(?:</(?P=mute)\s*>|\Z)"
    rf"|<ref(?=[\s/>])(?:{_ATTRS}/>|{_ATTRS}(?<!/)>.*?(?:</ref\s*>|\Z))"
)
_I, _IS, _M = re.I, re.I | re.S, re.M
_TEX_PARENS = r"|\\\[(?P<m1>.+?)\\\]|\\\((?P<m2>.+?)\\\)|\$\$(?P<m3>.+?)\$\$"
_TEX_INLINE = r"|(?<![\\$\w])\$(?P<m4>(?![\s$])(?:[^$\\\n]|\\.|\n(?![ \t]*\n))*?(?<!\s))\$(?![\d$])"
_FENCE = r"(?m:^)[ \t]*(?P<fence>`{3,}|~{3,})[^\n`]*\n(?P<fenced>.*?)(?:(?m:^)[ \t]*(?P=fence)[`~]*[ \t]*(?m:$)|\Z)"
_SPAN = r"|(?P<tick>`+)(?P<span>[^`](?:.(?!\n[ \t]*\n))*?)(?<!`)(?P=tick)(?!`)"

WIKI = re.compile(_OPAQUE_HTML, _IS)
HTML = re.compile(_OPAQUE_HTML + _TEX_PARENS, _IS)
MARKDOWN = re.compile(_FENCE + "|" + _OPAQUE_HTML + _SPAN + _TEX_PARENS + _TEX_INLINE, _IS)
TEX = re.compile(
    rf"\\begin\{{(?P<env>(?:{TEX_CODE})\*?)\}}(?:\[[^\]\n]*\])?(?P<code>.*?)(?:\\end\{{(?P=env)\}}|\Z)"
    rf"|\\begin\{{(?P<eqn>(?:{TEX_MATH})\*?)\}}(?P<m5>.*?)(?:\\end\{{(?P=eqn)\}}|\Z)"
    r"|\\verb\*?(?P<bar>[^\w\s])(?P<verb>[^\n]*?)(?P=bar)"
    r"|(?<!\\)%[^\n]*" + _TEX_PARENS.replace(r"|\\\[", r"|(?<!\\)\\\[") + _TEX_INLINE + "|" + _OPAQUE_HTML,
    re.S,
)
_NESTED = re.compile(r"\{\{|\}\}|\{\||\|\}(?!\})")
_TABLE = re.compile(rf"<table(?=[\s>]){_ATTRS}>(?:(?!<table[\s>]).)*?</table\s*>", _IS)
_DROPPED_ENV = re.compile(rf"\\begin\{{(?P<e>(?:{TEX_DROP})\*?)\}}.*?\\end\{{(?P=e)\}}", re.S)
_INDENTED = re.compile(r"(?:\A|(?<=\n))(?:[ \t]*\n)*((?:(?: {4}|\t)[^\n]*(?:\n|\Z)|[ \t]*\n(?=(?: {4}|\t)))+)")

_HTML_HEAD = re.compile(rf"<h([1-6])(?=[\s>]){_ATTRS}>(.*?)</h\1\s*>", _IS)
_HTML_LIST = re.compile(rf"<(/?)(ul|ol|li)(?=[\s/>]){_ATTRS}>", _I)
_WIKI_HEAD = re.compile(r"(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$")
_WIKI_ITEM = re.compile(r"[*#:;]*[*#](?![*#:;])[ \t]*(.*)$")
_MD_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", _M)
_MD_SETEXT = re.compile(r"^ {0,3}(?![-*+#>|=\s]|\d{1,9}[.)][ \t])(\S[^\n]*)\n {0,3}(?:=+|-+)[ \t]*$", _M)
_MD_ITEM = re.compile(r"^[ \t]*(?:[*+-]|(\d{1,9})[.)])(?:[ \t]+(.*))?$")
_MD_STOP = re.compile(r"^[ \t]*$|^ {0,3}(?:#{1,6}(?:[ \t]|$)|>|\||</?(?:ul|ol|li|h[1-6]|p|pre|table|div)[\s/>])|^\x01\d+\x02$", _I)
_MD_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?[ \t]*(?:\[[^\]\n]*\])?[ \t]*\{")
_TEX_LIST = re.compile(rf"\\(begin|end)\{{(?:{TEX_LISTS})\}}(?:\[[^\]\n]*\])?|\\(item)(?![a-zA-Z])[ \t]*(?:\[[^\]\n]*\])?")
_TEX_FOOT = re.compile(r"\\footnote(?:\[[^\]]*\])?\{|\\footnotetext\{")

_IS_TEX = re.compile(
    rf"\\(?:href\{{|(?:sub)*section\*?\{{|begin\{{(?:{TEX_LISTS}|{TEX_CODE})\}}|documentclass|(?:(?<=\n\\)|(?<=\A\\))textbf\{{)"
)
_IS_HTML = re.compile(r"<p[\s>]|<(?:html|body|div)[\s>]", _I)
_MD_BOLD = re.compile(r"(?:\*\*|__)(?<![^\n]..)(?=\S)[^\n]+?(?:\*\*|__)")
_MD_FENCE = re.compile(r"^ {0,3}(?:`{3,}|~{3,})", _M)
_MD_DEF = re.compile(r"\[[^\[\]\n]+\]:(?!:) ?\S")
_IS_WIKI = re.compile(r"'''|\[\[|\{\{")
_MD_ONLY = re.compile(r"^#{1,6} ", _M)


def syntax_of(text: str) -> str:
    """The page's own syntax: tex, html, md or wiki. Other syntaxes may still be embedded in it."""
    if "\\" in text and _IS_TEX.search(text):
        return "tex"
    if "<" in text and _IS_HTML.search(text):
        return "html"
    if "](" in text or "[^" in text or ("**" in text or "__" in text) and _MD_BOLD.search(text):
        return "md"
    if ("```" in text or "~~~" in text) and _MD_FENCE.search(text) or "]:" in text and _MD_DEF.search(text):
        return "md"
    return "md" if not _IS_WIKI.search(text) and _MD_ONLY.search(text) else "wiki"


def _closing(s: str, start: int) -> int:
    """Index of the brace that closes the group whose content begins at start, or -1."""
    depth, i = 1, start
    while True:
        a, b = s.find("{", i), s.find("}", i)
        if b < 0:
            return -1
        if 0 <= a < b:
            depth, i = depth + (s[a - 1] != "\\"), a + 1
            continue
        depth, i = depth - (s[b - 1] != "\\"), b + 1
        if not depth:
            return b


def _cut_groups(s: str, opener: re.Pattern) -> str:
    """s without every ``opener{...}`` with balanced braces."""
    out, at = [], 0
    for m in opener.finditer(s):
        if m.start() < at:
            continue
        end = _closing(s, m.end())
        if end < 0:
            break
        out.append(s[at : m.start()])
        at = end + 1
    return "".join(out) + s[at:] if out or at else s


def _cut_nested(s: str) -> str:
    """s without outermost balanced ``{{...}}`` and ``{|...|}``; what never closes stays."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in _NESTED.finditer(s):
        token = m.group()
        if token in ("{|", "|}") and s[s.rfind("\n", 0, m.start()) + 1 : m.start()].strip(" \t:"):
            continue  # a table begins and ends at the beginning of a line
        if token in ("{{", "{|"):
            stack.append((token, m.start()))
        elif stack and stack[-1][0] == ("{{" if token == "}}" else "{|"):
            _, begin = stack.pop()
            while spans and spans[-1][0] >= begin:
                spans.pop()
            spans.append((begin, m.end()))
    out, at = [], 0
    for begin, end in spans:
        out.append(s[at:begin])
        at = end
    return "".join(out) + s[at:] if spans else s


# --- inline ------------------------------------------------------------------------------------------------------
_SPECIAL = re.compile(r"[<&\[\\'*_`$~{}\x01]")
_SPACE = re.compile(r"\s+")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(rf"<ref(?=[\s/>])(?:{_ATTRS}/>|{_ATTRS}(?<!/)>.*?(?:</ref\s*>|\Z))", _IS)
_BREAK = re.compile(r"<(?:br|hr|/?p|/?div|/?li|/?ul|/?ol|/?tr|/?td|/?th|/?h[1-6])(?:\s[^<>]*)?/?>", _I)
_TAG = re.compile(rf"</?[a-zA-Z][\w:-]*(?:\s{_ATTRS})?/?>")
_WIKI_LINK = re.compile(r"\[\[(?!\[)[ \t]*(:?)([^\[\]|\n]*)(?:\|([^\[\]]*))?\]\]")
_HIDDEN = re.compile(rf"(?:{HIDDEN_LINKS})[ \t]*:", _I)
_EXTERNAL = re.compile(r"\[(?:https?:)?//[^\s\]]+(?:[ \t]+([^\]\n]*))?\]")
_QUOTES = re.compile(r"'{2,5}")
_MD_LINK = re.compile(r"!?\[([^\[\]]*)\]\((?:<[^<>\n]*>|(?:[^()\s<>]|\([^()\s]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_MD_FOOT = re.compile(r"\[\^[^\[\]\s]+\]")
_MD_REFLINK = re.compile(r"\[([^\[\]]+)\]\[[^\[\]]*\]")
_AUTOLINK = re.compile(r"<((?:https?|mailto|ftp):[^\s<>]*)>")
_STARS = re.compile(r"(?<![*\\])(\*{1,3})(?![*\s])([^*\n]+?|(?:.(?!\n\n))+?)(?<![\s\\])\1(?!\*)", re.S)
_UNDERS = re.compile(r"(?<![\w\\])(_{1,3})(?![_\s])(.+?)(?<!\s)\1(?!\w)", re.S)
_STRIKE = re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S)
_TICKS = re.compile(r"(`+)([^`]+?)\1(?!`)")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_TEX_HREF = re.compile(r"\\href[ \t]*\{[^{}]*\}[ \t]*(?=\{)")
_TEX_MUTE = re.compile(rf"\\(?:{TEX_SILENT})\*?(?:\[[^\]]*\])?\{{[^{{}}]*\}}")
_TEX_WRAP = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}")
_TEX_WORD = re.compile(r"\\(?:begin|end)\{[^{}]*\}|\\[a-zA-Z]+\*?[ \t]*")
_TEX_ESC = re.compile(r"\\([&%$#_{}])")
_DASHES = re.compile(r"(?<!-)(-{2,3})(?!-)")


def resolve(s: str) -> str:
    """Character references of s resolved, those with a semicolon only."""
    return _ENTITY.sub(lambda m: unescape(m.group()), s) if "&" in s else s


def _settled(pattern: re.Pattern, by, s: str) -> str:
    """s with the innermost matches replaced until none is left; each replacement must be shorter than its match."""
    while True:
        s, n = pattern.subn(by, s)
        if not n:
            return s


def squeeze(s: str) -> str:
    return _SPACE.sub(" ", s).strip()


def _shown(m: re.Match) -> str:
    colon, target, label = m.groups()
    if not colon and _HIDDEN.match(target):
        return ""
    return target if label is None or not label.strip() else label.rpartition("|")[2]


def _tex_inline(s: str, own: bool) -> str:
    if "footnote" in s:
        s = _cut_groups(s, _TEX_FOOT)
    s = s.replace("\\\\", " ")
    s = _TEX_ESC.sub(lambda m: f"\x03{ord(m[1])}\x04", s)
    s = _TEX_HREF.sub("", s)
    s = _TEX_MUTE.sub("", s)
    s = _settled(_TEX_WRAP, r"\1", s)
    if own:
        s = _TEX_WORD.sub("", s)
        s = re.sub(r"\\[,;:! ]", " ", s)
    return s


_BLOCK = re.compile(r"</?(?:p|div|section|article|blockquote|table|tr|dl|dt|dd)(?:\s[^<>]*)?>|<hr\s*/?>", _I)
_KEPT = re.compile("\x03(\\d+)\x04")


def inline(s: str, syntax: str, marks: list[tuple[str, str]] | None = None) -> str:
    """What a reader sees of a run of inline markup; markers of literal passages are filled in last."""
    if not _SPECIAL.search(s):
        return squeeze(s)
    tex = syntax == "tex"
    if marks and "\x01" in s:  # formulas stand in their sentence as TeX; code blocks aren't part of it
        s = MARK.sub(lambda m: m.group() if marks[int(m[1])][0] in ("literal", "formula") else " ", s)
    if "<" in s:
        s = _REF.sub("", _COMMENT.sub("", s))
    if "\\" in s:
        s = _tex_inline(s, tex)
    if "[" in s:
        if "[[" in s:
            s = _settled(_WIKI_LINK, _shown, s)
        if not tex:
            s = _EXTERNAL.sub(lambda m: m[1] or "", s)
            if "](" in s:
                s = _MD_LINK.sub(r"\1", s)
            if syntax in ("md", "any"):
                s = _MD_REFLINK.sub(r"\1", _MD_FOOT.sub("", s))
    if tex:
        s = s.replace("{", "").replace("}", "").replace("~", "\xa0")
        s = _DASHES.sub(lambda m: "\u2013" if len(m[1]) == 2 else "\u2014", s)
        s = s.replace("``", "\u201c").replace("''", "\u201d") if "``" in s else s
    if "''" in s:
        s = _QUOTES.sub("", s)
    if "`" in s:
        s = _TICKS.sub(lambda m: "".join(f"\x03{ord(c)}\x04" for c in m[2].strip()), s)
    if "<" in s:
        s = _TAG.sub("", _BREAK.sub(" ", _AUTOLINK.sub(r"\1", s) if syntax in ("md", "any") else s))
    if "*" in s and not tex:
        s = _settled(_STARS, r"\2", s)
    if syntax in ("md", "any"):
        if "_" in s:
            s = _settled(_UNDERS, r"\2", s)
        if "~~" in s:
            s = _STRIKE.sub(r"\1", s)
        if "\\" in s:
            s = _ESCAPED.sub(r"\1", s)
    s = resolve(s)
    if "\x03" in s:
        s = _KEPT.sub(lambda m: chr(int(m[1])), s)
    if marks and "\x01" in s:
        s = MARK.sub(lambda m: marks[int(m[1])][1], s)
    return squeeze(s)


def clean_anchor(s: str) -> str | None:
    """The clean text of a link's text if it holds markup or character references, else None."""
    shown = inline(s, "any")
    return shown if shown != squeeze(s) else None


# --- whole pages ---------------------------------------------------------------------------------------------------
def _opaque(text: str, syntax: str) -> tuple[str, list[tuple[str, str]]]:
    """text with markers for its opaque regions, and what each marker stands for: (code, formula or literal; body)."""
    marks: list[tuple[str, str]] = []

    def mark(kind: str, body: str, before: str = "", after: str = "") -> str:
        marks.append((kind, body))
        return f"{before}\x01{len(marks) - 1}\x02{after}"

    def swap(m: re.Match) -> str:
        kind = m.lastgroup
        if kind is None:
            return ""
        g = m.groupdict()
        if g.get("pre") is not None:
            body = re.sub(r"\A\s*<code(?:\s[^>]*)?>(.*?)</code\s*>\s*\Z", r"\1", g["pre"], flags=_IS)
            return mark("code", resolve(body), "\n", "\n")
        if g.get("source") is not None:
            return mark("code", g["source"], "\n", "\n")
        if g.get("fenced") is not None or g.get("code") is not None:
            return mark("code", g.get("fenced") if g.get("fenced") is not None else g["code"], "\n", "\n")
        if g.get("nowiki") is not None:
            return mark("literal", resolve(g["nowiki"]))
        for name in ("span", "verb"):
            if g.get(name) is not None:
                return mark("literal", g[name].strip())
        for name in ("math", "m1", "m2", "m3", "m4", "m5"):
            if g.get(name) is not None:
                body = resolve(g[name]) if syntax == "html" or name == "math" else g[name]
                return mark("formula", squeeze(body))
        return ""

    pattern = {"wiki": WIKI, "html": HTML, "md": MARKDOWN, "tex": TEX}[syntax]
    return pattern.sub(swap, text), marks


def _indented_code(text: str, marks: list[tuple[str, str]]) -> str:
    """Blocks indented by four columns after a blank line, unless they continue a list."""

    def swap(m: re.Match) -> str:
        begin = m.start(1)
        above = text[:begin].rstrip(" \t\n").rpartition("\n")[2]
        if begin and not text[:begin].endswith("\n\n") and text[:begin].strip():
            return m.group()
        if _MD_ITEM.match(above) or above[:1] in (" ", "\t"):
            return m.group()
        body = MARK.sub(lambda k: marks[int(k[1])][1], m[1])
        marks.append(("code", body))
        return f"\n\x01{len(marks) - 1}\x02\n"

    return _INDENTED.sub(swap, text)


def _html_items(text: str) -> list[str]:
    """Raw bodies of list items; text of a nested list belongs to its own items only."""
    found: list[str] = []
    lists: list[list[str] | None] = []  # for each open list the parts of its open item

    def finish(parts: list[str] | None) -> None:
        if parts is not None:
            found.append(" ".join(parts))

    at = 0
    for m in _HTML_LIST.finditer(text):
        if lists and lists[-1] is not None:
            lists[-1].append(text[at : m.start()])
        at = m.end()
        closing, name = m[1], m[2].lower()
        if name == "li":
            if not lists:
                lists.append(None)
            finish(lists[-1])
            lists[-1] = None if closing else []
        elif closing:
            if lists:
                finish(lists.pop())
        else:
            lists.append(None)
    if lists:  # a list that never closes ends with its paragraph
        if lists[-1] is not None:
            lists[-1].append(re.split(r"\n[ \t]*\n|<h[1-6][\s>]", text[at:], maxsplit=1)[0])
        for parts in lists:
            finish(parts)
    return found


def _md_lines(text: str) -> tuple[list[str], list[str]]:
    """Raw bodies of headings and of list items."""
    heads, items = [], []
    for m in _MD_SETEXT.finditer(text):
        heads.append(m[1])
    current: list[str] | None = None
    above_blank, in_list = True, False
    for line in text.split("\n"):
        m = None if _MD_RULE.match(line) else _MD_ITEM.match(line)
        if m and (m[1] is None or m[1] == "1" or above_blank or in_list):
            current = [m[2] or ""]
            items.append(current)
            in_list = True
        elif _MD_STOP.match(line):
            above_blank = not line.strip()
            current = None
            in_list = in_list and above_blank
            head = _MD_ATX.match(line)
            if head:
                heads.append(head[1] or "")
            continue
        elif current is not None:
            current.append(line)
        elif not line.startswith((" ", "\t")):
            in_list = False
        above_blank = False
    return heads, ["\n".join(x) for x in items]


def _tex_items(text: str) -> list[str]:
    found: list[str] = []
    lists: list[list[str] | None] = []
    at = 0
    for m in _TEX_LIST.finditer(text):
        if lists and lists[-1] is not None:
            lists[-1].append(text[at : m.start()])
        at = m.end()
        if m[2]:
            if not lists:
                lists.append(None)
            if lists[-1] is not None:
                found.append(" ".join(lists[-1]))
            lists[-1] = []
        elif m[1] == "begin":
            lists.append(None)
        elif lists:
            parts = lists.pop()
            if parts is not None:
                found.append(" ".join(parts))
    for i, parts in enumerate(lists):
        if parts is not None:
            if i == len(lists) - 1:
                parts.append(re.split(r"\n[ \t]*\n", text[at:], maxsplit=1)[0])
            found.append(" ".join(parts))
    return found


def _prepared(text: str) -> tuple[str, str, list[tuple[str, str]]]:
    """(syntax, text without opaque regions, templates and tables, its markers)."""
    if _OWN_MARKS.search(text):
        text = _OWN_MARKS.sub(" ", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    syntax = syntax_of(text)
    rest, marks = _opaque(text, syntax)
    if syntax == "md" and ("\n    " in rest or "\n\t" in rest or rest[:4] == "    "):
        rest = _indented_code(rest, marks)
    if syntax == "tex":
        rest = _cut_groups(_DROPPED_ENV.sub(" ", rest), _TEX_FOOT)
    elif "{{" in rest or "{|" in rest:
        rest = _cut_nested(rest)
    if "<" in rest and syntax != "tex":
        rest = _settled(_TABLE, "\n", rest)
    return syntax, rest, marks


def elements(text: str | None) -> list[tuple[str, str]]:
    """Distinct (kind, body) of a page; nothing for NULL, empty and blank text."""
    if not text or text.isspace():
        return []
    syntax, rest, marks = _prepared(text)
    out: dict[tuple[str, str], None] = {}
    for m in MARK.finditer(rest):
        kind, body = marks[int(m[1])]
        if kind != "literal":
            out[kind, squeeze(body)] = None
    heads: list[str] = []
    items: list[str] = []
    if syntax == "wiki":
        for line in rest.split("\n"):
            first = line[:1]
            if first == "=":
                if m := _WIKI_HEAD.match(line):
                    heads.append(m[2])
            elif first and first in "*#:;" and (m := _WIKI_ITEM.match(line)):
                items.append(m[1])
    elif syntax == "md":
        a, b = _md_lines(rest)
        heads += a
        items += b
    elif syntax == "tex":
        for m in _TEX_HEAD.finditer(rest):
            end = _closing(rest, m.end())
            if end >= 0:
                heads.append(rest[m.end() : end])
        items += _tex_items(rest) if "\\item" in rest else []
    if "<" in rest:
        heads += [m[2] for m in _HTML_HEAD.finditer(rest)]
        items += _html_items(rest)
    for kind, bodies in (("heading", heads), ("list_item", items)):
        for raw in bodies:
            out[kind, inline(raw, syntax, marks)] = None
    return [x for x in out if x[1]]


_MD_LINE = re.compile(
    r"^ {0,3}(?:#{1,6}(?=\s)|>|=+[ \t]*$|-+[ \t]*$|\|[-:| ]+\|?[ \t]*$)|^[ \t]*(?:[*+-]|\d{1,9}[.)])(?=\s)", _M
)
_REDIRECT = re.compile(r"\A\s*#redirect\b:?", _I)


def visible(text: str | None, formulas: bool = True) -> str:
    """The page's text as a reader sees it: all markup, footnotes, templates, tables and category links gone, code
    left in place, and formulas too unless they're unwanted. '' for NULL."""
    if not text or text.isspace():
        return ""
    syntax, rest, marks = _prepared(_REDIRECT.sub("", text))
    if syntax == "wiki":
        lines = rest.split("\n")
        for i, line in enumerate(lines):
            if line[:1] == "=" and (m := _WIKI_HEAD.match(line)):
                lines[i] = m[2]
            elif line[:1] in ("*", "#", ":", ";"):
                lines[i] = line.lstrip("*#:;")
        rest = "\n".join(lines)
    elif syntax == "md":
        rest = _MD_LINE.sub(" ", rest)
    if "\x01" in rest:
        shown = {"code": "literal"} if formulas else {"code": "literal", "formula": "code"}
        marks = [(shown.get(k, k), b) for k, b in marks]
    return inline(rest, syntax, marks)


def structured(text: str | None) -> str:
    """The page as clean text that keeps its structure, one block after the other with blank lines between: headings after
    ``# ``, list items after ``- ``, code in fences, formulas between dollars, paragraphs on one line. '' for NULL."""
    if not text or text.isspace():
        return ""
    syntax, rest, marks = _prepared(_REDIRECT.sub("", text))
    if syntax == "tex":
        rest = _TEX_LIST.sub(lambda m: "\n\x05" if m[2] else "\n\n", _tex_headings(rest))
    if "<" in rest:
        rest = _HTML_HEAD.sub(lambda m: f"\n\x06{squeeze(m[2])}\n", rest)
        rest = _HTML_LIST.sub(lambda m: "\n\x05" if m[2].lower() == "li" and not m[1] else "\n\n", rest)
        rest = _BLOCK.sub("\n\n", rest)
    if syntax == "md":
        rest = _MD_SETEXT.sub(lambda m: f"\n\x06{m[1]}\n", rest)
    out: list[str] = []
    block: list[str] = []

    def finish(lead: str = "") -> None:
        shown = inline("\n".join(block), syntax, [(k, f"${b}$") if k == "formula" else (k, b) for k, b in marks])
        block.clear()
        if shown:
            out.append(lead + shown)

    lead = ""
    for line in rest.split("\n"):
        code = [m for m in MARK.finditer(line) if marks[int(m[1])][0] == "code"]
        head = _WIKI_HEAD.match(line) if syntax == "wiki" else _MD_ATX.match(line) if syntax == "md" else None
        item = _WIKI_ITEM.match(line) if syntax == "wiki" else _MD_ITEM.match(line) if syntax == "md" and not _MD_RULE.match(line) else None
        if line[:1] in ("\x05", "\x06") or head or item or code or not line.strip():
            finish(lead)
            lead = ""
        if line[:1] in ("\x05", "\x06"):
            lead = "- " if line[0] == "\x05" else "# "
            block.append(line[1:])
            if lead == "# ":
                finish(lead)
                lead = ""
        elif head:
            block.append((head[2] if syntax == "wiki" else head[1]) or "")
            finish("# ")
        elif item:
            lead = "- "
            block.append((item[1] if syntax == "wiki" else item[2]) or "")
        elif code:
            at = 0
            for m in code:
                block.append(line[at : m.start()])
                finish()
                body = marks[int(m[1])][1].strip("\n")
                out.append(f"```\n{body}\n```")
                at = m.end()
            block.append(line[at:])
        elif line.strip():
            block.append(line)
            if lead == "- " and syntax == "wiki":
                finish(lead)
                lead = ""
    finish(lead)
    return "\n\n".join(out)


def _tex_headings(s: str) -> str:
    """s with each heading on a line of its own after a mark."""
    out, at = [], 0
    for m in _TEX_HEAD.finditer(s):
        end = _closing(s, m.end())
        if m.start() >= at and end >= 0:
            title = s[m.end() : end].replace("\n", " ")
            out += [s[at : m.start()], f"\n\x06{title}\n"]
            at = end + 1
    return "".join(out) + s[at:]


# --- Spark -----------------------------------------------------------------------------------------------------------
_ELEMENTS = "id int, touched timestamp, loaded timestamp, live boolean, tie bigint, kinds array<string>, bodies array<string>"


def _elements_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, kinds, bodies = [0], [], []
        for text in batch.column("text").to_pylist():
            for kind, body in elements(text):
                kinds.append(kind)
                bodies.append(body)
            offsets.append(len(kinds))
        at = pa.array(offsets, pa.int32())
        columns = {c: batch.column(c) for c in ("id", "touched", "loaded", "live", "tie")}
        columns["kinds"] = pa.ListArray.from_arrays(at, pa.array(kinds, pa.string()))
        columns["bodies"] = pa.ListArray.from_arrays(at, pa.array(bodies, pa.string()))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def utc(c: Column) -> Column:
    return c.cast("timestamp")


def current_first() -> list[Column]:
    """Order in which the current row of a page comes first; ties by content, so that every run picks the same row."""
    return [F.desc_nulls_last("touched"), F.desc_nulls_last("loaded"), F.desc("tie")]


def page_elements(pages: DataFrame) -> DataFrame:
    """(id, kind, body): the distinct elements of each page's current row, redirects left out.

    Rows are parsed where they are read; only their elements, a small part of the text, are shuffled to pick each
    page's current row. Null, empty and blank texts have no elements, but count as a page's current row. Rows without
    an id are no page. Columns other than id, text, redirect, touched and loaded are ignored.
    """
    rows = pages.where("id is not null").select(
        "id", utc(F.col("touched")).alias("touched"), utc(F.col("loaded")).alias("loaded"),
        F.col("redirect").isNull().alias("live"), F.xxhash64("text", "redirect").alias("tie"),
        F.when(F.col("redirect").isNull(), F.col("text")).alias("text"),
    )
    parsed = rows.mapInArrow(_elements_of, _ELEMENTS)
    w = Window.partitionBy("id").orderBy(*current_first())
    current = parsed.withColumn("rn", F.row_number().over(w)).where("rn = 1 and live")
    return current.select("id", F.explode(F.arrays_zip("kinds", "bodies")).alias("e")).select(
        "id", F.col("e.kinds").alias("kind"), F.col("e.bodies").alias("body")
    )


def page_texts(texts: DataFrame) -> DataFrame:
    """(id, text): each text of (id, text) clean, with its structure; see :func:`structured`."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = pa.array([structured(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), shown], names=["id", "text"])

    return texts.select("id", "text").mapInArrow(clean, "id int, text string")


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, str | None] = {}
    for batch in batches:
        ids, bodies = [], []
        for i, anchor in zip(batch.column("src_id").to_pylist(), batch.column("anchor").to_pylist()):
            if anchor not in known:
                if len(known) > 50_000:
                    known.clear()
                known[anchor] = clean_anchor(anchor)
            if known[anchor]:
                ids.append(i)
                bodies.append(known[anchor])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(bodies, pa.string())], names=["id", "body"])


#: A first look in the JVM at what may be markup or a character reference; the exact decision follows.
ANCHOR_HINT = r"[<\[\\`~]|&[#a-zA-Z]|''|\*\S|_\S|\{\S|\$\S"


def anchor_texts(links: DataFrame) -> DataFrame:
    """(id, body): the distinct clean link texts of each source page, of those anchors that hold markup.

    Null and blank anchors, and anchors that are empty once clean, give no row. Repeated rows count once: equal pairs
    are combined before the shuffle and after it.
    """
    hinted = links.where(F.col("anchor").rlike(ANCHOR_HINT) & F.col("src_id").isNotNull()).select("src_id", "anchor")
    return hinted.mapInArrow(_anchors_of, "id int, body string").distinct()


def p1_found(spark, sf_dir: str) -> DataFrame:
    text = page_elements(table(spark, sf_dir, "pages")).select(F.lit("text").alias("fld"), "id", "kind", "body")
    link = anchor_texts(table(spark, sf_dir, "links")).select(
        F.lit("linktext").alias("fld"), "id", F.lit("anchor").alias("kind"), "body"
    )
    return text.unionByName(link)


def p1_text(spark, sf_dir: str) -> DataFrame:
    """The clean text of each page's current row that is no redirect."""
    from relata.llm.distinctive import current_texts

    return page_texts(current_texts(table(spark, sf_dir, "pages"), keep=("redirect",)).where("redirect is null"))
