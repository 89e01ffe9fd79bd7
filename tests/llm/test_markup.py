import pytest

from relata.llm.markup import anchor_texts, clean_anchor, elements, inline, page_elements, syntax_of, visible


def of(text, kind):
    return sorted(b for k, b in elements(text) if k == kind)


WIKI = """{{Infobox x
| a = {{b|c}}
* not an item
}}
<!--
== Draft ==
-->
'''A''' is [[B c|b]].<ref>* no</ref> <nowiki>== no ==</nowiki> costs $5 and $6 now.

== Early&nbsp;years 1&ndash;2<ref name="x" /> == <!-- sec -->
* [[One]], ''first'' (<code>id 7</code>)
** [[Two#x|two's]] &amp; more
#three<br/>lines
:<math display="block">a < b_{1}</math>
It has <math>x \\to \\infty</math> inside.

<h3 class="a"
 data-n="1">Third <em>one</em></h3>
<UL><LI>big
<ul><li>small</ul>
<LI>last</UL>
{| class="t"
! == no ==
|-
| * no
|}
<pre>if (i &lt; n) '''x'''
* y</pre>
<source lang=text>
* z &lt; '''raw'''
</source>
[[Category:C]]
"""


def test_wiki():
    assert syntax_of(WIKI) == "wiki"
    assert of(WIKI, "heading") == ["Early years 1–2", "Third one"]
    assert of(WIKI, "list_item") == ["One, first (id 7)", "big", "last", "small", "three lines", "two's & more"]
    assert of(WIKI, "formula") == ["a < b_{1}", "x \\to \\infty"]
    assert of(WIKI, "code") == ["* z &lt; '''raw'''", "if (i < n) '''x''' * y"]


HTML = """<script>var t = "<li>none</li><h2>none</h2>";</script><style>li > b { x: y }</style>
<p><b>A</b> costs $5, <a href='/x'>link</a> \\(n^2 \\le 3\\).</p>
<H2 id="s">Notes <a href="/y">[1]</a><!-- c --></H2>
<ol><li class="i">one &#38; <i>two</i></li><li>three<ul><li>four</li></ul>five</li></ol>
<table><tr><td><ul><li>no</li></ul></td></table>
<pre class="c"><code>a &amp;&amp; b
- c</code></pre>
$$y = 1$$
\\[ z \\]
* not an item
"""


def test_html():
    assert syntax_of(HTML) == "html"
    assert of(HTML, "heading") == ["Notes [1]"]
    assert of(HTML, "list_item") == ["four", "one & two", "three five"]
    assert of(HTML, "formula") == ["n^2 \\le 3", "y = 1", "z"]
    assert of(HTML, "code") == ["a && b - c"]


MARKDOWN = """**A** is [b](C_(d)) and [e](<F_(g)>).[^1] Item 5 * 7. A ticket costs $5 and a meal $6 today.

## Two ##

Three *x*[^2]
-----

* [One](One) & two
    * `id 7`, **bold**
- a_b_c\\*

1. first<!-- x -->
2. It is $a_1 = 2$

| a | b |
|---|---|
| - | * |

```sh
# no heading
- no item
* ptr = 0; $x$
```

The listing is this one:

    == marker ==
    * ptr

<ul>
<LI>html <b>item</b></li>
</ul>

$$
y^2
$$

[^1]: note
"""


def test_markdown():
    assert syntax_of(MARKDOWN) == "md"
    assert of(MARKDOWN, "heading") == ["Three x", "Two"]
    assert of(MARKDOWN, "list_item") == ["It is a_1 = 2", "One & two", "a_b_c*", "first", "html item", "id 7, bold"]
    assert of(MARKDOWN, "formula") == ["a_1 = 2", "y^2"]
    assert of(MARKDOWN, "code") == ["# no heading - no item * ptr = 0; $x$", "== marker == * ptr"]


TEX = r"""% \section{Old}
\label{p:1}
\textbf{A} costs \$5 and \$6.\footnote{See \textbf{x} $q$.}

\section*{Legacy \& \textit{history} 14--16\footnote{B}}

\begin{itemize}
  \item \href{wiki/X_(y)}{X (y)},~old
  \begin{enumerate}
    \item inner \texttt{id 7}
  \end{enumerate}
  \item last
\end{itemize}
\begin{tabular}{ll} \item a & b \\ \end{tabular}
\begin{equation*}a + b\end{equation*}
It is \(c\), $d$ and \[ e \].
\begin{verbatim}
% kept \section{no}
\end{verbatim}
"""


def test_tex():
    assert syntax_of(TEX) == "tex"
    assert of(TEX, "heading") == ["Legacy & history 14–16"]
    assert of(TEX, "list_item") == ["X (y), old", "inner id 7", "last"]
    assert of(TEX, "formula") == ["a + b", "c", "d", "e"]
    assert of(TEX, "code") == ["% kept \\section{no}"]


@pytest.mark.parametrize(
    "raw, clean",
    [("''a''", "a"), ("'''a''' b", "a b"), ("**a**", "a"), ("*a b*", "a b"), ("`a_b`", "a_b"), ("\\emph{a (b)} c", "a (b) c"), ("<i>a</i>", "a"), ("a<br />b", "a b"), ("a<sup>2</sup>", "a2"),
     ("<!-- x -->a", "a"), ("a&nbsp;b", "a b"), ("a&#39;s", "a's"), ("a &amp; b", "a & b"), ("a & b", None), ("a [b", None), ("{a", None), ("5 > a", None), ("a *", None), ("a < b", None),
     ("a #3", None), ("a = 6", None), ("a's", None), ("", None), ("  a  b ", None), ('<span class="x">a</span>', "a")],
)
def test_anchors(raw, clean):
    assert clean_anchor(raw) == clean


@pytest.mark.parametrize("text", [None, "", "  \n", "\u00a0", "x" * 300_000, "{{" * 5000, "[[" * 5000, "*" * 20000, "<li>" * 3000, "$" * 5001, "```\n" * 2001, "a\n" * 50_000, "\\begin{itemize}" * 900, "<!--", "\x01" * 9])
def test_odd_texts(text):
    assert isinstance(elements(text), list) and isinstance(visible(text), str)


def test_unclosed_markup_stays_readable():
    assert of("* [[Half", "list_item") == ["[[Half"]
    assert ("heading", "Open") in elements("<p>x</p><h2>Open</h2><pre>code")
    assert inline("a &lt;b&gt;", "html") == "a <b>"


def test_visible_text():
    shown = visible(WIKI)
    assert "Early years" in shown and "b." in shown and "Infobox" not in shown and "Category" not in shown and "Draft" not in shown and "'''A" not in shown
    assert visible(TEX).startswith("A costs $5 and $6.")
    assert "infty" not in visible(WIKI, formulas=False)


def test_current_rows_in_spark(spark):
    rows = [
        (1, 0, "T", None, "== Old ==", "2020-01-01", "2020-01-02", "extra"), (1, 0, "T", None, "== New ==\n* x\n* x", "2021-01-01", "2021-01-02", "extra"),
        (2, 0, "R", "T", "== Redirect ==", "2021-01-01", None, "extra"), (3, 0, None, None, None, None, None, None), (3, 0, None, None, "== Older ==", None, "2000-01-01", None),
        (None, 0, "N", None, "== Nobody ==", None, None, None),
    ]
    pages = spark.createDataFrame(rows, "id int, ns int, title string, redirect string, text string, touched string, loaded string, kinds string")
    found = sorted((r["id"], r["kind"], r["body"]) for r in page_elements(pages).collect())
    assert found == [(1, "heading", "New"), (1, "list_item", "x"), (3, "heading", "Older")]
    assert page_elements(pages.limit(0)).count() == 0


def test_anchor_rows(spark):
    rows = [(1, "''a''", 1), (1, "'''a'''", 2), (1, "a", 3), (2, None, 4), (2, "", 5), (2, "<b></b>", 6), (None, "''a''", 7)]
    links = spark.createDataFrame(rows, "src_id int, anchor string, body int")
    assert [(r["id"], r["body"]) for r in anchor_texts(links).collect()] == [(1, "a")]
    assert anchor_texts(links.limit(0)).count() == 0
