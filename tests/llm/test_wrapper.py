import random

from pyspark.sql import functions as F

from relata.llm import markup, wrapper
from relata.llm.markup import elements, squeeze, structured
from tests.helpers import MIDDLE


def _page(title, items, note=None):
    extra = f"<p class=x>{note}</p>" if note else ""
    return f"<html><h1>{title}</h1>{extra}<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul><div>Imprint</div></html>"


def test_wrapper_of_pages_of_one_template():
    rng = random.Random(1)
    pages = [_page(f"title {i}", [f"item {rng.random()}" for _ in range(rng.randint(2, 6))], "note" if i % 3 == 0 else None) for i in range(12)]
    found = wrapper.infer(pages)
    shape = [(n.mark or ("+" if n.group else "text"), n.text, n.optional) for n in found]
    assert shape == [
        ("html", None, False), ("h1", None, False), ("text", None, False), ("/h1", None, False), ("p", None, True), ("text", "note", True), ("/p", None, True),
        ("ul", None, False), ("+", None, False), ("/ul", None, False), ("div", None, False), ("text", "Imprint", False), ("/div", None, False), ("/html", None, False),
    ]
    repeated = next(n for n in found if n.group)
    assert [n.mark or n.text for n in repeated.group] == ["li", None, "/li"]
    match = lambda t: wrapper.covered(found, wrapper.folded(wrapper.stream(t)))
    assert match(_page("another", ["a", "b", "c"])) == (11, True) and match(_page("another", ["a", "b"], "note"))[1]
    assert not match(_page("x", ["a", "b"]).replace("Imprint", "Contact"))[1] and not match("<p>other</p>")[1]


def test_odd_streams():
    assert wrapper.infer([]) == [] and wrapper.stream("") == [] and wrapper.covered([], []) == (0, True)
    assert [n.mark or n.text for n in wrapper.stream("== A ==\n* b\n* c")] == ["==", "A ==", "*", "b", "*", "c"]
    assert len(wrapper.folded(wrapper.stream("* b\n* c\n* d"))) == 1


def test_page_wrappers(spark):
    rows = [(i, 0, _page(f"t{i}", ["a", "b", str(i)])) for i in range(60)] + [(100, None, "plain"), (101, 0, None), (102, 14, "")]
    df = spark.createDataFrame(rows, "id int, ns int, text string").withColumn("pages", F.lit("clash"))
    got = {(r["ns"], r["syntax"]): r for r in wrapper.page_wrappers(df).collect()}
    html = got[0, "html"]
    assert (html["pages"], html["fitted"], html["accepted"], html["optional"]) == (60, wrapper.FITTED, 60, 0)
    assert html["reached"] == html["elements"] == 240 and (-1, "wiki") in got and len(got) == 3
    assert wrapper.page_wrappers(df.limit(0)).count() == 0


def test_wrappers_come_from_every_page(spark):
    rng = random.Random(2)
    tags = [f"{x}{y}" for x in "abcdef" for y in "uvwxyz"]
    odd = ["<p>a</p><b>rare</b>" * (i % 2) + "".join(f"<{t}>{k}" for k, t in enumerate(rng.choices(tags, k=4 * i))) for i in (3, 8, 21, 150, 400)]
    texts = dict(enumerate([_page(f"t{i}", ["a", "b", str(i)]) for i in range(300)] + [f"<html><h1>x</h1>{t}</html>" for t in odd] + ["<p></p>"]))
    df = spark.createDataFrame([(i, 0, t) for i, t in texts.items()], "id int, ns int, text string")
    order = [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").collect()]
    whole = wrapper.infer([texts[i] for i in order])
    for parts in (1, 7):
        (r,) = wrapper.page_wrappers(df.repartition(parts)).where("syntax = 'html'").collect()
        assert r["pages"] == r["accepted"] == len(texts) and r["parts"] == r["met"] and r["elements"] == r["reached"] > 0
        assert r["nodes"] == r["optional"] == len(whole) > 1_000 and r["fitted"] < len(texts)


def test_wrappers_of_the_tables_cover_them(spark):
    rows = wrapper.p1_wrappers(spark, MIDDLE).collect()
    assert sum(r["pages"] for r in rows) > 1_000
    for r in rows:
        assert r["accepted"] == r["pages"] and r["met"] == r["parts"] and r["reached"] == r["elements"] and r["fitted"] <= r["pages"]


def test_alignment_has_the_longest_common_stream():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([wrapper.Node(mark=rng.choice("abc")) for _ in range(rng.randint(0, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        both = wrapper.aligned(a, b)
        assert sum(not n.optional for n in both) == best[0][0] and len(both) == len(a) + len(b) - best[0][0]
        for page in (a, b):
            assert len(wrapper.met_at(wrapper.places_of([n.key for n in both]), [n.key for n in page])) == len(page)


def test_every_element_stands_in_the_clean_text(spark):
    pages = spark.read.parquet(f"{MIDDLE}/pages.parquet").where("redirect is null and text is not null")
    checked = 0
    for r in pages.select("text").collect():
        shown = structured(r["text"])
        flat, blocks = squeeze(shown).replace("$", ""), set(shown.split("\n\n"))
        for kind, body in elements(r["text"]):
            lead = {"heading": "# ", "list_item": "- "}.get(kind, "")
            assert lead + body in blocks or (lead + body).replace("$", "") in flat
            checked += 1
    assert checked > 5_000


def test_clean_text_keeps_structure(spark):
    wiki = "== A ==\nText '''b''' <math>x^2</math>.\n* one\n** two\n<pre>\n c\n</pre>\n{{t|* no}}"
    assert structured(wiki) == "# A\n\nText b $x^2$.\n\n- one\n\n- two\n\n```\n c\n```"
    assert structured("<h2>A</h2><p>b<br>c</p><ul><li>d<ul><li>e</li></ul></li></ul>") == "# A\n\nb c\n\n- d\n\n- e"
    assert structured("# A\n\nb\nc\n\n- d\n  e\n- f\n\n```\nx\n```\n[g](h)") == "# A\n\nb c\n\n- d e\n\n- f\n\n```\nx\n```\n\ng"
    assert structured("\\section{A}\nb\n\\begin{itemize}\\item c\\item d\\end{itemize}") == "# A\n\nb\n\n- c\n\n- d"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\x05\x01a")], "id int, text string").withColumn("tie", F.lit(1))
    assert {r["id"]: r["text"] for r in markup.page_texts(df).collect()} == {1: "", 2: "", 3: "a"}


def test_deep_nesting_is_whole():
    link = "x"
    for i in range(30):
        link = f"[[t{i}|{link}]]"
    assert markup.inline(link, "wiki") == "x"
    table = "y"
    for _ in range(20):
        table = f"<table><tr><td>{table}</td></tr></table>"
    assert elements(f"{table}\n* z") == [("list_item", "z")]
