import math

import pytest
from pyspark.sql import functions as F

from relata.functions import balanced, maths as M, query, text as T
from relata.functions.stemmer import stem
from relata.functions.titles import canonical_category, canonical_title


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, title", [(" A_b  c#d ", "A b c"), ("a b", "a b"), ("#x", ""), (None, None), ("", "")])
def test_canonical_title(spark, raw, title):
    assert one(spark, raw, canonical_title) == title


@pytest.mark.parametrize("raw, cat", [("CATEGORY: Some_thing ", "some thing"), ("x#y", "x#y"), ("category:", ""), (None, None)])
def test_canonical_category(spark, raw, cat):
    assert one(spark, raw, canonical_category) == cat


def test_links_and_texts(spark):
    s = "[[A b|x]] [[C#d]] [[Image:e.png|f]] [[Category:G|h]] [[I\n j]]"
    assert one(spark, s, T.anchor_targets) == ["A_b", "C#d", "Category:G", "I_j"]
    assert one(spark, s, T.anchor_texts) == ["x", "C#d", "h", "I\n j"]
    assert one(spark, s, T.category_names) == ["G"]
    assert one(spark, None, T.anchor_targets) is None


@pytest.mark.parametrize(
    "s, dab",
    [("{{disambig}}", True), ("{ { Hndis |x}}", True), ("{{dablink|x}}", False), ("{{Disambiguation needed}}", False), ("{{x}}", False), ("dab", False), ("{{dmbox}} {{dablink}}", True)],
)
def test_disambiguation(spark, s, dab):
    assert one(spark, s, T.is_disambiguation) is dab


def test_disambiguation_links(spark):
    s = "[[First one#x]] or\n* [[Second|2]]\n* ''[[Third#y]]''\n* [[Image:q]]\n"
    assert one(spark, s, T.disambiguation_links) == ["First_one", "Second", "Third"]


@pytest.mark.parametrize("title, listed", [("List of x", True), ("A list-of x", True), ("Listed of x", False), ("Lists", False)])
def test_list_titles(spark, title, listed):
    assert one(spark, title, T.is_list_title) is listed


def test_stripping(spark):
    assert one(spark, "a<!-- b\nc --><ref>d</ref><ref name=x>e</ref><b>f</b>", T.strip_html) == "af"
    assert one(spark, "'''a''' == b ==\n:c\n** d", T.strip_formatting) == "a  b \nc\nd"
    assert one(spark, "x\n== See also ==\n* y\n== Next ==\nz", lambda c: T.strip_section(c, "see also")) == "x\n\n== Next ==\nz"
    assert one(spark, "a\n\n\n\nb", T.collapse_newlines) == "a\n\nb"
    assert one(spark, ":x\n \n ''* y: w\n--\n  z\n:a", T.strip_indented_start) == "  z\n:a"


def test_balanced():
    assert balanced.cut_balanced("a{{b{{c}}d}}e{{f", "{{", "}}") == "ae{{f"
    assert balanced.cut_balanced("a}}b{{c{{d}}e", "{{", "}}") == "a}}b{{c{{d}}e"
    assert balanced.replace_links("x [[a|b]] [[c]] [[Image:d|e [[f]] g]] [[:h]] [[Foo|x: y]] [[p:q|r]]") == "x b c  :h  y r"
    assert balanced.replace_links("[[a]]\nx [[b]]\n[[c]].\n[[d]] e\n[[f]]", "isolated") == "[[a]]\nx [[b]]\n.\n[[d]] e\n"
    assert balanced.replace_links("[[w:a]] [[:b|d]] [[c]] [[x|y: z]]", "prefixed") == " d [[c]] "


def test_strip_everything(spark):
    s = "{{t|{{u}}}}'''A''' is [[b|c]].<ref>r</ref>\n{|\n|x\n|}\n== See also ==\n* [[d]]\n\n"
    assert one(spark, s, balanced.strip_everything).strip() == "A is c."
    assert one(spark, None, balanced.strip_everything) is None
    assert one(spark, "", balanced.strip_everything) == ""


def test_packing(spark):
    df = spark.createDataFrame([(x,) for x in (-9.0, -1.1, 0.0, 0.7, 1.1, 9.0, None)], "x double")
    out = [r[0] for r in df.select(M.unpack(M.pack(F.col("x")))).collect()]
    for x, y in zip((-1.1, -1.1, 0.0, 0.7, 1.1, 1.1), out):
        assert abs(x - y) < 1e-4
    assert out[-1] is None and df.where("x = 0.7").select(M.pack(F.col("x"))).first()[0] == 20851


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(M.cosine(F.col("a"), F.col("b")), M.cosine(F.col("a"), F.col("z")), M.unit_length(F.col("a")), M.unit_length(F.col("z")), M.dot(F.col("a"), F.col("b"), 1)).first()
    assert abs(r[0] - 0.96) < 1e-12 and r[1] == 0.0 and r[2] == [0.6, 0.8] and r[3] == [0.0, 0.0] and r[4] == 12.0


def test_distance_score(spark):
    df = spark.createDataFrame([(0.0,), (float("inf"),), (0.2,)], "d double").select(M.distance_score(F.col("d"), F.lit(0.2)))
    assert [r[0] for r in df.collect()] == [1.0, -math.inf, 1.0]


def test_query_language(spark):
    df = spark.createDataFrame([(1, "normal", 5), (2, "list", 9), (3, "normal", 30)], "id int, type string, ninlinks int")
    find = lambda q: sorted(r["id"] for r in df.where(query.parse(q)).collect())
    assert find("type:normal AND ninlinks:[3 TO 20]") == [1]
    assert find("type:list OR ninlinks:[30 TO *]") == [2, 3]
    assert find("NOT (type:normal)") == [2] and find('type:"normal" ninlinks:5') == [1]
    for bad in ("type:", "type:[1 TO 2]", "(type:x", "AND"):
        with pytest.raises(ValueError):
            query.parse(bad)


@pytest.mark.parametrize(
    "word, expected",
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"),
     ("happy", "happi"), ("nationality", "nation"), ("running", "run"), ("sky", "sky"), ("generously", "generous"), ("as", "as")],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_link_flags(spark):
    df = spark.createDataFrame([("KB W:3/40 x",), ("none",), (None,)], "f string")
    num, den = T.link_fraction(F.col("f"))
    assert [tuple(r) for r in df.select(num, den).collect()] == [(3, 40), (None, None), (None, None)]


def test_stripping_agrees_with_sql_on_random_markup(spark, tmp_path):
    import random

    from relata.operators import corpus
    from tests.helpers import rows_of, rows_of_sql

    rng = random.Random(3)
    pieces = ["== See also ==", "===References===", "== other ==", "=== Further  reading ===", "==external links==", "\n", "\n\n", "text ", "[[a|b]]", "[[", "]]", "{{t}}", "{{", "}}", "{|", "|}", "* x", ":y", "''z''", "<ref>r</ref>", "[http://q w]", "[[Image:i|j]]", "[[p:q|r: s]]", "="]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))) for i in range(400)] + [(400, None), (401, "")]
    pages = spark.createDataFrame(rows, "id int, text string").selectExpr("id", "0 as ns", "'t' as title", "cast(null as string) as redirect", "text", "timestamp_ntz '2020-01-01' as touched", "timestamp_ntz '2020-01-01' as loaded")
    pages.coalesce(1).write.parquet(str(tmp_path / "raw"))
    next((tmp_path / "raw").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    changed = {}
    for name in [n for n in corpus.QUERIES if n.startswith("txt_strip_")]:
        found = rows_of(corpus.QUERIES[name](spark, str(tmp_path)))
        assert found == rows_of_sql(corpus.SQL[name], str(tmp_path))[1], name
        changed[name] = sum(r not in rows for r in found)
    assert changed["txt_strip_sections"] > 40 and all(changed.values()), changed
