import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.operators import calibrate, concepts, corpus, ensemble, evaluate, graph, hierarchy, links, matrix, normalize, postings, ranks, references
from tests.helpers import MIDDLE, rows_of


# --- references ---------------------------------------------------------------------------------------------------
def _orphans(spark, refs, targets, gone, heavy):
    r = spark.createDataFrame(refs, "tab string, src_id int, target string, seen string").withColumn("seen", F.col("seen").cast("timestamp"))
    t = spark.createDataFrame(targets, "target string, since string").withColumn("since", F.col("since").cast("timestamp"))
    g = spark.createDataFrame(gone, "target string")
    found = references.orphan_references(r, t, g, 1e-9, heavy).withColumn("ym", F.date_format("seen", "yyyy-MM"))
    report = {(x["tab"], x["why"], x["ym"]): (x["refs"], x["targets"]) for x in references.orphan_counts(r, t, g, 1e-9, heavy).collect()}
    rows = found.groupBy("tab", "why", "ym").agg(F.count("*").alias("refs"), F.countDistinct("target").alias("targets")).collect()
    assert report == {(x["tab"], x["why"], x["ym"]): (x["refs"], x["targets"]) for x in rows}
    return {(x["src_id"], x["target"]): x["why"] for x in found.collect()}


@pytest.mark.parametrize("heavy", [2, 10**6])
def test_orphans(spark, heavy):
    refs = [("l", i, "Hub", "2023-05-01") for i in range(30)] + [("l", 1, "A", "2023-01-01"), ("l", 2, "B", "2023-01-01"), ("l", 3, "C", "2023-01-01"), ("l", 4, "D", None)]
    found = _orphans(spark, refs, [("A", "2022-01-01"), ("B", "2024-01-01"), ("D", None)], [("C",), ("B",), ("Hub",)], heavy)
    assert {k: v for k, v in found.items() if k[1] != "Hub"} == {(2, "B"): "late", (3, "C"): "deleted"}
    assert sum(v == "deleted" for k, v in found.items() if k[1] == "Hub") == 30


def test_months_in_which_a_target_arrives_are_split(spark):
    refs = [("l", i, "Hub", f"2023-05-{i + 1:02d}") for i in range(20)]
    for heavy in (1, 1000):
        found = _orphans(spark, refs, [("Hub", "2023-05-08")], [], heavy)
        assert found == {(i, "Hub"): "late" for i in range(7)}


def test_only_so_many_keys_are_heavy(spark):
    counts = spark.createDataFrame([(f"k{i}", 1000 if i < 3 else 10) for i in range(500)], "target string, refs bigint")
    assert {x["target"] for x in references.heavy_keys(counts).collect()} == {"k0", "k1", "k2"}


def test_orphans_of_empty_tables(spark):
    assert _orphans(spark, [], [("A", "2022-01-01")], [("C",)], 2) == {}
    assert _orphans(spark, [("l", 1, "A", "2023-01-01")], [], [], 2) == {(1, "A"): "missing"}


# --- hierarchy -----------------------------------------------------------------------------------------------------
def _walk(parent: dict[str, str | None]):
    out = {}
    for node in parent:
        seen = [node]
        while (up := parent[seen[-1]]) is not None and up not in seen:
            seen.append(up)
        if up is None:
            out[node] = (seen[-1], len(seen) - 1, seen[::-1])
        else:
            out[node] = (min(seen[seen.index(up) :]), -1, None)
    return out


@pytest.mark.parametrize("seed, n", [(1, 60), (2, 200)])
def test_hierarchy_against_walking(spark, seed, n):
    rng = random.Random(seed)
    parent = {}
    for i in range(n):  # chains, bushy parts, roots and loops
        parent[f"n{i:03}"] = rng.choice([None, f"n{max(0, i - 1):03}", f"n{rng.randrange(n):03}", f"n{i // 10:03}"]) if i else None
    df = spark.createDataFrame(list(parent.items()), "node string, parent string")
    expected = _walk(parent)
    found = {r["node"]: (r["root"], r["depth"], r["path"]) for r in hierarchy.hierarchy(df, with_path=True).collect()}
    assert found == expected


def test_hierarchy_of_links(spark):
    rows = [("b", "a"), ("b", "a"), ("c", "b"), ("d", None), ("", "e"), ("x", "x"), ("y", "x"), ("b", "z")]
    nodes = hierarchy.parent_links(spark.createDataFrame(rows, "child string, parent string"), "child", "parent")
    paths = hierarchy.hierarchy(nodes, with_path=True)
    found = {r["node"]: (r["root"], r["depth"]) for r in paths.collect()}
    assert found == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0), "e": ("e", 0), "x": ("x", -1), "y": ("x", -1), "z": ("z", 0)}
    assert rows_of(hierarchy.descendants(paths)) == [("b", 1, "a"), ("c", 1, "b"), ("c", 2, "a")]


def test_hierarchy_of_nothing(spark):
    empty = spark.createDataFrame([], "child string, parent string")
    assert hierarchy.hierarchy(hierarchy.parent_links(empty, "child", "parent")).count() == 0


# --- corpus and postings ---------------------------------------------------------------------------------------------
def test_current_rows_and_clashing_columns(spark):
    rows = [(1, "2020-01-01", "2020-01-02", "old", 7), (1, "2021-01-01", None, "new", 7), (1, "2021-01-01", "2020-01-01", "newest", 7), (None, "2021-01-01", None, "x", 7), (2, None, None, None, 7)]
    pages = spark.createDataFrame(rows, "id int, touched string, loaded string, text string, rn int").withColumn("redirect", F.lit(None).cast("string"))
    assert {r["id"]: r["text"] for r in corpus.current_pages(pages).collect()} == {1: "newest", 2: None}


def test_redirect_loops_stop(spark):
    moves = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "title string, to string")
    found = {r["title"]: (r["target"], r["steps"]) for r in corpus.follow_redirects(moves).collect()}
    assert found["a"] == ("c", 2) and found["b"] == ("c", 1) and found["x"] == ("x", 10)
    known = spark.createDataFrame([("a",), ("b",), ("x",)], "title string")
    assert {r["title"]: r["target"] for r in corpus.follow_redirects(moves, known=known).collect()} == {"a": None, "b": None, "x": "x", "y": None}


@pytest.mark.parametrize("n", [3, 250])
def test_tail_pruning(spark, n):
    scores = [1.0 - i * 0.01 if i < 50 else 0.5 - (i - 50) * 1e-5 for i in range(n)]
    df = spark.createDataFrame([(1, i + 1, i, s) for i, s in enumerate(scores)], "query_id int, rank int, id int, score double")
    cut = next((i for i in range(n - 100) if scores[i] - scores[i + 100] < 0.005 * scores[0]), None)
    assert postings.prune_tail(df).count() == (n if cut is None else cut + 100)


def test_same_text_is_nearest(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 7} word{i % 7} rare{i} rare{i} rest{i % 3}") for i in range(30)], "id int, text string")
    index = postings.postings(docs, postings.T.word_tokens(F.col("text")))
    stats = postings.with_size(postings.term_stats(index), docs)
    asked = postings.select_terms(index, stats, postings.TermRule(min_df=1, max_percent=50)).withColumnRenamed("id", "query_id")
    top = postings.top_k(postings.matches(asked, index, stats), 1)
    assert all(r["query_id"] == r["id"] for r in top.collect()) and top.count() == 30


# --- links, graph, matrix ----------------------------------------------------------------------------------------------
def test_link_measures(spark):
    sets = {1: {10, 11, 12}, 2: {11, 12, 13, 14}, 3: {20}, 4: set()}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id int, link int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 100)], "id1 int, id2 int")
    pages = spark.range(100).select(F.col("id").cast("int").alias("id"))
    got = {(r["id1"], r["id2"]): r["j"] for r in links.link_overlap(pairs, rows, pages).select("id1", "id2", links.jaccard().alias("j")).collect()}
    assert got == {(1, 2): round(2 / 6, 6), (1, 3): 0.0, (1, 4): 0.0, (1, 100): None}


@pytest.mark.parametrize("squarings", [0, 2])
def test_distances_upward(spark, squarings):
    up = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a"), ("a", "c")], "child string, parent string")
    costs = spark.createDataFrame([("a", 1.0), ("b", 0.2), ("c", 0.5)], "cat string, cost double")
    member = spark.createDataFrame([(1, "c"), (2, "b")], "id int, cat string")
    d = {(r["id"], r["top"]): round(r["d"], 6) for r in graph.up_distances(member, costs, graph.steps_up(up, costs, squarings)).collect()}
    assert d == {(1, "c"): 0.5, (1, "b"): 0.7, (1, "a"): 1.5, (2, "b"): 0.2, (2, "a"): 1.2, (2, "c"): 1.7}


def test_nearest_pages_are_those_of_all_ways(spark):
    rng = random.Random(4)
    cats = [f"c{i:02}" for i in range(30)]
    links = {(c, rng.choice(cats)) for c in cats for _ in range(2)}
    links = {x for x in links if x[0] != x[1]}
    cost = {c: rng.choice([0.1, 0.3, 0.7, 1.1]) for c in cats}
    member = {(i, rng.choice(cats)) for i in range(1, 60) for _ in range(2)}
    inf = float("inf")
    up = {(a, b): 0.0 if a == b else inf for a in cats for b in cats}
    for child, parent in links:
        up[child, parent] = min(up[child, parent], cost[parent])
    for m in cats:
        for a in cats:
            for b in cats:
                up[a, b] = min(up[a, b], up[a, m] + up[m, b])
    expected = {}
    for q in (10, 20, 30):
        found = {q: 0.0}
        for i, c in member:
            if i != q:
                down = lambda t: 0.0 if t == c else up[c, t] - cost[t] + cost[c]
                ways = [cost[own] + up[own, t] + down(t) for p, own in member if p == q for t in cats]
                found[i] = min(found.get(i, inf), min(ways))
        best = sorted((round(v, 9), i) for i, v in found.items() if v < inf)[:5]
        expected |= {(q, i): v for v, i in best}
    frames = (
        spark.createDataFrame([(10,), (20,), (30,)], "query_id int"), spark.createDataFrame(sorted(member), "id int, cat string"),
        spark.createDataFrame(sorted(cost.items()), "cat string, cost double"), spark.createDataFrame(sorted(links), "child string, parent string"),
    )
    found = {(r["query_id"], r["id"]): round(r["distance"], 9) for r in graph.most_similar_pages(*frames, 5).collect()}
    assert found == pytest.approx(expected)


def test_transpose_twice(spark):
    m = spark.createDataFrame([(1, 2, 0.5), (3, 2, -1.0), (1, 4, 0.1)], "row_id int, col_id int, value double")
    assert rows_of(matrix.transpose(matrix.transpose(m))) == rows_of(m)


def test_row_cosines_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random((25, 12)) * (rng.random((25, 12)) < 0.4)
    m = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row_id int, col_id int, value double")
    norm = np.linalg.norm(x, axis=1)
    got = {(r["query_id"], r["id"]): r["score"] for r in matrix.row_cosines(m.where("row_id < 5"), m).collect()}
    for i in range(5):
        for j in range(25):
            dot = x[i] @ x[j]
            assert abs(got.get((i, j), 0.0) - (dot / (norm[i] * norm[j]) if dot else 0.0)) < 1e-5
    pairs = spark.createDataFrame([(0, 1), (0, 99)], "id1 int, id2 int")
    assert {r["id2"]: r["score"] for r in matrix.pair_cosines(pairs, m).collect()} == {1: got.get((0, 1), 0.0), 99: 0.0}


@pytest.mark.parametrize("k", [1, 4, 50])
def test_dense_top_k(spark, k):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 6))
    v[7] = 0
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "id bigint, v array<double>")
    u = np.divide(v, np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=np.linalg.norm(v, axis=1, keepdims=True) > 0)
    got = {}
    for r in matrix.dense_cosines(df.where("id < 3").selectExpr("id as query_id", "v as q"), df, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for q in range(3):
        s = np.round(u[q] @ u.T, 6)
        assert got[q] == sorted(range(40), key=lambda i: (-s[i], i))[:k]


# --- normalizers, ensembles, evaluation ----------------------------------------------------------------------------------
def test_percentile_points(spark):
    points = [5.0, 1.0, 3.0, 2.0, 8.0, 13.0, 21.0, 34.0]
    knots = calibrate.percentile_knots(spark.createDataFrame([("m", str(x), x) for x in points], "metric string, key string, x double"))
    asked = [1.0, 34.0, -5.0, -50.0, 40.0, 400.0, float("nan"), 10.5, None]
    rows = spark.createDataFrame([("m", i, x) for i, x in enumerate(asked)] + [("other", 9, 1.0)], "metric string, i int, x double")
    p = [r["p"] for r in calibrate.percentiles(rows, knots).orderBy("i").collect()]
    assert abs(p[0] - 0.1111) < 1e-3 and abs(p[1] - 0.8888) < 1e-3 and abs(p[7] - (5.5 / 9)) < 1e-9
    assert 0 <= p[3] < p[2] < p[0] and p[1] < p[4] < p[5] <= 1 and p[6] is p[8] is p[9] is None
    assert calibrate.percentiles(rows, knots.limit(0)).where("p is not null").count() == 0


def test_loess_rises():
    x = np.linspace(0, 1, 200)
    kx, ky = normalize.loess_points(x, x**2 + 0.01 * np.sin(50 * x))
    assert (np.diff(kx) > 0).all() and (np.diff(ky) > 0).all() and np.abs(ky - kx**2).max() < 0.1
    for n in (1, 2, 5, 11):
        assert len(normalize.loess_points(x[:n], x[:n])[0]) >= 1


@pytest.mark.parametrize(
    "x, groups",
    [([[1, 2, 3], [2, 4, 1]], [[0, 1], [2]]), ([[1, 0], [2, 0]], [[0, 1]]), ([[1, 1], [2, 3]], [[0], [1]]), ([[1, -2, 4], [3, -6, 12]], [[0, 1, 2]])],
)
def test_colinear_groups(x, groups):
    assert ensemble.colinear_groups(np.array(x, float)) == groups


def test_colinear_columns_of_a_table(spark):
    rows = [(i, float(i), 2.0 * i, float(i * i), 0.0) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, z double")
    assert ensemble.distributed_colinear_groups(df, ["a", "b", "c", "z"], ["id"]) == [[0, 1, 3], [2]]
    b0, b = ensemble.fit_without_colinear(df.withColumn("y", 3 * F.col("a") - F.col("c") + 1), ["a", "b", "c", "z"], "y", ["id"])
    assert abs(b0 - 1) < 1e-6 and {k: round(v, 6) for k, v in b.items()} == {"a": 3.0, "b": 0.0, "c": -1.0, "z": 0.0}


def test_linear_ensemble_is_least_squares(spark):
    wide, columns = ensemble._wide_examples(spark, MIDDLE), ensemble.feature_columns(ensemble.METRICS, ensemble.PAIR_FEATURES)
    rows = wide.orderBy("id1", "id2").toPandas()
    b0, b = ensemble.fit_linear(rows[columns].to_numpy(float), rows["y"].to_numpy(float))
    expected = b0 + rows[columns].to_numpy(float) @ b
    found = ensemble.q_ols_ensemble(spark, MIDDLE).orderBy("id1", "id2").toPandas()["predicted"].to_numpy(float)
    assert len(found) > 100 and np.abs(found - expected).max() < 1e-4


def test_index_of_cells_finds_most(spark):
    exact = {(r["query_id"], r["id"]) for r in matrix.q_dense_topk(spark, MIDDLE).collect()}
    found = {(r["query_id"], r["id"]) for r in matrix.q_dense_index_topk(spark, MIDDLE).collect()}
    assert len(exact) >= 100 and len(exact & found) >= 0.9 * len(exact)
    vectors = matrix._vectors(spark, MIDDLE)
    assert matrix.indexed_cosines(vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q")).limit(0), vectors, 5).count() == 0
    assert matrix.indexed_cosines(vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q")), vectors.limit(0), 5).count() == 0


def test_linear_fits_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 0.5 + x @ [1.0, -2.0, 0.25] + 0.01 * rng.normal(size=300)
    b0, b = ensemble.fit_linear(x, y)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    c0, c = ensemble.fit_from_moments(df, ["a", "b", "c"], "y")
    assert abs(b0 - c0) < 1e-8 and np.allclose(b, c) and np.allclose(b, [1, -2, 0.25], atol=0.01)
    assert ensemble.fit_from_moments(df.limit(0), ["a"], "y")[0] == 0.0


def test_equations_round_trip():
    b = {"esa": 1 / 3, "links": -2.5e-9, "text": 4.0}
    assert ensemble.read_equation(ensemble.write_equation(-0.1, b)) == (-0.1, b)
    with pytest.raises(ValueError):
        ensemble.read_equation("1.0 + x")


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("descending", [True, False])
def test_ranks_over_partitions(spark, parts, descending):
    rng = random.Random(parts)
    rows = [(g, i, float(rng.choice([1, 1, 1, 1, 2, 3, 4, i]))) for g in ("a", "b", "c") for i in range({"a": 300, "b": 5, "c": 1}[g])]
    df = spark.createDataFrame(rows, "g string, i int, x double")
    found = {(r["g"], r["i"]): (r["rank"], r["size"]) for r in ranks.distributed_ranks(df, ["g"], "x", parts, descending).collect()}
    for g, i, x in rows:
        same = [v for h, _, v in rows if h == g]
        ahead = sum(v > x if descending else v < x for v in same)
        assert found[g, i] == (ahead + 1 + (same.count(x) - 1) / 2, len(same))


def test_correlations(spark):
    rows = [("m", float(i), float(i * i)) for i in range(10)] + [("m", float("nan"), 1.0), ("k", 1.0, 1.0), ("flat", 2.0, 1.0), ("flat", 2.0, 2.0), ("flat", 2.0, 3.0), ("flat", 2.0, 4.0)]
    got = {r["metric"]: r for r in evaluate.correlations(spark.createDataFrame(rows, "metric string, x double, y double")).collect()}
    assert got["m"]["spearman"] == 1.0 and got["m"]["pearson"] < 1 and got["m"]["coverage"] == round(10 / 11, 6)
    assert got["k"]["pearson"] is None and got["flat"]["pearson"] is None


def test_dictionary_retain(spark):
    rows = [("a", "A", 5, 10), ("a", "B", 4, 10), ("b", "C", 5, 500), ("b", "D", 6, 500)]
    kept = concepts.retained(spark.createDataFrame(rows, "text string, article string, num int, den int"))
    assert sorted(r["article"] for r in kept.collect()) == ["A", "D"]


def test_first_mapper(spark):
    cols = "phrase string, rank int, id int, score double"
    a, b = spark.createDataFrame([("x", 1, 1, 1.0)], cols), spark.createDataFrame([("x", 1, 2, 1.0), ("y", 1, 3, 1.0)], cols)
    assert sorted((r["phrase"], r["id"]) for r in concepts.first_mapper(a, b).collect()) == [("x", 1), ("y", 3)]
