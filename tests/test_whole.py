"""Results that must be whole where they were once cut."""

import random

import pytest

from relata.engine import CategoryMeasure, DenseMeasure, EnsembleMeasure, SplitMeasure
from relata.operators import ensemble, graph, hierarchy, matrix
from tests.helpers import MIDDLE, SMALL, rows_of


def _ways_up(parent: dict[str, str | None]) -> dict[str, list[str]]:
    out = {}
    for node in parent:
        seen = [node]
        while (up := parent[seen[-1]]) is not None and up not in seen:
            seen.append(up)
        out[node] = seen
    return out


@pytest.mark.parametrize("seed, n", [(1, 60), (2, 300)])
def test_descendants_below_and_inside_loops(spark, seed, n):
    r = random.Random(seed)
    parent = {f"n{i:03}": (None if r.random() < 0.02 else f"n{r.randrange(max(0, i - 9), min(n, i + 3)):03}") for i in range(n)}
    parent |= {"a": "b", "b": "a", "c": "a", "d": "c", "self": "self", "under": "self"}
    ways = _ways_up(parent)
    paths = hierarchy.hierarchy(spark.createDataFrame(list(parent.items()), "node string, parent string"), through_loops=True)
    assert {x["node"]: x["path"] for x in paths.collect()} == {k: v[::-1] for k, v in ways.items()}
    found = {(x["node"], x["descendant"], x["distance"]) for x in hierarchy.descendants(paths).collect()}
    assert found == {(up, k, i) for k, v in ways.items() for i, up in enumerate(v) if i}
    assert ("c", "d", 1) in found and ("b", "d", 3) in found and ("b", "a", 1) in found and ("a", "a", 2) not in found


def test_nothing_below_loops_is_left_out(spark):
    paths = hierarchy.p5_paths(spark, MIDDLE)
    assert paths.where("depth < 0").count() > 5 and not paths.where("path is null").count()


# --- factors and topics ----------------------------------------------------------------------------------------------
def test_topics_of_each_document_over_all_terms(spark, tmp_path):
    words = [f"w{i}" for i in range(6_000)]
    rows = [(i, " ".join(words if i < 5 else [f"x{i}"] * 3)) for i in range(12)] + [(12, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(ensemble._lda(spark, str(tmp_path))[1].vocabulary) == sorted(words)
    found = {r["doc_id"]: r["topics"] for r in ensemble.q_lda(spark, str(tmp_path)).collect()}
    assert sorted(found) == list(range(13)) and all(len(t) == 5 for t in found.values())
    assert all(sum(found[i]) == pytest.approx(1.0 if i < 5 else 0.0) for i in found)


def test_factors_of_each_row_and_column(spark):
    found = ensemble.q_als(spark, SMALL)
    cells = matrix.neighbour_matrix(spark, SMALL)
    sides = {(r["metric"], r["side"], r["id"]) for r in found.where("size(factors) = 8").collect()}
    rows = {(r[0], "row", r[1]) for r in cells.select("metric", "row_id").collect()}
    assert sides == rows | {(r[0], "col", r[1]) for r in cells.select("metric", "col_id").collect()}
    assert found.count() == len(sides)


# --- lists of the engine ---------------------------------------------------------------------------------------------
def test_lists_longer_than_the_default(spark):
    vectors = spark.range(1, 1_301).selectExpr("cast(id as int) as id", "array(1.0D, cast(id as double) / 1000) as v")
    ask = spark.createDataFrame([(1,)], "query_id int")
    dense = DenseMeasure("d", vectors)
    assert dense.most_similar(ask, 700).count() == 700
    assert SplitMeasure("s", dense, dense).most_similar(ask, 700).count() == 700
    # Of the parts, the first 2k of each are merged, and the k best of these come out.
    both = EnsembleMeasure("e", [dense])
    assert both.raw_most_similar(ask, None, 600).count() == 1_200
    assert both.most_similar(ask, 600).count() == 600
    member = spark.range(1, 1_301).selectExpr("cast(id as int) as id", "'x' as cat")
    up = spark.createDataFrame([("x", "y")], "child string, parent string")
    assert CategoryMeasure("c", member, up, member).most_similar(ask, 700).count() == 700


# --- regression ------------------------------------------------------------------------------------------------------
def test_all_judged_pairs_are_predicted(spark, monkeypatch):
    monkeypatch.setattr(ensemble, "MAX_EXAMPLES", 14)
    monkeypatch.setattr(ensemble, "EPSILONS", [1.35])
    monkeypatch.setattr(ensemble, "PENALTIES", [0.0])
    judged = ensemble._wide(spark, SMALL)
    assert judged.count() > 14
    found = ensemble.q_huber_ensemble(spark, SMALL)
    assert rows_of(found.select("id1", "id2")) == rows_of(judged.select("id1", "id2")) and not found.where("predicted is null").count()


def test_fitting_sample_is_the_same_each_time(spark):
    df = spark.range(200).selectExpr("cast(id as int) as id1", "cast(id * 7 as int) as id2")
    a, b = (rows_of(ensemble.fitting_sample(df.repartition(n), 50, 7)) for n in (1, 9))
    assert a == b and len(a) == 50 and {r[0] for r in a} == set(range(7))


# --- distances -------------------------------------------------------------------------------------------------------
def test_distances_are_whole_or_an_error(spark, monkeypatch):
    up = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}") for i in range(20)], "child string, parent string")
    costs = spark.createDataFrame([(f"c{i:02}", 1.0) for i in range(21)], "cat string, cost double")
    member = spark.createDataFrame([(0, "c00"), (7, "c07")], "id int, cat string")
    steps = graph.steps_up(up, costs, 1)
    found = {(r["id"], r["top"]): r["d"] for r in graph.up_distances(member, costs, steps).collect()}
    assert found == {(i, f"c{j:02}"): float(j - i + 1) for i in (0, 7) for j in range(i, 21)}
    monkeypatch.setattr(graph, "MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError):
        graph.up_distances(member, costs, steps)
