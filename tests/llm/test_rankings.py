import math
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from relata.llm import distinctive, ranking, setjoin, topn


# --- similar sets -------------------------------------------------------------------------------------------------
def _brute(sets, threshold, least):
    out = set()
    for (a, x), (b, y) in combinations(sorted(sets.items()), 2):
        if min(len(x), len(y)) >= least and len(x & y) >= threshold * len(x | y) - 1e-9:
            out.add((a, b))
    return out


def _frame(spark, sets):
    return spark.createDataFrame([(k, v) for k, vals in sets.items() for v in sorted(vals)], "id int, v string")


def _related_sets(seed, n=400):
    rng = random.Random(seed)
    base = [f"v{i}" for i in range(60)]
    sets = {}
    for i in range(n):
        own = set(rng.sample(base, rng.randint(1, 14))) | {"hub"}
        if i % 3 == 0 and sets:
            own = set(sets[rng.choice(list(sets))])
            for _ in range(rng.randint(0, 4)):
                (own.discard if rng.random() < 0.5 else own.add)(rng.choice(base))
        sets[i + 1] = own
    return sets


def _pairs(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_records_against_all_pairs(spark, seed):
    sets = _related_sets(seed)
    expected = _brute(sets, 0.6, 4)
    found = _pairs(setjoin.similar_records(_frame(spark, sets), 0.6, 4))
    assert found <= expected and len(found) >= 0.995 * len(expected) and len(expected) > 100


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_other_thresholds(spark, threshold):
    sets = _related_sets(3, 200)
    expected = _brute(sets, threshold, 4)
    found = _pairs(setjoin.similar_records(_frame(spark, sets), threshold, 4))
    assert found <= expected and len(found) >= 0.995 * len(expected) and expected


def test_hot_neighbourhoods_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    monkeypatch.setattr(setjoin, "CHUNK", 64)
    sets = {i: {"a", "b", "c", "d", "e", f"x{i % 30}"} for i in range(1, 91)}
    found = setjoin.similar_sets(_frame(spark, sets), 0.6, 4)
    assert _pairs(found.pairs()) == _brute(sets, 0.6, 4) and found.pairs().count() == 90 * 89 // 2
    rows = {r["id"]: r for r in found.counts().collect()}
    assert len(rows) == 90 and all(r["copies"] == 3 and r["links"] == 89 and r["cls"] == (i - 1) % 30 + 1 for i, r in rows.items())


def test_neighbourhoods_deepen_and_classes_go_on(spark):
    """A prefix of chance that many unlike sets share is left for deeper ones, and further trees make up for it."""
    rng = random.Random(9)
    sets = {i: {"h1", "h2", *(f"r{i}_{j}" for j in range(6))} for i in range(1, 1500)}
    for i in range(1, 200):
        sets[5000 + i] = set(sorted(sets[i])[: rng.randint(6, 8)]) | {f"more{i}"}
    forest, cls = setjoin.Forest(0.6), np.asarray(sorted(sets))
    values = np.asarray([xxhash.xxh64_intdigest(v) for i in cls for v in sorted(sets[i])], dtype="uint64")
    starts = np.cumsum([0] + [len(sets[i]) for i in cls[:-1]])
    trees = range(forest.first_trees)
    keys = setjoin.signatures(setjoin.minhashes(values, starts, trees, forest.levels), trees, forest.width)
    nm = np.asarray([len(sets[i]) * 4 + 3 for i in cls], dtype="int32")
    deepened = 0
    for t in trees:
        order = np.lexsort(keys[:, t].T[::-1])
        *_, (none, deep, loss) = setjoin.compared(keys[order, t], cls[order], nm[order], forest)
        assert none is None and (loss > 0).all()
        deepened += len(deep)
    assert deepened > 100
    assert _pairs(setjoin.similar_records(_frame(spark, sets), 0.6, 4)) == _brute(sets, 0.6, 4)


def test_similar_records_of_odd_tables(spark):
    assert setjoin.similar_records(_frame(spark, {}), 0.6, 4).count() == 0
    sets = {1: set(), 2: {"a"}, 3: {"a"}, 4: {"a", "b", "c", "d"}}
    assert setjoin.similar_records(_frame(spark, sets), 0.6, 4).count() == 0
    assert _pairs(setjoin.similar_records(_frame(spark, sets), 0.6, 1)) == {(2, 3)}
    assert setjoin.similar_records(_frame(spark, {4: sets[4]}), 0.6, 4).count() == 0
    for n in (0, 1, 2):
        assert setjoin._common(np.zeros((n, 14), "uint8"), 2).tolist() == [-1, 6][:n]


def test_giant_sets(spark):
    rng = random.Random(5)
    sets = {i: set(rng.sample([f"v{j}" for j in range(40)], rng.choice([5, 12, 25, 30, 36, 39]))) for i in range(1, 41)}
    rows = spark.createDataFrame([(i, v) for i, s in sets.items() for v in s for _ in range(2)] + [(None, "v"), (3, None)], "id int, v string").withColumn("n", F.lit(1))
    expected = _brute(sets, 0.6, 4)
    for giant in (20, 10**6):
        assert _pairs(setjoin.similar_records(rows, 0.6, 4, giant)) == expected
    assert setjoin.similar_records(rows.limit(0), 0.6, 4).count() == 0


@pytest.mark.parametrize("giant", [8, 10**6])
def test_two_tables(spark, giant):
    left, right = _related_sets(4, 120), _related_sets(4, 150)
    expected = {(a, b) for a, x in left.items() for b, y in right.items() if min(len(x), len(y)) >= 4 and len(x & y) >= 0.6 * len(x | y) - 1e-9}
    found = _pairs(setjoin.similar_between(_frame(spark, left), _frame(spark, right), 0.6, 4, giant))
    assert found <= expected and len(found) >= 0.995 * len(expected) and len(expected) > 100


def test_trees_reach_the_recall():
    for t in (0.03, 0.1, 0.4, 0.6, 0.8, 0.95):
        f = setjoin.Forest(t)
        assert 1 - (1 - t**f.base) ** f.first_trees >= setjoin.TARGET_RECALL and f.base < 13


# --- rankings -------------------------------------------------------------------------------------------------------
def _significance(ranks):
    k = len(ranks)
    if not k:
        return 1.0
    tails = [sum(math.comb(k, i) * r**i * (1 - r) ** (k - i) for i in range(j, k + 1)) for j, r in enumerate(sorted(ranks), 1)]
    return min(1.0, k * min(tails))


@pytest.mark.parametrize("ranks", [[], [0.5], [0.1, 0.1, 0.9], [1.0, 1.0], [0.02, 0.03, 0.01, 0.5, 0.04, 1.0]])
def test_order_statistics(spark, ranks):
    df = spark.createDataFrame([(ranks,)], "r array<double>").select(ranking.order_statistic_significance(F.col("r")).alias("p"))
    assert abs(df.first()["p"] - _significance(ranks)) < 1e-9


def test_no_range_dominates(spark):
    rows = []
    for i in range(20):
        rows += [(1, i, "a", i / 20), (1, i, "b", i * 1000.0), (1, i, "c", float("nan") if i % 7 == 0 else -1.0 / (i + 1))]
    rows += [(1, 0, "b", 1e12), (1, 99, "a", None), (1, 98, None, 1.0), (None, 1, "a", 1.0), (1, 19, "a", 0.0)]
    rated = ranking.combined_ranking(spark.createDataFrame(rows, "query_id int, id int, metric string, score double").withColumn("rank", F.lit(3)))
    order = [r["id"] for r in rated.orderBy("significance", "mean", "id").collect()]
    assert order[:3] == [19, 18, 17] and set(order[-2:]) == {98, 99} and len(order) == 22
    assert ranking.combined_ranking(rated.limit(0).selectExpr("query_id", "id", "'m' as metric", "1.0D as score")).count() == 0


# --- top n ------------------------------------------------------------------------------------------------------------
def test_top_n(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", 5, 1.0), (1, "a", 5, 3.0), (1, "a", 4, 3.0), (1, "a", 3, nan), (1, "a", 2, None), (1, "a", 9, inf), (1, "a", 8, -inf), (2, "a", 1, nan), (None, "a", 1, 1.0), (1, "b", None, 1.0)]
    df = spark.createDataFrame(rows, "q int, m string, id int, score double").withColumn("rn", F.lit(1))
    got = sorted((r["q"], r["m"], r["rn"], r["id"]) for r in topn.top_n(df, ["q", "m"], "id", "score", 3).collect())
    assert got == [(1, "a", 1, 9), (1, "a", 2, 4), (1, "a", 3, 5)]
    assert topn.top_n(df.limit(0), ["q"], "id", "score", 3).count() == 0
    everything = topn.top_n(df, ["q", "m"], "id", "score", 99).count()
    assert everything == 4


def test_top_n_prunes_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as q", "id", "cast(id as double) as score")
    plan = topn.top_n(df, ["q"], "id", "score", 2)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


# --- distinctive terms --------------------------------------------------------------------------------------------------
def test_distinctive_terms_against_brute_force(spark):
    texts = {1: "apple apple pear the", 2: "the the pear", 3: "the kiwi", 4: "", 5: "'''Apple''' {{apple}} 12", 6: "the " * 50}
    df = spark.createDataFrame(list(texts.items()), "id int, text string").withColumn("term", F.lit("x"))
    tf = {i: distinctive.terms(t) for i, t in texts.items()}
    n, avg = len(texts), sum(sum(c.values()) for c in tf.values()) / len(texts)
    scored = {(r["id"], r["term"]): r["score"] for r in distinctive.distinctive_terms(df.select("id", "text"), df.select("id", "text")).collect()}
    assert set(scored) == {(i, w) for i, c in tf.items() for w in c} and (5, "apple") in scored
    for (i, w), s in scored.items():
        d = sum(w in c for c in tf.values())
        f, length = tf[i][w], sum(tf[i].values())
        assert abs(s - math.log1p((n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avg))) < 1e-9
    assert distinctive.distinctive_terms(df.limit(0).select("id", "text"), df.limit(0).select("id")).count() == 0
    some = distinctive.distinctive_terms(df.select("id", "text"), df.where("id = 2").select("id"))
    assert {(r["id"], r["term"]): r["score"] for r in some.collect()} == {k: v for k, v in scored.items() if k[0] == 2}


@pytest.mark.parametrize("most", [0, 10**6])
def test_current_texts(spark, monkeypatch, most):
    monkeypatch.setattr(distinctive, "BROADCAST_IDS", most)
    rows = [(1, "2020-01-01", "2020-01-02", "old"), (1, "2021-01-01", None, "new"), (1, "2021-01-01", "2020-01-01", "newest"), (1, "2021-01-01", "2020-01-01", "newest")]
    rows += [(None, "2021-01-01", None, "x"), (2, None, None, None), (3, None, None, "alone"), (4, "2020-01-01", None, "gone"), (4, "2021-01-01", None, None)]
    pages = spark.createDataFrame(rows, "id int, touched string, loaded string, text string").withColumns({"redirect": F.lit(None).cast("string"), "n": F.lit(1)})
    assert sorted((r["id"], r["text"]) for r in distinctive.current_texts(pages).collect()) == [(1, "newest"), (3, "alone")]


def test_ties_of_terms(spark):
    scored = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0)], "id int, term string, score double")
    assert sorted(r["term"] for r in distinctive.most_distinctive(scored, 2).collect()) == ["a", "c"]
