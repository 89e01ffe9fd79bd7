import bz2

import pytest
from pyspark.sql import functions as F

from relata import config, session, timing
from relata.engine import Engine, KnownMeasure
from relata.operators import ensemble
from relata.sources import readers, writers
from relata.streaming import postings as S
from tests.helpers import MIDDLE, SMALL, rows_of

PAGE = "<page><title>{t}</title><ns>0</ns><id>{i}</id>{r}<revision><text{a}>{x}</text></revision></page>"


def _dump(pages):
    return "<mediawiki>" + "".join(PAGE.format(**p) for p in pages) + "</mediawiki>"


@pytest.mark.parametrize("name", ["a.xml", "a.xml.bz2"])
def test_dump(spark, tmp_path, name):
    xml = _dump([dict(t="A &amp; b", i=1, a="", r='<redirect title="C"/>', x="t1"), dict(t="D", i=2, a=" bytes='3' xml:space='preserve'", r="", x="x" * 30)])
    data = xml.encode()
    (tmp_path / name).write_bytes(bz2.compress(data) if name.endswith("bz2") else data)
    rows = {r["id"]: r for r in readers.read_dump(spark, str(tmp_path), text_limit=20).collect()}
    assert rows[1]["title"] == "A & b" and rows[1]["redirect"] == "C" and rows[2]["redirect"] is None and rows[2]["text"] == "x" * 20


def test_line_readers(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    (tmp_path / "g.csv").write_text("a,b,0.5\nbad\nc,d,x\ne,f,1\n")
    assert rows_of(readers.read_gold(spark, str(tmp_path / "g.csv"))) == [("a", "b", 0.5), ("e", "f", 1.0)]
    assert rows_of(readers.parse_ids(lines("1", " 2 ", "x", "2", ""))) == [(1,), (2,)]
    assert rows_of(readers.parse_phrases(lines("7\ta\tb", "nothing"))) == [("7", "a\tb")]
    d = readers.parse_dictionary(lines("Apple pie\t0.5 Apple_pie W:3/6 KB", "x\t1 X")).collect()
    assert (d[0]["normal"], d[0]["num"], d[0]["den"], d[0]["flags"]) == ("apple pie", 3, 6, ["W:3/6", "KB"]) and d[1]["num"] == 0 and d[1]["den"] is None
    with pytest.raises(Exception, match="no dictionary line"):
        readers.parse_dictionary(lines("broken")).collect()
    assert readers.parse_dictionary(lines("broken"), strict=False).count() == 0
    w = readers.parse_topic_weights(lines("3 1 1 2", "4 0 0", "x y")).collect()
    assert [(r["dense_id"], r["w"]) for r in w] == [(3, [0.25, 0.25, 0.5]), (4, [0.0, 0.0])]
    assert readers.parse_topic_ids(lines("r\t1\t5", "bad")).count() == 1
    assert "the" in readers.stop_words()
    (tmp_path / "stop.txt").write_text("a\n\n the \n")
    assert readers.stop_words(path=str(tmp_path / "stop.txt")) == ["a", "the"]
    assert readers.parse_topics(lines("lda: 2", "3 1 1")).collect()[0]["w"] == [0.5, 0.5]
    placed = spark.createDataFrame([(7, "1 3"), (8, "2 2")], "place bigint, value string")
    assert [(r["place"], r["w"]) for r in readers.parse_predictions(placed).collect()] == [(7, [0.25, 0.75]), (8, [0.5, 0.5])]


def test_matrix_files(spark, tmp_path):
    m = spark.createDataFrame([(i % 7, i, (i % 20) / 10 - 1) for i in range(60)], "row_id int, col_id int, value double")
    writers.write_sparse(m, str(tmp_path / "m"), quantize=True)
    back = readers.read_sparse(spark, str(tmp_path / "m"))
    worst = back.withColumnRenamed("value", "v").join(m, ["row_id", "col_id"]).agg(F.max(F.abs(F.col("v") - F.col("value")))).first()[0]
    assert back.count() == 60 and worst < 1e-4
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "row_id int, v array<double>")
    writers.write_dense(rows, [5, 6], str(tmp_path / "d"))
    back, columns = readers.read_dense(spark, str(tmp_path / "d"))
    assert columns == [5, 6] and rows_of(back) == rows_of(rows)
    with pytest.raises(Exception, match="other columns"):
        writers.write_dense(rows, [5], str(tmp_path / "e"))
    with pytest.raises(Exception, match="other columns"):
        writers.write_dense(rows.withColumn("col_ids", F.array(F.lit(5), F.lit(7))), [5, 6], str(tmp_path / "f"))
    with pytest.raises(Exception, match="codec"):
        writers.write_sparse(m.withColumn("value", F.lit(1.2)), str(tmp_path / "g"), quantize=True)


def test_dictionary_and_result_files(spark, tmp_path):
    cols = "text string, article string, num bigint, den bigint"
    writers.write_dictionary(spark.createDataFrame([("a", "A", 1, 1)], cols), str(tmp_path / "x"))
    old = spark.read.parquet(str(tmp_path / "x"))
    writers.write_dictionary(spark.createDataFrame([("a", "A", 2, 3), ("a", "B", 1, 3)], cols), str(tmp_path / "y"), merge_with=old)
    assert rows_of(spark.read.parquet(str(tmp_path / "y")).select("article", "num", "den")) == [("A", 4, 3), ("B", 4, 1)]
    res = spark.createDataFrame([("a", "b", 0.5, 1.0), ("a", "c", float("nan"), 1.0), ("a", "d", float("inf"), 1.0)], "phrase1 string, phrase2 string, score double, gold double")
    writers.write_results(res, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == "a\tb\t0.5\t1.0"
    line = writers.arff_lines(res, ["score"], "gold").collect()
    assert [r["value"] for r in line] == ["0.5,1.0", "?,1.0", "?,1.0"] and "@data" in writers.arff_header(["score"], "gold")


def test_lenient_configuration(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('// comment\n{"num-results": 20\n "metrics": {"a": {"type": "links",},},\n}')
    c = config.Config.read(p)
    assert c.integer("num-results") == 20 and c.section("metrics", "a").string("type") == "links"
    assert c.section("metrics").names() == ["a"] and c.boolean("x", False) is False
    with pytest.raises(KeyError):
        c.string("missing")
    with pytest.raises(TypeError):
        c.string("num-results")
    with pytest.raises(KeyError):
        config.Config({"type": "links", "logs": 2}).check("metrics")


def test_pairs_agree_with_lists(spark):
    e = Engine(spark, MIDDLE, config.Config({"metrics": {"both": {"type": "split", "delegates": ["links", "text"]}}}))
    for name in ("text", "pairwise", "esa"):
        m = e.measure(name)
        ids = m.m.select(F.col("row_id").alias("query_id")) if name == "pairwise" else e.gold().select(F.col("id1").alias("query_id"))
        lists = {(r["query_id"], r["id"]): r["score"] for r in m.most_similar(ids, 20).collect()}
        assert len(lists) > 10, name
        pairs = spark.createDataFrame(list(lists), "id1 int, id2 int")
        rated = {(r["id1"], r["id2"]): r["score"] for r in m.similarity(pairs).collect()}
        compared = [abs(rated[p] - s) < 1e-5 for p, s in lists.items() if name != "esa" or rated[p] is not None]
        assert compared and all(compared), name
    assert e.measure("both").similarity(e.gold()).count() == e.gold().select("id1", "id2").distinct().count()
    with pytest.raises(KeyError):
        e.measure("unknown")


def test_trained_ensembles(spark, tmp_path):
    settings = {"metrics": {"all": {"type": "ensemble", "components": ["links", "text"]}, "few": {"type": "ensemble", "components": ["text", "pairwise"]}}}
    e = Engine(spark, SMALL, config.Config(settings), results=20)
    gold = e.gold()
    m = e.measure("all")
    plain = {(r["id1"], r["id2"]): r["score"] for r in m.similarity(gold).collect()}
    m.train(gold)
    assert sorted(m.pairs.weights) == sorted(ensemble.feature_columns(["links_0", "text_1"], ensemble.PAIR_FEATURES))
    assert sorted(m.lists.weights) == sorted(ensemble.feature_columns(["links_0", "text_1"], ensemble.LIST_FEATURES))
    rated = {(r["id1"], r["id2"]): r["score"] for r in m.similarity(gold).collect()}
    assert set(rated) == set(plain) and rated != plain
    label = {(r["id1"], r["id2"]): r["y"] for r in gold.groupBy("id1", "id2").agg(F.avg("y").alias("y")).collect()}
    known = [p for p, s in rated.items() if s is not None]
    # Least squares with a constant: the predictions of the fitted pairs have the mean of the labels.
    assert len(known) > 5 and abs(sum(rated[p] - label[p] for p in known)) < 1e-6 * len(known)
    lists = rows_of(m.most_similar(gold.select(F.col("id1").alias("query_id")), 5))
    assert lists
    m.save(str(tmp_path / "m.json"))
    other = Engine(spark, SMALL, config.Config(settings), results=20).measure("all").load(str(tmp_path / "m.json"), spark)
    assert {(r["id1"], r["id2"]): r["score"] for r in other.similarity(gold).collect()} == pytest.approx(rated)
    few = e.measure("few")
    with pytest.raises(ValueError, match="links"):
        few.load(str(tmp_path / "m.json"), spark, prune=False)
    few.load(str(tmp_path / "m.json"), spark)
    assert few.pairs.metrics == ["text_1"] and few.similarity(gold).where("score is not null").count() > 0


def test_calibrated_measures(spark):
    kinds = {
        "a": {"type": "links", "similarityNormalizer": {"type": "loess", "monotonic": True, "log": True}}, "b": {"type": "links", "similarityNormalizer": "log"},
        "c": {"type": "links", "mostSimilarNormalizer": {"type": "percentile"}}, "d": {"type": "links", "similarityNormalizer": {"type": "spline"}},
        "e": {"type": "links", "similarityNormalizer": {"type": "rankAndScore"}}, "f": {"type": "links", "similarityNormalizer": {"type": "loess", "span": 1}},
    }
    e = Engine(spark, MIDDLE, config.Config({"metrics": kinds}), results=20)
    raw = {(r["id1"], r["id2"]): r["score"] for r in e.measure("links").similarity(e.gold()).collect()}
    smooth = {(r["id1"], r["id2"]): r["score"] for r in e.measure("a").similarity(e.gold()).collect()}
    order = sorted((p for p in raw if raw[p] is not None), key=raw.get)
    assert set(smooth) == set(raw) and len(order) > 50
    assert all(smooth[p] <= smooth[q] + 1e-9 for p, q in zip(order, order[1:])) and len({smooth[p] for p in order}) > 5
    assert e.measure("b").similarity(e.gold()).where("score is not null").count() == len(order)
    asked = e.gold().select(F.col("id1").alias("query_id"))
    shares = [r["score"] for r in e.measure("c").most_similar(asked, 10).collect()]
    assert shares and all(0 <= s <= 1 for s in shares)
    for name in ("d", "e", "f"):
        with pytest.raises(ValueError):
            e.measure(name)


def test_unknown_ids_of_known_scores(spark):
    m = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.1), (3, 1, 1.0)], "row_id int, col_id int, value double")
    pairs = spark.createDataFrame([(1, 2), (3, 2)], "id1 int, id2 int")
    assert {(r["id1"], r["id2"]): r["score"] for r in KnownMeasure("k", m).similarity(pairs).collect()} == {(1, 2): 0.3, (3, 2): 0.0}
    odd = spark.createDataFrame([(1, 9)], "id1 int, id2 int")
    with pytest.raises(Exception, match="unknown id"):
        KnownMeasure("k", m).similarity(odd).collect()
    assert KnownMeasure("k", m, strict=False).similarity(odd).first()["score"] is None


def test_mappers_of_a_configuration(spark):
    e = Engine(spark, SMALL, config.Config({"concept-mappers": {"main": {"type": "mine", "maxConcepts": 2}}}))
    e.register_mapper("mine", lambda phrases, n, parts: phrases.select("phrase", F.lit(1).alias("rank"), F.lit(7).alias("id"), F.lit(float(n)).alias("score")))
    asked = spark.createDataFrame([("a",), ("a",)], "phrase string")
    assert [tuple(r) for r in e.map_phrases(asked).collect()] == [("a", 1, 7, 2.0)]
    with pytest.raises(KeyError):
        e.mapper("unknown")


def test_clusters_need_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda **k: pytest.fail("a folder of one machine"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(Session())


def test_phases():
    p = timing.Phases()
    with p("outer"):
        for _ in range(3):
            with p("inner"):
                pass
    assert [(n, c) for n, c, _ in p.report()] == [("outer", 1), ("inner", 3)] and p.mean("inner") >= 0 and p.mean("none") == 0


def test_valid_ids_and_cached_lists(spark):
    e = Engine(spark, SMALL)
    m = e.measure("text")
    ids = e.gold().select(F.col("id1").alias("query_id")).distinct()
    valid = e.gold().select(F.col("id2").alias("id"))
    allowed = {r["id"] for r in valid.collect()}
    assert {r["id"] for r in m.most_similar(ids, 5, valid).collect()} <= allowed
    m.cached = spark.createDataFrame([(ids.first()[0], 1, 0.5)], "query_id int, id int, score double")
    assert m.most_similar(ids, 5).count() == 1
    m.cached = None


def test_phrases_to_scores(spark):
    e = Engine(spark, SMALL)
    gold = e.table("gold").where("phrase1 is not null and phrase2 is not null").select(F.col("phrase1").alias("a"), F.col("phrase2").alias("b")).distinct()
    assert e.phrase_similarity(gold, "links").count() == gold.count()
    some = gold.select(F.col("b").alias("phrase")).limit(4)
    n = some.distinct().count()
    assert e.phrase_matrix(some, "links").count() == n * (n - 1)
    assert set(e.phrase_most_similar(some, "links", 3).columns) == {"phrase", "id", "score", "rank"}


def test_stream_counts_equal_batch(spark, tmp_path):
    from relata.functions import text as T
    from relata.operators.corpus import current_pages

    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("id", "text", "redirect", "touched", "loaded")
    again = pages.where("id % 3 = 0")  # delivered a second time
    older = again.withColumns({"touched": F.lit("2001-01-01").cast("timestamp_ntz"), "text": F.lit("outdated words")})
    for i, part in enumerate((pages, again, older)):
        part.repartition(2).write.parquet(str(tmp_path / f"part{i}"))
    (tmp_path / "in").mkdir()
    for i, f in enumerate(sorted(tmp_path.glob("part*/*.parquet"))):
        f.rename(tmp_path / "in" / f"{i}.parquet")
    stream = S.page_stream(spark, str(tmp_path / "in"), pages.schema, files_per_batch=2)
    S.merge_term_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    words = current_pages(pages).where("text is not null").select("id", F.explode(T.word_tokens(F.col("text"))).alias("term"))
    expected = words.groupBy("term").agg(F.count(F.lit(1)).alias("tf"), F.countDistinct("id").alias("df"))
    assert rows_of(S.term_counts(spark, str(tmp_path / "out"))) == rows_of(expected)
    assert S.arrivals(pages).agg(F.sum("pages")).first()[0] == pages.where("loaded is not null").count()
