import json

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from relata import cache, cli
from relata.operators import indexes
from tests.helpers import MIDDLE, SMALL


@pytest.fixture
def run(spark, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *a, **k: spark)
    monkeypatch.setattr(SparkSession, "stop", lambda self: None)
    return lambda *argv: cli.main(list(map(str, argv)))


def test_indexes_of_a_configuration(run, spark, tmp_path):
    page = "<page><title>{0}</title><ns>0</ns><id>{1}</id><revision><text>{2}</text></revision></page>"
    texts = ["[[B|the bee]] [[C]] one two three", "[[A]] [[C|sea]] running words", "[[A]] [[A|again]]"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/dump.xml").write_text("<mediawiki>" + "".join(page.format("ABC"[i], i + 1, t) for i, t in enumerate(texts)) + "</mediawiki>")
    settings = {"indexes": {
        "main": {"fields": ["id", "title", "ninlinks"], "booster": {"type": "inlink", "numLogs": 1}, "minLinks": 2},
        "esa": {"fields": ["id", "text"], "analyzer": "ESA", "addInLinksToText": True, "titleMultiplier": 1},
    }}
    (tmp_path / "c.json").write_text(json.dumps(settings))
    assert run("-c", tmp_path / "c.json", "index", tmp_path / "d", tmp_path / "out") == 0
    main = {r["title"]: r["ninlinks"] for r in spark.read.parquet(str(tmp_path / "out/main")).collect()}
    assert main == {"A": 2, "B": 1} and "boost" in spark.read.parquet(str(tmp_path / "out/main")).columns
    terms = {(r["id"], r["term"]): r["tf"] for r in spark.read.parquet(str(tmp_path / "out/esa-postings")).collect()}
    assert terms[2, "run"] == 1 and terms[2, "bee"] == 1 and (2, "the") not in terms and terms[3, "sea"] == 1 and terms[3, "c"] == 2
    for bad in ({"analyzer": "x"}, {"booster": {"type": "x"}}, {"fields": ["x"]}, {"other": 1}):
        with pytest.raises(ValueError):
            indexes.checked(bad)


def test_phrase_artefacts(run, spark, tmp_path):
    titles = [r["title"] for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").where("ns = 0 and redirect is null and title is not null and id < 1100").select("title").limit(4).collect()]
    (tmp_path / "p.txt").write_text("\n".join(f"{i}\t{t}" for i, t in enumerate(titles)))
    assert run("-t", "-r", 5, "phrases", MIDDLE, "links", tmp_path / "p.txt", tmp_path / "out") == 0
    n = len(set(titles))
    read = lambda name: spark.read.csv(str(tmp_path / "out" / name), sep="\t", header=True)
    assert read("mapping").where("id is not null").select("phrase").distinct().count() == n
    assert read("pairs").count() == n * (n - 1)
    assert spark.read.parquet(str(tmp_path / "out/lists")).columns == ["row_id", "col_id", "value"]
    assert spark.read.parquet(str(tmp_path / "out/similarities")).count() <= n * (n - 1)


def test_gold_files_and_fit(run, spark, tmp_path, capsys):
    gold = spark.read.parquet(f"{MIDDLE}/gold.parquet").where("phrase1 is not null and phrase2 is not null and similarity is not null")
    (tmp_path / "g.tsv").write_text("\n".join(f"{r['phrase1']}\t{r['phrase2']}\t{r['similarity']}" for r in gold.collect()))
    assert run("-y", tmp_path / "g.tsv", "fit", MIDDLE, "links,text") == 0
    shown = capsys.readouterr().out
    assert "*links" in shown and "*text" in shown and "joint" in shown and "r2" in shown


def test_topics_and_factors_of_a_matrix(run, spark, tmp_path):
    m = spark.createDataFrame([(i, j, float(1 + (i % 2 == j % 2) * 9)) for i in range(12) for j in range(8)], "row_id int, col_id int, value double")
    m.write.parquet(str(tmp_path / "m"))
    assert run("topics", tmp_path / "m", tmp_path / "t") == 0
    rows = spark.read.parquet(str(tmp_path / "t/rows"))
    assert rows.count() == 12 and rows.where("abs(aggregate(topics, 0D, (a, x) -> a + x) - 1) > 1e-6").count() == 0
    assert spark.read.parquet(str(tmp_path / "t/columns")).groupBy("topic").agg(F.countDistinct("col_id").alias("n")).where("n <> 8").count() == 0
    assert run("svd", tmp_path / "m", tmp_path / "s") == 0 and spark.read.parquet(str(tmp_path / "s/rows")).count() == 12


def test_kept_tables(run, spark, tmp_path):
    (tmp_path / "src").write_text("x")
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cache.kept(spark, str(tmp_path / "kept"), [str(tmp_path / "src")], make).count() == 3
    assert len(made) == 1
    assert cache.kept(spark, str(tmp_path / "kept"), [str(tmp_path / "absent")], make).count() == 3 and len(made) == 2
    out = tmp_path / "sims"
    assert run("-m", tmp_path / "models", "-r", 3, "make-sims", SMALL, "category", out) == 0
    assert spark.read.parquet(str(out)).count() > 0 and cache.modified(spark, str(tmp_path / "models/category-costs/_SUCCESS"))
