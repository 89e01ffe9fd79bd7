import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.llm import packing, reading, tokens
from tests.helpers import SMALL


# --- token ids ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def published():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


ODD = ["", " ", "a", "  \n\n x\t", "<|endoftext|>", "aaaaaaaaaaab" * 50, "'s 'LL don't", "日本語のテキスト" * 30, "é\u0301\u200b\ufeff", "🙂" * 9, "x" * 5000, "1234567890" * 40, "\x00\x01", "ﬁ ½ Ⅷ"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_published_ones(published, text):
    assert tokens.encoder().encode(text) == published(text)


def test_random_long_pieces(published):
    rng = random.Random(3)
    for alphabet in ("ab", "aeinrst", "etaoinshrdlu", "äöüß€"):
        s = "".join(rng.choice(alphabet) for _ in range(3000))
        assert tokens.encoder().encode(s) == published(s)


def test_rank_queue():
    rng = random.Random(1)
    queue, model = tokens.RankQueue(5000), {}
    for step in range(3000):
        if model and rng.random() < 0.4:
            rank, at = queue.pop()
            assert rank == min(model) and at == sorted(model.pop(rank))
        else:
            r, p = rng.randrange(5000), rng.randrange(10**6)
            queue.push(r, p)
            model.setdefault(r, []).append(p)
    while model:
        assert queue.pop()[0] == min(model) and model.pop(min(model))
    assert queue.pop() is None


def test_ids_in_spark(spark, published):
    rows = [(1, "Some text."), (2, None), (3, ""), (4, "Some text."), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in tokens.encoded(df).collect()))
    assert got == [(0, published("x")), (1, published("Some text.")), (2, []), (3, []), (4, published("Some text."))]
    assert tokens.encoded(df.limit(0)).count() == 0
    assert {r["n_tokens"] for r in tokens.token_counts(df).collect()} == {0, 1, 3}


# --- packing ------------------------------------------------------------------------------------------------------------
def _plain_first_fit(sizes, capacity):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((j for j, used in enumerate(bins) if used + sizes[i] <= capacity), None)
        if b is None:
            bins.append(0)
            b = len(bins) - 1
        bins[b] += sizes[i]
        out[i] = b
    return out


@pytest.mark.parametrize("seed", range(4))
def test_first_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 50, rng.randint(0, 100)]) for _ in range(rng.randint(1, 300))]
    assert packing.first_fit_decreasing(sizes, 100) == _plain_first_fit(sizes, 100)
    assert packing.first_fit_decreasing([], 5) == []
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([6], 5)


def test_every_token_is_placed_once(spark):
    sizes = {1: 0, 2: 10, 3: 11, 4: 25, 5: 30, 6: 3, 7: 3}
    items = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens int").withColumn("bin", F.lit("clash"))
    boxes = spark.createDataFrame([("s", 10), ("s", 10), ("l", 100)], "container string, capacity int")
    packed = packing.pack(packing.pieces(items, boxes), 7, group_size=4)
    rows = packed.collect()
    for c, capacity in (("s", 10), ("l", 100)):
        mine = [r for r in rows if r["container"] == c]
        for d, n in sizes.items():
            parts = sorted((r["start"], r["tokens"]) for r in mine if r["doc_id"] == d)
            assert sum(t for _, t in parts) == n and len(parts) == max(1, -(-n // capacity))
            assert [s for s, _ in parts] == [i * capacity for i in range(len(parts))]
        fill = {}
        for r in mine:
            fill[r["bin"]] = fill.get(r["bin"], 0) + r["tokens"]
        assert max(fill.values()) <= capacity
    nameless = items.limit(4).selectExpr("cast(null as bigint) as doc_id", "cast(10 + doc_id as int) as n_tokens", "doc_id as row")
    placed = packing.pack(packing.pieces(nameless, boxes), 4, group_size=4).groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("n"))
    assert placed.where("n > capacity").count() == 0 and placed.where("container = 's' and n = 10").count() >= 4
    w = {r["container"]: r for r in packing.waste(packed).collect()}
    assert w["s"]["tokens"] == sum(sizes.values()) and 0 < w["l"]["fill"] <= 1
    assert packing.pack(packing.pieces(items.limit(0), boxes), 0).count() == 0


def test_documents_fill_well(spark):
    fill = {r["container"]: r["fill"] for r in packing.p9_fill(spark, SMALL).collect()}
    assert len(fill) == 3 and fill["short"] > 0.95


# --- reading level ---------------------------------------------------------------------------------------------------------
def _labelled(spark, scale="sf0.1"):
    folder = SMALL.replace("sf0.001", scale)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/grade_labels.parquet")
    return reading.labelled_sample(docs, labels)


def test_held_out_accuracy(spark):
    sample = _labelled(spark).orderBy("doc_id").toPandas()
    held = np.arange(len(sample)) % 3 == 0
    kept = spark.createDataFrame(sample[~held])
    model = reading.train_on(kept.selectExpr("doc_id", "text", "cast(grade as int) as grade"))
    right = model.rate(sample["text"][held].tolist()) == sample["grade"][held].to_numpy()
    assert len(right) > 100 and np.mean(right) > 0.92


def test_vocabulary_is_counted_in_the_executors(spark):
    texts = ["the cat sat", "the dog sat sat", "the cat", "a cat <b>ran</b>", "The Cat"]
    df = spark.createDataFrame([(i, t, i % 3 + 1) for i, t in enumerate(texts)], "doc_id bigint, text string, grade int")
    words = reading.learned_vocabulary(df.repartition(3))
    assert words.docs == {"the": 3, "cat": 3} and words.total == {"the": 6.0, "cat": 5.0}
    x, y = reading.sample_features(df, words)
    assert x.shape[0] == 5 and y.tolist() == [1, 2, 3, 1, 2]
    assert x[0].tolist() == reading.features(texts[0]) + words.features(texts[0], 1.0)


def test_isotonic():
    assert reading.isotonic(np.array([1.0, 3, 2, 4, 4, 0])).tolist() == [1.0, 2.5, 2.5, 8 / 3, 8 / 3, 8 / 3]
    assert (np.diff(reading.isotonic(np.random.default_rng(0).normal(size=200))) >= -1e-12).all()
    assert len(reading.isotonic(np.zeros(0))) == 0


def test_grading_odd_texts(spark):
    easy, hard = "It is a hat. We see the sun.", "The jurisprudence subsumes incommensurable antecedents."
    graded = spark.createDataFrame([(i, (easy, hard)[i % 2], (1, 4)[i % 2]) for i in range(8)], "doc_id bigint, text string, grade int")
    model = reading.train_on(graded)
    rows = [(1, "It is a hat."), (2, None), (3, ""), (4, "jurisprudence " * 20_000), (5, "!!! 12 日本"), (6, "<b>")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("grade", F.lit(9))
    got = {r["doc_id"]: r["grade"] for r in reading.graded(df, model).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[2] == got[3] == 1 and set(got.values()) <= {1, 4}
    assert reading.graded(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        reading.train_on(graded.limit(0))


def test_unpunctuated_texts_have_syntax():
    assert reading.features("the cat sat on the mat\nand it slept")[0] == 4.5
    assert not any(reading.features("12 !!")) and not any(reading.features(""))
