"""Reading level of documents: a pairwise linear ranker with isotonic calibration (problem 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.session import reliable, table

#: Labelled documents that the ranker is fitted on at most; with more, those with the least hashes are taken.
MAX_LABELLED = 5_000
#: Document pairs of different grade that the ranker is fitted on at most.
MAX_PAIRS = 60_000

_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^>\n]*>", re.S)
_HYPHEN = re.compile(r"-\n(?=[a-z])")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n\s*\n")
_WORD = re.compile(r"[A-Za-z]+(?:'[a-z]+)?")
_VOWELS = re.compile(r"[aeiouy]+")
_CLAUSE = re.compile(
    r"\b(?:because|although|while|whereas|which|whose|who|that|unless|unlike|until|when|after|before|if|such|neither|nor|partly|however|than)\b"
)
#: Bounds of the bands that sentences fall into by the mean length of their words.
BANDS = (3.7, 4.2, 4.7, 5.2, 5.8, 6.4, 7.0, 7.8)


#: Graded documents that must hold a word before its usual grade counts, and the bands of usual grades.
LEAST_DOCS = 3
USUAL_BANDS = (1.6, 1.9, 2.2, 2.5, 2.8, 3.1, 3.4, 3.7)


def plain_words(text: str) -> list[str]:
    """The words in lower case of a text without tags; names are left out."""
    return [w for w in _WORD.findall(_HYPHEN.sub("", _TAG.sub("", text))) if w.islower()]


def features(text: str) -> list[float]:
    """Syntax and vocabulary features of a text; a constant vector for one without words.

    Syntax: words and clauses a sentence. Vocabulary: letters and syllables a word, long words, and how the
    sentences are spread over bands of word length, so that a text mixed from easy and hard sentences is told from
    one of even difficulty. Sentences weigh by their words where it says so.
    """
    plain = _HYPHEN.sub("", _TAG.sub("", text)).replace("\u00ad", "")
    lengths, letters, commas, clauses, capitals = [], [], [], [], []
    long7 = long10 = syllables = 0
    seen: set[str] = set()
    parts = [(s, _WORD.findall(s)) for s in _SENTENCE.split(plain)]
    # Titles, menus and other furniture are no sentences. A text without any is read line by line.
    whole = [p for p in parts if len(p[1]) >= 3 and p[0].rstrip().endswith((".", "!", "?"))]
    for sentence, words in whole or [(s, w) for s in plain.split("\n") if (w := _WORD.findall(s))]:
        own = [w for w in words[1:] if w.islower()] or words  # names say nothing about the level
        sizes = [len(w) for w in own]
        lengths.append(len(words))
        letters.append(sum(sizes) / len(sizes))
        commas.append(sentence.count(","))
        clauses.append(len(_CLAUSE.findall(sentence.lower())))
        long7 += sum(s >= 7 for s in sizes)
        long10 += sum(s >= 10 for s in sizes)
        syllables += sum(len(_VOWELS.findall(w)) for w in own)
        capitals.append(len(own))
        seen.update(own)
    n = len(lengths)
    if not n:
        return [0.0] * (11 + 2 * (len(BANDS) + 1))
    total, counted = sum(lengths), sum(capitals)
    size, mean = np.asarray(lengths, float), np.asarray(letters)
    band = np.searchsorted(BANDS, mean)
    share = np.bincount(band, minlength=len(BANDS) + 1) / n
    weighted = np.bincount(band, weights=size, minlength=len(BANDS) + 1) / total
    return [
        total / n, float(size.std()), float(mean.mean()), float(mean.std()), float((mean * size).sum() / total),
        long7 / counted, long10 / counted, syllables / counted, sum(commas) / n, sum(clauses) / n, len(seen) / counted**0.5,
        *share, *weighted,
    ]


@dataclass(frozen=True)
class Vocabulary:
    """For each word how many graded documents hold it, and the sum of their grades."""

    docs: dict[str, int]
    total: dict[str, float]

    def features(self, text: str, own: float | None = None) -> list[float]:
        """Mean and spread of the words' usual grades, and their shares over bands. own: the text's own grade, taken
        out of the usual grades if the text is one of those they were learned from."""
        out = 0 if own is None else 1
        usual = []
        for w in plain_words(text):
            n = self.docs.get(w, 0) - out
            if n >= LEAST_DOCS:
                usual.append((self.total[w] - (own or 0.0)) / n)
        if not usual:
            return [0.0] * (5 + len(USUAL_BANDS) + 1)
        x = np.asarray(usual)
        share = np.bincount(np.searchsorted(USUAL_BANDS, x), minlength=len(USUAL_BANDS) + 1) / len(x)
        return [float(x.mean()), float(x.std()), *np.quantile(x, (0.25, 0.75, 0.9)).tolist(), *share]


@dataclass(frozen=True)
class LevelModel:
    """A linear score, and the score above which each next level begins."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    levels: np.ndarray
    vocabulary: Vocabulary | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def grades(self, x: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.bounds, self.scores(x), side="left")]

    def rate(self, texts: list[str]) -> np.ndarray:
        return self.grades(np.asarray([features(t) + self.vocabulary.features(t) for t in texts]))


def isotonic(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The non-decreasing sequence nearest to y in (weighted) squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, np.ones(len(y)) if w is None else w):
        blocks.append([float(value), float(weight), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, c = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + v * u) / (last[1] + u)
            last[1] += u
            last[2] += c
    return np.concatenate([np.full(int(c), v) for v, _, c in blocks]) if blocks else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 400, seed: int = 7) -> LevelModel:
    """Learn the ranker from MAX_PAIRS random pairs of different grade, and calibrate its scores."""
    if not len(y):
        raise ValueError("there are no graded documents")
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    a, b = _some_pairs(y, seed)
    w = np.zeros(x.shape[1])
    if len(a):
        d = z[a] - z[b]
        m = np.zeros_like(w)
        v = np.zeros_like(w)
        for t in range(1, steps + 1):  # logistic loss of the margins, full batches, adaptive steps
            g = -(d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(0) + ridge * w
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    score = z @ w
    order = np.argsort(score, kind="stable")
    level = isotonic(y[order].astype(float))
    levels = np.unique(y)
    bounds = []
    for low, high in zip(levels[:-1], levels[1:]):
        k = int(np.searchsorted(level, (low + high) / 2, side="left"))
        s = score[order]
        bounds.append(s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2)
    return LevelModel(mean, scale, w, np.asarray(bounds), levels)


def _some_pairs(y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """MAX_PAIRS random pairs of different grade at most, the higher one first; fewer if so many draws don't give them."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(y), 4 * MAX_PAIRS), rng.integers(0, len(y), 4 * MAX_PAIRS)
    a, b = np.where(y[a] > y[b], a, b), np.where(y[a] > y[b], b, a)
    keep = np.flatnonzero(y[a] > y[b])[:MAX_PAIRS]
    return a[keep], b[keep]


def labelled_sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """At most MAX_LABELLED graded texts as (doc_id, text, grade), written once; of repeated labels the greatest counts."""
    graded = labels.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    some = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # At most MAX_LABELLED ids are broadcast, so that no text is shuffled to find the graded ones.
    return reliable(documents.where("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", F.col("grade").cast("int").alias("grade")))


def _spread(texts: DataFrame) -> DataFrame:
    """The few texts over all tasks, as reading them takes longer than moving them."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def learned_vocabulary(texts: DataFrame) -> Vocabulary:
    """How many of the graded texts (text, grade) hold each word and the sum of their grades, counted in the executors.

    Words in less than LEAST_DOCS texts never count; all others reach the driver, two numbers a word.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, g) for text, g in zip(batch.column("text").to_pylist(), batch.column("grade").to_pylist()) for w in set(plain_words(text))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([g for _, g in rows], pa.int32())], names=["word", "grade"])

    counted = texts.select("text", "grade").mapInArrow(words, "word string, grade int").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("grade").alias("total"))
    rows = counted.where(F.col("n") >= LEAST_DOCS).toPandas()
    return Vocabulary(dict(zip(rows["word"], rows["n"].astype(int))), dict(zip(rows["word"], rows["total"].astype(float))))


def sample_features(texts: DataFrame, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, grades) of the graded texts (doc_id, text, grade); texts are read in the executors, only vectors come back."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades = batch.column("grade").to_pylist()
            x = [features(t) + words.features(t, float(g)) for t, g in zip(batch.column("text").to_pylist(), grades)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "grade", "x"])

    rows = texts.select("doc_id", "text", "grade").mapInArrow(vectors, "doc_id bigint, grade int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    return np.asarray(rows["x"].tolist(), dtype=float).reshape(len(rows), -1), rows["grade"].to_numpy()


def train_on(texts: DataFrame) -> LevelModel:
    """The model of graded texts (doc_id, text, grade)."""
    texts = _spread(texts)
    words = learned_vocabulary(texts)
    return replace(fit(*sample_features(texts, words)), vocabulary=words)


def train(documents: DataFrame, labels: DataFrame) -> LevelModel:
    return train_on(labelled_sample(documents, labels))


def graded(documents: DataFrame, model: LevelModel) -> DataFrame:
    """(doc_id, grade) for each row of documents (doc_id, text). NULL and empty texts get the lowest grade."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").to_pylist()
            blank = np.asarray([not (t and t.strip()) for t in texts])
            grade = np.where(blank, model.levels[0], model.rate([t or "" for t in texts])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(grade)], names=["doc_id", "grade"])

    return documents.select("doc_id", "text").mapInArrow(rate, "doc_id bigint, grade int")


def p10_found(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "grade_labels"))
    return graded(documents.where("kind = 'article' and lang = 'en'"), model)
