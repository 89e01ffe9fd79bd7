"""Search by phrases: the same lists as a row for each phrase and page, without such rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from relata.operators import postings, search
from tests.helpers import SMALL, rows_of, rows_of_sql


def _no_rows(*_, **__):
    raise AssertionError("a row for each phrase and page that share a word")


@pytest.fixture
def without_rows(monkeypatch):
    """Words of more than three pages are common; matches() makes a row for each phrase and page."""
    monkeypatch.setattr(search, "COMMON", 3)
    monkeypatch.setattr(postings, "matches", _no_rows)


def _as_sql(spark, name):
    found = rows_of(entry.queries()[name](spark, SMALL))
    assert found and found == rows_of_sql(entry.oracle_sql()[name], SMALL)[1]


def _pages(docs: dict[int, dict[str, int]], common: int) -> tuple[search._Pages, dict[str, int], int]:
    n, df = len(docs), {}
    for words in docs.values():
        for w in words:
            df[w] = df.get(w, 0) + 1
    length = {i: math.sqrt(sum(((1 + math.log(tf)) * math.log(n / df[w])) ** 2 for w, tf in words.items())) for i, words in docs.items()}
    rows = [("", list(docs), [], list(length.values()))]
    rows += [(w, [i for i in docs if w in docs[i]], [docs[i][w] for i in docs if w in docs[i]], []) for w in df]
    kinds = {"term": pa.string(), "ids": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32()), "lens": pa.list_(pa.float64())}
    lists = pa.table({c: pa.chunked_array([pa.array([r[k] for r in rows], kind)]) for k, (c, kind) in enumerate(kinds.items())})
    return search._Pages(lists, n, common), df, n


@pytest.mark.parametrize("common, limit", [(0, 7), (20, 7), (20, 60), (1_000, 7), (30, 10_000)])
def test_best_pages_against_brute_force(common, limit):
    r = random.Random(common + limit)
    docs = {i * 3: {f"w{int(r.paretovariate(0.7)) % 40}": r.randint(1, 2) for _ in range(r.randint(1, 4))} | {"all": 1} for i in r.sample(range(500), 300)}
    pages, df, n = _pages(docs, common)
    for _ in range(200):
        terms = [(w, r.randint(1, 2), df[w]) for w in sorted(r.sample(sorted(df), 3))]
        weights = {w: (1 + math.log(tf)) * math.log(n / k) for w, tf, k in terms}
        qlen = math.sqrt(sum(x * x for x in weights.values()))
        rated = []
        for i, words in docs.items():
            length = math.sqrt(sum(((1 + math.log(tf)) * math.log(n / df[w])) ** 2 for w, tf in words.items()))
            if set(words) & set(weights) and length * qlen > 0:
                dot = sum(weights[w] * (1 + math.log(tf)) * math.log(n / df[w]) for w, tf in words.items() if w in weights)
                rated.append((-math.floor(dot / (qlen * length) * 1e6 + 0.5), i))
        at, scores = pages.search(terms, limit)
        assert list(zip((-scores).tolist(), pages.ids[at].tolist())) == sorted(rated)[:limit]


def test_end_of_flat_lists():
    assert search._flat(np.linspace(1, 0, 50)) == 50
    assert search._flat(np.linspace(1, 0, 1_000)) == 1_000
    assert search._flat(np.concatenate([np.linspace(1, 0.5, 150), np.full(400, 0.5)])) == 248


def test_esa_concept_vector(spark, without_rows):
    _as_sql(spark, "esa_concept_vector")


#: Queries that search by phrases.
NAMES = [
    "esa_phrase_similarity", "text_phrase_cosine", "phrase_targets", "search_map", "ensemble_map", "engine_summed_mapper",
    "engine_first_mapper", "esa_most_similar", "hierarchical_map",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_by_phrases(spark, without_rows, name):
    _as_sql(spark, name)


@pytest.mark.parametrize("name", ["esa_concept_vector", "esa_phrase_similarity"])
def test_pages_in_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(search, "BLOCK", 500)
    monkeypatch.setattr(search, "VOCABULARY", 0)
    _as_sql(spark, name)
