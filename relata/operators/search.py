"""Search by phrases over all pages, with the scores of ``postings.matches``, without a row for each phrase and page that
share a word: those grow as the product of both.

Phrases that share their common words lie together; what these words give a page is summed and sorted once for all of
them, and only the pages of a phrase's rare words are added one by one. Word lists go to the groups of phrases that ask
for them as arrays. Lists are cut at their limit, and where scores flatten, before they leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import text as T
from relata.operators import postings as P
from relata.session import reliable

#: Postings of all asked words that one task holds; beyond it pages are split into blocks, and lists are merged.
BLOCK = 16_000_000
#: A word of more pages than this is common.
COMMON = 1_000
#: Groups of phrases: so many at least where each keeps 50, and so many phrases in each at most, about.
GROUPS, PHRASES = 24, 2_000
#: Numbers of words with their statistics that are broadcast; more are joined by a shuffle.
VOCABULARY = 500_000
#: Entries of vectors that are held at once while pairs are compared.
HELD = 8_000_000
SPAN, SHARE = 100, 0.005


# --- in the tasks -------------------------------------------------------------------------------------------------
class _Pages:
    """The pages of a block with the lists of the words that are asked."""

    def __init__(self, lists: pa.Table, n: int, common: int):
        self.n, self.common, self.lists, self.key, self.base = n, common, {}, None, None
        ids, tfs, lens = (_arrays(lists.column(c)) for c in ("ids", "tfs", "lens"))
        terms = lists.column("term").to_pylist()
        at = terms.index("") if "" in terms else None
        order = np.argsort(ids(at), kind="stable") if at is not None else np.empty(0, "int64")
        self.ids = ids(at)[order] if at is not None else np.empty(0, "int32")
        self.len = lens(at)[order] if at is not None else np.empty(0)
        self.flag = np.zeros(len(self.ids), bool)
        for i, term in enumerate(terms):
            if i != at:
                self.lists[term] = np.searchsorted(self.ids, ids(i)).astype("int32"), 1 + np.log(tfs(i))

    def _list(self, term: str, tf: int, df: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pages that have a word, and what it gives each of their products."""
        idf = math.log(self.n / df)
        at, w = self.lists.get(term, (np.empty(0, "int32"), np.empty(0)))
        return at, (1 + math.log(tf)) * idf * (w * idf)

    def _common(self, terms: list[tuple]) -> tuple:
        """Products with the common words of a phrase, pages that have one of them, best first, and these by length."""
        if self.key != terms:
            dot, hit = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
            for t in terms:
                at, w = self._list(*t)
                dot[at] += w
                hit[at] = True
            some = np.flatnonzero(hit & (self.len > 0))
            raw = dot[some] / self.len[some]
            order = np.argsort(-raw, kind="stable")
            self.key, self.base = terms, (dot, some[order], raw[order])
        return self.base

    def search(self, terms: list[tuple], limit: int, prune: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ``limit`` best pages of a phrase's words and their scores in millionths, best first."""
        qlen = math.sqrt(sum(((1 + math.log(tf)) * math.log(self.n / df)) ** 2 for _, tf, df in terms))
        if not qlen > 0:
            return np.empty(0, "int64"), np.empty(0, "int64")
        dot, order, raw = self._common([t for t in terms if t[2] > self.common])
        rare = [self._list(*t) for t in terms if t[2] <= self.common]
        own, inverse = np.unique(np.concatenate([a for a, _ in rare]), return_inverse=True) if rare else (np.empty(0, "int32"), None)
        more = np.bincount(inverse, np.concatenate([w for _, w in rare]), len(own)) if rare else np.empty(0)
        own, more = own[self.len[own] > 0], more[self.len[own] > 0]
        # Pages behind the first limit + len(own) count only if their rounded scores can be as good.
        first = limit + len(own)
        if first < len(order):
            order = order[: np.searchsorted(-raw, 2e-6 * qlen - raw[first - 1], "right")]
        self.flag[own] = True
        rest = order[~self.flag[order]]
        self.flag[own] = False
        at = np.concatenate([rest, own])
        scores = np.floor(np.concatenate([dot[rest], dot[own] + more]) / (qlen * self.len[at]) * 1e6 + 0.5).astype("int64")
        keys = np.sort(((1 << 30) - scores) << 32 | at)[:limit]
        at, scores = keys & 0xFFFFFFFF, (1 << 30) - (keys >> 32)
        end = _flat(scores / 1e6) if prune else len(at)
        return at[:end], scores[:end]


def _arrays(column: pa.ChunkedArray) -> Callable[[int], np.ndarray]:
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return lambda i: values[ends[i] : ends[i + 1]]


def _flat(scores: np.ndarray) -> int:
    """Where a list ends by the rule of ``postings.prune_tail``."""
    if len(scores) <= SPAN:
        return len(scores)
    flat = scores[:-SPAN] - scores[SPAN:] < SHARE * scores[0]
    return int(flat.argmax()) + SPAN if flat.any() else len(scores)


def _words(terms: list[dict] | None) -> list[tuple]:
    return [(t["term"], t["tf"], t["df"]) for t in terms or []]


def _frequent(terms: list[tuple], common: int) -> list[tuple]:
    return [t for t in terms if t[2] > common]


def _lists(limit: int, prune: bool, common: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(phrases: pa.Table, lists: pa.Table) -> pa.Table:
        rows = sorted(((_words(r["terms"]), i) for i, r in enumerate(phrases.select(["terms"]).to_pylist())), key=lambda r: _frequent(r[0], common))
        pages = _Pages(lists, phrases.column("n")[0].as_py(), common)
        found = [pages.search(terms, limit, prune) for terms, _ in rows]
        lengths = [len(at) for at, _ in found]
        of = np.repeat([i for _, i in rows], lengths).astype("int64")
        rank = np.concatenate([np.arange(1, n + 1, dtype="int32") for n in lengths])
        at, score = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return pa.table({"query_id": phrases.column("query_id").take(pa.array(of)), "id": pages.ids[at], "score": score / 1e6, "rank": rank})

    return run


def _cosines(limit: int, prune: bool, common: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(pairs: pa.Table, lists: pa.Table) -> pa.Table:
        a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
        words = {p: _words(t) for side, terms in ((a, "ta"), (b, "tb")) for p, t in zip(side, pairs.column(terms).to_pylist())}
        pages = _Pages(lists, next((n for n in pairs.column("n").to_pylist() if n), 1), common)
        partners: dict[str, list[str]] = {}
        for x, y in zip(a, b):
            partners.setdefault(x, []).append(y)
        by = lambda p: (_frequent(words[p], common), p)
        score: dict[tuple[str, str], float | None] = {}
        dense = np.zeros(len(pages.ids))
        held: dict[str, tuple] = {}

        def compare() -> None:
            asking: dict[str, list[str]] = {}
            for x in held:
                for y in partners[x]:
                    asking.setdefault(y, []).append(x)
            for y in sorted(asking, key=by):
                at, s = pages.search(words[y], limit, prune)
                dense[at] = s
                own = math.sqrt(float(s @ s))
                for x in asking[y]:
                    divisor = held[x][2] * own
                    score[x, y] = math.floor(float(dense[held[x][0]] @ held[x][1]) / divisor * 1e6 + 0.5) / 1e6 if divisor > 0 else None
                dense[at] = 0
            held.clear()

        size = 0
        for x in sorted(partners, key=by):
            at, s = pages.search(words[x], limit, prune)
            held[x], size = (at.astype("int32"), s.astype("int32").astype("float64"), math.sqrt(float(s @ s))), size + len(at)
            if size > HELD:
                compare()
                size = 0
        compare()
        return pa.table({"a": pairs.column("a"), "b": pairs.column("b"), "score": pa.array([score[x] for x in zip(a, b)], pa.float64())})

    return run


# --- tables -------------------------------------------------------------------------------------------------------
class _Index:
    """What the phrases (phrase) ask of the texts of docs (id, text): their words, the lists of these words and the
    lengths of all pages. Texts are read twice, so that the postings of all words are never written."""

    def __init__(self, phrases: DataFrame, docs: DataFrame):
        self.id = docs.schema["id"].dataType.simpleString()
        words = phrases.select(F.col("phrase").alias("query_id"), F.explode(T.word_tokens(F.col("phrase"))).alias("term"))
        words = reliable(words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf")))
        # One NULL besides the different words of each text: its count is the number of texts.
        tokens = T.word_tokens(F.col("text"))
        once = docs.select(F.explode(F.concat(F.array_distinct(tokens), F.array(F.lit(None).cast("string")))).alias("term"))
        stats = reliable(P.term_stats(once).join(words.select("term", F.lit(True).alias("asked")).distinct(), "term", "left"))
        n = stats.where("term is null").select(F.col("df").alias("n"))
        stats = stats.where("term is not null").join(F.broadcast(n))
        asked = words.join(stats.where("asked").select("term", "df", "n"), "term")
        self.phrases = reliable(asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "tf", "df"))).alias("terms"), F.max("n").alias("n")))
        size, known = stats.agg(F.sum(F.when(F.col("asked"), F.col("df"))), F.count(F.lit(1))).first()
        self.blocks = max(1, math.ceil((size or 0) / BLOCK))
        rated = P.postings(docs, tokens).join(F.broadcast(stats) if known <= VOCABULARY else stats, "term")
        squares = F.sum(P.weight() * P.weight()).alias("squares")
        # Words that nobody asks for are one row a page.
        parts = reliable(rated.groupBy("id", F.when(F.col("asked"), F.col("term")).alias("term")).agg(squares, F.max("tf").cast("int").alias("tf")))
        block = F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int").alias("block")
        lengths = parts.groupBy("id").agg(F.sqrt(F.sum("squares")).alias("len"))
        empty = lambda kind: F.array().cast(f"array<{kind}>")
        of_words = parts.where("term is not null").groupBy(block, "term").agg(F.collect_list("id").alias("ids"), F.collect_list("tf").alias("tfs"))
        of_pages = lengths.groupBy(block).agg(F.collect_list("id").alias("ids"), F.collect_list("len").alias("lens"))
        self.lists = of_words.select("block", "term", "ids", "tfs", empty("double").alias("lens")).unionByName(
            of_pages.select("block", F.lit("").alias("term"), "ids", empty("int").alias("tfs"), "lens")
        )

    def grouped(self, rows: DataFrame, key: Column, spread: str, terms: Column):
        """rows in groups by a key, larger ones of them split by a hash of a column, cogrouped with the lists of their terms."""
        count = rows.count()
        groups = max(1, min(GROUPS, math.ceil(count / 50)), math.ceil(count / PHRASES))
        part = max(1, count // (4 * groups))
        sized = rows.withColumn("key", key).withColumn("parts", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("key")) / part))
        rows = sized.withColumn("group", F.pmod(F.xxhash64("key", F.pmod(F.xxhash64(spread), F.col("parts"))), F.lit(groups)).cast("int")).drop("key", "parts")
        needed = rows.select(F.col("group").alias("at"), F.explode(F.concat(F.array(F.lit("")), terms)).alias("term")).distinct()
        lists = self.lists.join(needed, "term").withColumn("group", F.col("at") + 0).drop("at").repartition(groups * self.blocks, "group", "block")
        blocks = F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block")
        rows = rows.select("*", blocks).repartition(groups * self.blocks, "group", "block")
        return rows.groupBy("group", "block").cogroup(lists.groupBy("group", "block"))


def most_similar(phrases: DataFrame, docs: DataFrame, limit: int, prune: bool = False) -> DataFrame:
    """(query_id, id, score, rank) for phrases (phrase): the ``limit`` best pages of docs (id, text), cut where scores
    flatten if asked."""
    at = _Index(phrases, docs)
    common = F.xxhash64(F.transform(F.filter("terms", lambda t: t["df"] > COMMON), lambda t: F.struct(t["term"], t["tf"])))
    grouped = at.grouped(at.phrases, common, "query_id", F.col("terms.term"))
    found = grouped.applyInArrow(_lists(limit, prune and at.blocks == 1, COMMON), f"query_id string, id {at.id}, score double, rank int")
    if at.blocks == 1:
        return found
    whole = P.top_k(found.drop("rank"), limit)
    return P.prune_tail(reliable(whole), SPAN, SHARE) if prune else whole


def cosines(pairs: DataFrame, docs: DataFrame, limit: int, prune: bool = False) -> DataFrame:
    """(a, b, score) for phrase pairs (a, b): the cosine of their lists; NULL if one is empty. Lists leave no task unless
    pages are split into blocks."""
    phrases = pairs.select(F.explode(F.array("a", "b")).alias("phrase")).distinct()
    if (at := _Index(phrases, docs)).blocks > 1:
        return P.vector_cosine(pairs, reliable(most_similar(phrases, docs, limit, prune)))
    of = lambda side: at.phrases.select(F.col("query_id").alias(side), F.col("terms").alias(f"t{side}"), F.col("n").alias(f"n{side}"))
    rows = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("n", F.coalesce("na", "nb")).drop("na", "nb")
    either = F.array_union(*[F.coalesce(F.col(f"{t}.term"), F.array().cast("array<string>")) for t in ("ta", "tb")])
    return at.grouped(reliable(rows), F.xxhash64("a"), "b", either).applyInArrow(_cosines(limit, prune, COMMON), "a string, b string, score double")
