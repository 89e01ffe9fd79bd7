"""Measures, mappers and their registry: one object that holds a session, tables and named components.

Every measure answers for whole tables: ``similarity`` takes pairs (id1, id2), ``most_similar`` takes queries
(query_id). One pair or one query is a table of one row.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.config import Config
from relata.functions import maths as M
from relata.functions import text as T
from relata.functions.stemmer import analyzed
from relata import cache, timing
from relata.operators import calibrate, concepts, corpus, ensemble, graph, links, matrix, search
from relata.operators import postings as P
from relata.operators.calibrate import Normalizer
from relata.operators.postings import top_k
from relata.session import reliable, table
from relata.sources import readers

DEFAULT_RESULTS = 500
MAX_PHRASES = 1_000


class Measure:
    """A measure of relatedness. Raw scores pass a fitted normalizer if one is set, for pairs and for lists each."""

    name = "measure"
    pair_normalizer = Normalizer("identity")
    list_normalizer = Normalizer("identity")
    cached: DataFrame | None = None

    def raw_similarity(self, pairs: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{self.name} doesn't rate pairs")

    def raw_most_similar(self, queries: DataFrame, valid: DataFrame | None, k: int = DEFAULT_RESULTS) -> DataFrame:
        """(query_id, id, score), with the k best ids of each query at least."""
        raise NotImplementedError(f"{self.name} has no lists")

    def similarity(self, pairs: DataFrame) -> DataFrame:
        """(id1, id2, score) for each different pair; NULL where nothing is known."""
        return self.pair_normalizer.on(self.raw_similarity(pairs.select("id1", "id2").distinct()))

    def ranked(self, queries: DataFrame, k: int, valid: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank) before the normalizer."""
        asked = queries.select("query_id").distinct()
        if self.cached is None:
            return top_k(self.raw_most_similar(asked, valid, k), k)
        found = self.cached.join(asked, "query_id", "left_semi").select("query_id", "id", "score")
        return top_k(found if valid is None else found.join(valid.select("id").distinct(), "id", "left_semi"), k)

    def most_similar(self, queries: DataFrame, k: int = DEFAULT_RESULTS, valid: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k best ids of each query, of those in ``valid`` (id) if given.

        Lists computed before, if there are any, stand in for the search.
        """
        return self.list_normalizer.on(self.ranked(queries, k, valid)).select("query_id", "id", "score", "rank")

    def calibrate(self, gold: DataFrame, pairs: Any = None, lists: Any = None, k: int = DEFAULT_RESULTS) -> Measure:
        """Fit the normalizers of the entries ``pairs`` and ``lists`` on judged pairs (id1, id2, y).

        For lists, the judged page's score and rank in the list of the other count, absent ones as missing.
        """
        labels = gold.groupBy("id1", "id2").agg(F.avg("y").alias("y"))
        key = F.concat_ws("-", "id1", "id2").alias("key")
        if calibrate.parameters(pairs)["type"] == "rankandscore":
            raise ValueError("rankAndScore rates lists only")
        if calibrate.parameters(pairs)["type"] != "identity":
            scored = reliable(self.raw_similarity(labels.select("id1", "id2")).join(labels, ["id1", "id2"]).select(key, F.col("score").alias("x"), "y"))
            self.pair_normalizer = calibrate.fitted(pairs, scored)
        if calibrate.parameters(lists)["type"] != "identity":
            found = self.ranked(labels.select(F.col("id1").alias("query_id")), k).select(F.col("query_id").alias("id1"), F.col("id").alias("id2"), F.col("score").alias("x"), "rank")
            self.list_normalizer = calibrate.fitted(lists, reliable(labels.join(found, ["id1", "id2"], "left").select(key, "x", "y", "rank")))
        return self

    def all_lists(self, ids: DataFrame, k: int, valid: DataFrame | None = None) -> DataFrame:
        """The neighbour matrix (row_id, col_id, value, rank) of all ids in one job."""
        found = self.most_similar(ids.select(F.col("id").alias("query_id")), k, valid)
        return found.select(F.col("query_id").alias("row_id"), F.col("id").alias("col_id"), F.col("score").alias("value"), "rank")


class IndexedMeasure(Measure):
    """Over postings (term, id, tf) of documents (id)."""

    def __init__(self, name: str, docs: DataFrame, index: DataFrame, rule: P.TermRule | None = None):
        self.name, self.docs, self.rule = name, docs.select("id"), rule or P.TermRule()
        _, self.index, self.stats = P._searchable(self.docs, index)

    def _asked(self, queries: DataFrame) -> DataFrame:
        mine = self.index.join(queries.select(F.col("query_id").alias("id")), "id", "left_semi")
        return P.select_terms(mine, self.stats, self.rule).withColumnRenamed("id", "query_id")

    def raw_most_similar(self, queries, valid, k=DEFAULT_RESULTS):
        inside = self.index if valid is None else self.index.join(valid.select("id").distinct(), "id", "left_semi")
        return P.matches(self._asked(queries), inside, self.stats, P.lengths(inside, self.stats))

    def raw_similarity(self, pairs):
        known = pairs.join(self.docs.withColumnRenamed("id", "id1"), "id1", "left_semi").join(self.docs.withColumnRenamed("id", "id2"), "id2", "left_semi")
        inside = self.index.join(known.select(F.col("id2").alias("id")).distinct(), "id", "left_semi")
        found = P.matches(self._asked(known.select(F.col("id1").alias("query_id")).distinct()), inside, self.stats, P.lengths(inside, self.stats))
        scored = found.select(F.col("query_id").alias("id1"), F.col("id").alias("id2"), "score")
        rated = known.join(scored, ["id1", "id2"], "left").select("id1", "id2", F.coalesce("score", F.lit(0.0)).alias("score"))
        return pairs.join(rated, ["id1", "id2"], "left")


class ConceptMeasure(IndexedMeasure):
    """As an index, but long lists are cut where their scores flatten. Queries that the index of concepts lacks ask with
    the terms of ``fallback``, postings of a wider index over the same terms."""

    def __init__(self, name: str, docs: DataFrame, index: DataFrame, fallback: DataFrame | None = None, rule: P.TermRule | None = None):
        super().__init__(name, docs, index, rule)
        self.fallback = fallback

    def _asked(self, queries):
        own = super()._asked(queries)
        if self.fallback is None:
            return own
        return own.unionByName(P.fallback_terms(queries, self.docs, self.fallback, self.stats, self.rule))

    def raw_most_similar(self, queries, valid, k=DEFAULT_RESULTS):
        return P.prune_tail(top_k(super().raw_most_similar(queries, valid, k), max(5_000, k))).select("query_id", "id", "score")


class LinkMeasure(Measure):
    """Overlap of link sets. kind: jaccard, google, tfidf, logodds, or milne_witten over in-links."""

    KINDS = {"jaccard": links.jaccard, "google": links.google, "tfidf": links.tfidf, "logodds": links.log_odds, "milne_witten": lambda: links.google(sigmoid=False)}

    def __init__(self, name: str, edges: DataFrame, pages: DataFrame, kind: str = "google"):
        if kind not in self.KINDS:
            raise ValueError(f"unknown kind of link measure: {kind}")
        self.name, self.kind, self.edges = name, kind, edges
        self.pages = pages.select("id").distinct()

    def raw_similarity(self, pairs):
        inward = self.kind == "milne_witten"
        ends = ("dst", "src") if inward else ("src", "dst")
        sets = self.edges.select(F.col(ends[0]).alias("id"), F.col(ends[1]).alias("link"))
        return links.link_overlap(pairs, sets, self.pages, 3 if inward else 0).select("id1", "id2", self.KINDS[self.kind]().alias("score"))

    def raw_most_similar(self, queries, valid, k=DEFAULT_RESULTS):
        index = self.edges.select(F.col("dst").alias("term"), F.col("src").alias("id"), F.lit(1).cast("bigint").alias("tf"))
        return IndexedMeasure(self.name, self.pages, index, P.TermRule(min_tf=1, max_percent=20.0)).raw_most_similar(queries, valid, k)


class CategoryMeasure(Measure):
    def __init__(self, name: str, member: DataFrame, up: DataFrame, ids: DataFrame, costs: DataFrame | None = None):
        self.name, self.member, self.up, self.ids = name, member, up, ids.select("id").where("id is not null").distinct()
        self.costs = reliable(graph.rank_costs(graph.vocabulary(up, member), up)) if costs is None else costs
        self.least = self.costs.agg(F.min("cost").alias("least"))

    def _scored(self, df):
        return df.join(F.broadcast(self.least)).withColumn("score", M.distance_score(F.col("distance"), F.col("least")))

    def raw_similarity(self, pairs):
        wanted = pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
        pages = graph.up_distances(self.member.join(wanted, "id", "left_semi"), self.costs, graph.steps_up(self.up, self.costs))
        return graph.known_or_zero(self._scored(graph.pair_distances(pairs, pages, self.costs)), self.ids)

    def raw_most_similar(self, queries, valid, k=DEFAULT_RESULTS):
        member = self.member if valid is None else self.member.join(valid.select("id").union(queries.select(F.col("query_id"))).distinct(), "id", "left_semi")
        return self._scored(graph.most_similar_pages(queries, member, self.costs, self.up, k)).select("query_id", "id", "score")


class PairwiseMeasure(Measure):
    """Cosine of rows of a neighbour matrix (row_id, col_id, value)."""

    def __init__(self, name: str, m: DataFrame):
        self.name, self.m = name, m

    def raw_similarity(self, pairs):
        return matrix.pair_cosines(pairs, self.m)

    def raw_most_similar(self, queries, valid, k=DEFAULT_RESULTS):
        rows = self.m if valid is None else self.m.join(valid.select(F.col("id").alias("row_id")).distinct(), "row_id", "left_semi")
        return matrix.row_cosines(self.m.join(queries.select(F.col("query_id").alias("row_id")), "row_id", "left_semi"), rows)


class KnownMeasure(Measure):
    """Scores as they stand in a matrix: the mean of both directions. Ids that the matrix doesn't know are an error,
    raised when the scores are computed, unless ``strict`` is off, which gives them NULL."""

    def __init__(self, name: str, m: DataFrame, strict: bool = True):
        self.name, self.m, self.strict = name, matrix.symmetric_mean(m), strict

    def raw_similarity(self, pairs):
        cells = self.m.select(F.col("row_id").alias("id1"), F.col("col_id").alias("id2"), F.col("value").alias("score"))
        found = pairs.join(cells, ["id1", "id2"], "left")
        if not self.strict:
            return found
        for c in ("id1", "id2"):
            found = found.join(self.m.select(F.col("row_id").alias(c), F.lit(True).alias(f"has_{c}")).distinct(), c, "left")
        known = F.col("has_id1").isNotNull() & F.col("has_id2").isNotNull()
        error = F.raise_error(F.concat_ws(" ", F.lit("unknown id in the pair"), "id1", "id2")).cast("double")
        return found.select("id1", "id2", F.when(known, F.coalesce("score", F.lit(0.0))).otherwise(error).alias("score"))

    def raw_most_similar(self, queries, valid, k=DEFAULT_RESULTS):
        cells = self.m.select(F.col("row_id").alias("query_id"), F.col("col_id").alias("id"), F.col("value").alias("score")).join(queries, "query_id", "left_semi")
        return cells if valid is None else cells.join(valid.select("id").distinct(), "id", "left_semi")


class DenseMeasure(Measure):
    """Cosine of dense rows (id, v). Lists are exact, or come from an index of cells where ``indexed``."""

    def __init__(self, name: str, vectors: DataFrame, indexed: bool = False):
        self.name, self.vectors, self.indexed, self.cells = name, vectors, indexed, None

    def raw_similarity(self, pairs):
        a = self.vectors.select(F.col("id").alias("id1"), F.col("v").alias("va"))
        b = self.vectors.select(F.col("id").alias("id2"), F.col("v").alias("vb"))
        both = pairs.join(a, "id1", "left").join(b, "id2", "left")
        return both.select("id1", "id2", F.when(F.col("va").isNull() | F.col("vb").isNull(), 0.0).otherwise(M.cosine(F.col("va"), F.col("vb"))).alias("score"))

    def raw_most_similar(self, queries, valid, k=DEFAULT_RESULTS):
        asked = self.vectors.join(queries.select(F.col("query_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        rows = self.vectors if valid is None else self.vectors.join(valid.select("id").distinct(), "id", "left_semi")
        if not self.indexed:
            return matrix.dense_cosines(asked, rows, k).select("query_id", "id", "score")
        self.cells = matrix.fit_cells(self.vectors) if self.cells is None else self.cells
        return matrix.indexed_cosines(asked, rows, k, self.cells).select("query_id", "id", "score")


class SplitMeasure(Measure):
    """Pairs from one measure, lists from another."""

    def __init__(self, name: str, pairs: Measure, lists: Measure):
        self.name, self.pairs, self.lists = name, pairs, lists

    def raw_similarity(self, pairs):
        return self.pairs.similarity(pairs)

    def raw_most_similar(self, queries, valid, k=DEFAULT_RESULTS):
        return self.lists.most_similar(queries, k, valid).select("query_id", "id", "score")


class EnsembleMeasure(Measure):
    """A linear model of the features of its parts, one for pairs and one for lists, fitted on judged pairs (id1, id2, y).

    Before it is trained, a score is the mean of the parts' scores, absent ones as their mean.
    """

    def __init__(self, name: str, parts: list[Measure], least: int = 1, results: int = DEFAULT_RESULTS):
        self.name, self.parts, self.least, self.results = name, sorted(parts, key=lambda m: m.name), least, results
        self.pairs: ensemble.Linear | None = None
        self.lists: ensemble.Linear | None = None

    @property
    def columns(self) -> list[str]:
        return [T.feature_slug(m.name, i) for i, m in enumerate(self.parts)]

    def _scores(self, pairs: DataFrame) -> DataFrame:
        """(metric, id1, id2, x) of all parts for the pairs and their reverse."""
        both = pairs.select("id1", "id2").unionByName(pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"))).distinct()
        out = None
        for m, c in zip(self.parts, self.columns):
            part = m.similarity(both).select(F.lit(c).alias("metric"), "id1", "id2", F.when(M.finite(F.col("score")), F.col("score")).alias("x"))
            out = part if out is None else out.unionByName(part)
        return out

    def _lists(self, queries: DataFrame, k: int, valid: DataFrame | None) -> DataFrame:
        """(query_id, id, metric, score, rank): the 2k best of each part."""
        out = None
        for m, c in zip(self.parts, self.columns):
            part = m.most_similar(queries, 2 * k, valid).where(M.finite(F.col("score"))).select("query_id", "id", F.lit(c).alias("metric"), "score", "rank")
            out = part if out is None else out.unionByName(part)
        return out

    def train(self, gold: DataFrame) -> EnsembleMeasure:
        labels = reliable(gold.groupBy("id1", "id2").agg(F.avg("y").alias("y")))
        long = reliable(ensemble.both_directions(self._scores(labels), labels, self.columns))
        self.pairs = ensemble.fit_pairs(long, labels, self.columns)
        asked = labels.select(F.col("id1").alias("query_id")).distinct()
        self.lists = ensemble.fit_lists(reliable(self._lists(asked, self.results, None)), labels, self.columns, self.results)
        return self

    def raw_similarity(self, pairs):
        scores = reliable(self._scores(pairs))
        long = ensemble.both_directions(scores, pairs, self.columns)
        enough = long.groupBy("id1", "id2").agg(F.count("s1").alias("n"), F.avg("s1").alias("mean")).where(F.col("n") >= self.least)
        if self.pairs is None:
            rated = enough.select("id1", "id2", F.col("mean").alias("score"))
        else:
            rated = self.pairs.on(ensemble.pair_features(long, self.pairs.features), ["id1", "id2"], ensemble.PAIR_FEATURES).join(enough.select("id1", "id2"), ["id1", "id2"], "left_semi")
        return pairs.join(rated, ["id1", "id2"], "left").select("id1", "id2", "score")

    def raw_most_similar(self, queries, valid, k=DEFAULT_RESULTS):
        lists = self._lists(queries, k, valid)
        enough = lists.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")).where(F.col("n") >= self.least)
        if self.lists is None:
            return enough.select("query_id", "id", "score")
        features = ensemble.list_features(ensemble.in_lists(reliable(lists), self.columns), self.lists.features, k)
        rated = self.lists.on(features, ["query_id", "id"], ensemble.LIST_FEATURES).join(enough.select("query_id", "id"), ["query_id", "id"], "left_semi")
        return rated.where("score is not null and not isnan(score)")

    def save(self, path: str) -> None:
        names = {c: m.name for m, c in zip(self.parts, self.columns)}
        ensemble.write_models(path, {"pairs": self.pairs, "lists": self.lists}, names)

    def load(self, path: str, spark: SparkSession, prune: bool = True) -> EnsembleMeasure:
        """Take over the saved models for the parts at hand, whatever their order. Parts the models lack have no weight;
        what they hold for parts that aren't at hand goes, or is an error without ``prune``."""
        models = ensemble.read_models(path, spark, {m.name: c for m, c in zip(self.parts, self.columns)}, prune)
        self.pairs, self.lists = models["pairs"], models["lists"]
        return self


class Engine:
    """Tables of one folder, and measures and mappers by name. Measures are built when they're first asked for."""

    def __init__(
        self, spark: SparkSession, folder: str, config: Config | None = None, results: int | None = None,
        gold_files: dict[str, str] | None = None, titles: bool = False, models: str | None = None,
    ):
        """gold_files: files of judged phrase pairs for ``similarity`` and ``mostSimilar``, in place of the table gold. titles:
        phrases are titles of pages. models: a folder that keeps what is dear to compute."""
        self.spark, self.folder, self.gold_files, self.titles, self.models = spark, folder, gold_files or {}, titles, models
        self.config = config or Config({})
        self.results = results or self.config.integer("num-results", DEFAULT_RESULTS)
        self._measures: dict[str, Measure] = {}
        self._makers: dict[str, Callable[[Config], Measure]] = {
            "text": self._text, "esa": self._esa, "links": self._links, "category": self._category, "pairwise": self._pairwise,
            "densematrix": self._dense, "known": self._known, "split": self._split, "ensemble": self._ensemble,
        }

        self._mappers: dict[str, Callable[[DataFrame, int, list[str]], DataFrame]] = {
            "dictionary": self._map_dictionary, "titles": self._map_titles, "search": self._map_search, "ensemble": self._map_summed,
            "hierarchical": self._map_first,
        }

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def register(self, kind: str, maker: Callable[[Config], Measure]) -> None:
        """Add a kind of measure of one's own."""
        self._makers[kind] = maker

    def measure(self, name: str) -> Measure:
        if name not in self._measures:
            metrics = self.config.data.get("metrics", {})
            section = Config(metrics[name], name).check("metrics") if name in metrics else Config({"type": name}, name)
            kind = section.string("type")
            if kind not in self._makers:
                raise KeyError(f"unknown kind of measure: {kind}")
            made = self._makers[kind](section)
            made.name = name
            entries = section.data.get("similarityNormalizer"), section.data.get("mostSimilarNormalizer")
            if any(calibrate.parameters(e)["type"] != "identity" for e in entries):
                with timing.phase(f"calibrate {name}"):
                    if entries[0] is not None:
                        made.calibrate(self.gold(), entries[0], None, self.results)
                    if entries[1] is not None:
                        made.calibrate(self.gold("mostSimilar"), None, entries[1], self.results)
            self._measures[name] = made
        return self._measures[name]

    def pages(self) -> DataFrame:
        return corpus.current_pages(self.table("pages"))

    def edges(self) -> DataFrame:
        return links.edges(self.table("links"), corpus.title_ids(self.table("pages")))

    def gold(self, kind: str = "similarity") -> DataFrame:
        """(id1, id2, y): judged pairs for ``similarity`` or ``mostSimilar``; phrases of files are mapped to pages."""
        if kind in self.gold_files:
            read = readers.read_gold(self.spark, self.gold_files[kind])
            top = reliable(self.map_phrases(read.select(F.explode(F.array("phrase1", "phrase2")).alias("phrase")).distinct(), 1).select("phrase", "id"))
            one, two = (top.select(F.col("phrase").alias(f"phrase{i}"), F.col("id").alias(f"id{i}")) for i in (1, 2))
            return read.join(one, "phrase1").join(two, "phrase2").select("id1", "id2", F.col("similarity").alias("y"))
        judged = self.table("gold").where("id1 is not null and id2 is not null and similarity is not null")
        return judged.select("id1", "id2", F.col("similarity").alias("y"))

    def mapper(self, name: str) -> Callable[[DataFrame, int], DataFrame]:
        """The mapper of a name in the section concept-mappers, or of a kind: it takes phrases (phrase) and a number n and
        gives the n best (phrase, rank, id, score)."""
        sections = self.config.data.get("concept-mappers", {})
        section = Config(sections[name], name).check("concept-mappers") if name in sections else Config({"type": name}, name)
        kind, parts = section.string("type"), section.strings("delegates", [])
        if kind not in self._mappers:
            raise KeyError(f"unknown kind of mapper: {kind}")
        return lambda phrases, n: self._mappers[kind](phrases.select("phrase").distinct(), section.integer("maxConcepts", n), parts)

    def register_mapper(self, kind: str, make: Callable[[DataFrame, int, list[str]], DataFrame]) -> None:
        """Add a kind of mapper of one's own: (phrases, n, names of the mappers it uses) to (phrase, rank, id, score)."""
        self._mappers[kind] = make

    def map_phrases(self, phrases: DataFrame, n: int = concepts.CONCEPTS) -> DataFrame:
        """(phrase, rank, id, score) by the mapper ``main`` if there is one, else by title if phrases are titles, else by
        the anchor dictionary."""
        if "main" in self.config.data.get("concept-mappers", {}):
            return self.mapper("main")(phrases, n)
        return self.mapper("titles" if self.titles else "dictionary")(phrases, n)

    def _map_titles(self, phrases: DataFrame, n: int, parts: list[str]) -> DataFrame:
        named = phrases.select("phrase", corpus.canonical_title(F.col("phrase")).alias("title")).join(corpus.title_ids(self.table("pages")), "title")
        return named.select("phrase", F.lit(1).alias("rank"), "id", F.lit(1.0).alias("score"))

    def _map_search(self, phrases: DataFrame, n: int, parts: list[str]) -> DataFrame:
        """The best search results of a phrase by text, those most linked to first."""
        docs = self.pages().where("text is not null and redirect is null").select("id", "text")
        found = search.most_similar(phrases.select("phrase"), docs, 10 * n)
        return concepts.search_phrases(found, links.inlink_counts(self.edges()), n)

    def _map_summed(self, phrases: DataFrame, n: int, parts: list[str]) -> DataFrame:
        return concepts.summed_mappers(n, *[self.mapper(p)(phrases, 5 * n) for p in parts])

    def _map_first(self, phrases: DataFrame, n: int, parts: list[str]) -> DataFrame:
        return concepts.first_mapper(*[self.mapper(p)(phrases, n) for p in parts])

    def _map_dictionary(self, phrases: DataFrame, n: int, parts: list[str]) -> DataFrame:
        cur = self.pages().select(corpus.canonical_title(F.col("title")).alias("title"), corpus.canonical_title(F.col("redirect")).alias("to"))
        moves = corpus.follow_redirects(cur.where("title <> '' and to <> ''").groupBy("title").agg(F.min("to").alias("to")))
        return concepts.map_phrases(phrases, concepts.dictionary(self.table("links")), moves, corpus.title_ids(self.table("pages")), n)

    def phrase_similarity(self, pairs: DataFrame, measure: str) -> DataFrame:
        """(a, b, score) for phrase pairs (a, b): both are mapped to pages, the best candidates are rated."""
        mapped = self.map_phrases(pairs.select(F.explode(F.array("a", "b")).alias("phrase")).distinct())
        m = self.measure(measure)
        ids = concepts.disambiguate(pairs.select("a", "b").distinct(), mapped, m.similarity)
        rated = m.similarity(ids.where("id_a is not null and id_b is not null").select(F.col("id_a").alias("id1"), F.col("id_b").alias("id2")))
        return ids.join(rated.select(F.col("id1").alias("id_a"), F.col("id2").alias("id_b"), "score"), ["id_a", "id_b"], "left").select("a", "b", "score")

    def phrase_matrix(self, phrases: DataFrame, measure: str) -> DataFrame:
        """(a, b, score): every phrase of a small list against every other one; NULL where one maps to no page.

        The list is the caller's own, of MAX_PHRASES at most; it is checked, as the result grows with its square.
        """
        listed = [r["phrase"] for r in phrases.select("phrase").distinct().limit(MAX_PHRASES + 1).collect()]
        if len(listed) > MAX_PHRASES:
            raise ValueError(f"a phrase matrix holds at most {MAX_PHRASES} phrases")
        top = self.map_phrases(phrases.select("phrase").distinct(), 1).select("phrase", "id")
        one = self.spark.createDataFrame([(x,) for x in listed], "a string")
        grid = one.select("a", F.explode(F.array(*[F.lit(x) for x in listed])).alias("b")).where("a <> b")
        ids = grid.join(top.select(F.col("phrase").alias("a"), F.col("id").alias("id1")), "a", "left").join(top.select(F.col("phrase").alias("b"), F.col("id").alias("id2")), "b", "left")
        rated = self.measure(measure).similarity(ids.where("id1 is not null and id2 is not null"))
        return ids.join(rated, ["id1", "id2"], "left").select("a", "b", "score")

    def phrase_most_similar(self, phrases: DataFrame, measure: str, k: int | None = None) -> DataFrame:
        """(phrase, id, score, rank) for phrases (phrase): the lists of the page each maps to."""
        top = self.map_phrases(phrases, 1).select("phrase", F.col("id").alias("query_id"))
        found = self.measure(measure).most_similar(top.select("query_id"), k or self.results)
        return top.join(found, "query_id").select("phrase", "id", "score", "rank")

    def phrase_vector_similarity(self, pairs: DataFrame, measure: str, k: int | None = None) -> DataFrame:
        """(a, b, score) for phrase pairs (a, b): the cosine of the two phrases' lists by a measure."""
        lists = self.phrase_most_similar(pairs.select(F.explode(F.array("a", "b")).alias("phrase")).distinct(), measure, k)
        return P.vector_cosine(pairs.select("a", "b").distinct(), reliable(lists.select(F.col("phrase").alias("query_id"), "id", "score")))

    def phrase_targets(self, pairs: DataFrame, measure: str, k: int | None = None) -> DataFrame:
        """(a, b, id, score, rank) for phrase pairs (a, b): the page in the list of a that most likely is meant by b."""
        lists = self.phrase_most_similar(pairs.select(F.col("a").alias("phrase")).distinct(), measure, k)
        return concepts.targets_in_lists(pairs, lists, self.map_phrases(pairs.select(F.col("b").alias("phrase")).distinct(), 2 * concepts.CONCEPTS))

    # makers
    def _text(self, c: Config) -> Measure:
        docs = self.pages().where("text is not null and redirect is null").select("id", "text")
        rule = P.TermRule(c.integer("minTermFreq", 2), c.integer("minDocFreq", 2), c.number("maxPercentage", 10))
        return IndexedMeasure("text", docs, P.postings(docs, T.word_tokens(F.col("text"))), rule)

    def _esa(self, c: Config) -> Measure:
        """Concepts are the pages fit for an index; stop words go and words are stemmed. Other pages ask with their text."""
        pages = self.pages().where("text is not null and redirect is null")
        tokens = analyzed(F.col("text"), readers.stop_words(path=c.string("stopWords", "") or None), stemming=c.boolean("stemming", True))
        every = reliable(P.postings(pages.select("id", "text"), tokens))
        fit = corpus.included(pages, min_words=c.integer("minWords", corpus.MIN_WORDS), min_links=c.integer("minLinks", corpus.MIN_LINKS)).select("id")
        return ConceptMeasure("esa", fit, every.join(fit, "id", "left_semi"), every)

    def _links(self, c: Config) -> Measure:
        return LinkMeasure("links", self.edges(), self.table("pages").where("id is not null"), c.string("similarity", "google"))

    def _category(self, c: Config) -> Measure:
        member, up = graph.memberships(self.table("page_cat")), graph.parents(self.table("cat_parent"))
        costs = None
        if self.models:
            make = lambda: graph.rank_costs(graph.vocabulary(up, member), up)
            costs = cache.kept(self.spark, f"{self.models}/category-costs", [f"{self.folder}/{t}.parquet" for t in ("page_cat", "cat_parent")], make)
        return CategoryMeasure("category", member, up, self.table("pages"), costs)

    def _pairwise(self, c: Config) -> Measure:
        return PairwiseMeasure("pairwise", matrix.neighbour_matrix(self.spark, self.folder, c.string("matrix", "esa")))

    def _known(self, c: Config) -> Measure:
        return KnownMeasure("known", matrix.neighbour_matrix(self.spark, self.folder, c.string("matrix", "pairwise")), c.boolean("strict", True))

    def _dense(self, c: Config) -> Measure:
        return DenseMeasure("densematrix", self.table("embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), c.boolean("indexed", False))

    def _split(self, c: Config) -> Measure:
        pairs, lists = c.strings("delegates")
        return SplitMeasure("split", self.measure(pairs), self.measure(lists))

    def _ensemble(self, c: Config) -> Measure:
        return EnsembleMeasure("ensemble", [self.measure(n) for n in c.strings("components")], c.integer("minComponents", 1), self.results)
