"""Every query of the core with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relata.operators import concepts, corpus, ensemble, evaluate, facade, files, graph, hierarchy, indexes, links, matrix, normalize, postings, references

FLAGSHIP = "text_most_similar_topk"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **corpus.QUERIES,
        **postings.QUERIES,
        **links.QUERIES,
        **matrix.QUERIES,
        **graph.QUERIES,
        **normalize.QUERIES,
        **concepts.QUERIES,
        **evaluate.QUERIES,
        **ensemble.QUERIES,
        **files.QUERIES,
        **facade.QUERIES,
        **indexes.QUERIES,
        "p3_found": references.p3_found,
        "p3_report": references.p3_report,
        "p5_found": hierarchy.p5_found,
        "p5_paths": hierarchy.p5_paths,
        "p5_descendants": hierarchy.p5_descendants,
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = dict(postings.linked_sql())
    for part in (corpus, postings, links, matrix, graph, normalize, concepts, evaluate, ensemble, files, facade, indexes, references, hierarchy):
        out |= part.SQL
    return out
