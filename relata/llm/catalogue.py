"""Queries of this subpackage and, where SQL can express them over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relata.llm import distinctive, markup, packing, ranking, reading, setjoin, tokens, topn, wrapper


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": markup.p1_found,
        "p1_text": markup.p1_text,
        "p1_wrappers": wrapper.p1_wrappers,
        "p2_found": setjoin.p2_found,
        "p2_classes": setjoin.p2_classes,
        "p4_found": ranking.p4_found,
        "p6_found": distinctive.p6_found,
        "p7_found": topn.p7_found,
        "p8_ids": tokens.p8_ids,
        "p8_counts": tokens.p8_counts,
        "p9_bins": packing.p9_bins,
        "p9_fill": packing.p9_fill,
        "p10_found": reading.p10_found,
    }


def oracle_sql() -> dict[str, str]:
    return setjoin.SQL | ranking.SQL | topn.SQL
