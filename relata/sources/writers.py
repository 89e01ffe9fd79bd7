"""Writers: indexes, matrices, dictionaries, results, model files and topic texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import maths as M


#: Share of the codec's range that a quantized value may be off by.
CODEC_ERROR = 0.001


def write_index(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """A named index; its filters, counts and boosts were joined in the same plan."""
    df.write.mode(mode).parquet(f"{folder}/{name}")


def write_sparse(m: DataFrame, path: str, quantize: bool = False, mode: str = "overwrite") -> None:
    """Rows in order of row_id within files that cover ranges of it, so that one row is found by the files' bounds.

    Quantized values are an error where the codec changes one by more than CODEC_ERROR of its range.
    """
    packed = M.unpack(M.pack(F.col("value")))
    off = F.abs(packed - F.col("value")) > CODEC_ERROR * (M.PACKED_MAX - M.PACKED_MIN)
    kept = F.when(off, F.raise_error(F.concat_ws(" ", F.lit("the codec can't hold"), "value")).cast("double")).otherwise(packed)
    out = m.select("row_id", "col_id", kept.cast("float").alias("value")) if quantize else m
    out.repartitionByRange("row_id").sortWithinPartitions("row_id").write.mode(mode).parquet(path)


def write_dense(rows: DataFrame, columns: list[int], path: str, mode: str = "overwrite") -> None:
    """(row_id, v[, col_ids]) and the shared columns; rows of another length, or with other col_ids, raise an error."""
    same = F.size("v") == len(columns)
    if "col_ids" in rows.columns:
        same &= F.col("col_ids") == F.array(*[F.lit(c) for c in columns])
    checked = rows.withColumn("v", F.when(same, F.col("v")).otherwise(F.raise_error(F.lit("a row has other columns")))).drop("col_ids")
    checked.write.mode(mode).parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(columns,)], "col_ids array<int>").coalesce(1).write.mode(mode).parquet(f"{path}/columns")


def write_dictionary(entries: DataFrame, path: str, merge_with: DataFrame | None = None) -> None:
    """Entries by text; merged with older ones if given, else in their place. The older ones must not lie at ``path``."""
    from relata.operators.concepts import merge_entries

    out = merge_entries(merge_with, entries) if merge_with is not None else entries
    out.repartition("text").sortWithinPartitions("text").write.mode("overwrite").parquet(path)


def result_lines(results: DataFrame, *by: str) -> DataFrame:
    """(*by, phrase1, phrase2, score, gold) with finite scores only."""
    return results.where(M.finite(F.col("score"))).select(*by, "phrase1", "phrase2", "score", "gold")


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    result_lines(results).write.mode(mode).csv(path, sep="\t")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Any flat table as tab-separated text with a header."""
    df.write.mode(mode).csv(path, sep="\t", header=True)


def arff_lines(df: DataFrame, features: list[str], label: str, decimals: int | None = None) -> DataFrame:
    """(value): data lines of an ARFF file, absent and NaN values as ``?``; all digits, or so many decimals."""
    shown = lambda c: F.col(c).cast("string") if decimals is None else F.format_string(f"%.{decimals}f", F.col(c) + F.lit(0.0))
    cell = lambda c: F.when(M.finite(F.col(c)), shown(c)).otherwise(F.lit("?"))
    return df.select(F.concat_ws(",", *[cell(c) for c in [*features, label]]).alias("value"))


def arff_header(features: list[str], label: str, name: str = "similarity") -> str:
    return "\n".join([f"@relation {name}", *[f"@attribute {c} real" for c in [*features, label]], "@data"])


def topic_lines(m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, value): rows of a sparse matrix as ``| id:value ...`` with six decimals, columns in order."""
    cells = F.array_sort(F.collect_list(F.struct("col_id", F.format_string("%d:%.6f", "col_id", F.col("value").cast("double")).alias("s"))))
    return m.groupBy(*by, "row_id").agg(F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: c["s"]), " ")).alias("value"))


def matrix_summary(m: DataFrame, n: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """The n columns with the most cells and the n with the greatest sum: (ranked_by, col_id, cells, total)."""
    from relata.operators.matrix import column_summary

    s = column_summary(m, by)
    out = None
    for order in ("cells", "total"):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order), "col_id")) if by else None
        top = s.withColumn("rn", rank).where(F.col("rn") <= n) if by else s.orderBy(F.desc(order), "col_id").limit(n)
        part = top.select(*by, F.lit(order).alias("ranked_by"), "col_id", "cells", "total")
        out = part if out is None else out.unionByName(part)
    return out
