"""Sparse matrices as rows (row_id, col_id, value), dense ones as rows of arrays.

Several matrices may stand in one table: the columns named by ``by`` tell them apart, and each is treated by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import maths as M
from relata.operators.postings import K, SEARCH_STEP
from relata.session import reliable, table

RANK_LIMIT = 20
#: Rows that the cells of an index are fitted on at most, and the greatest number of cells.
CELL_SAMPLE, MAX_CELLS = 20_000, 1_024
#: Cells that each vector stands in, and the share of the nearest that an index is fitted to find.
COPIES, CELL_RECALL = 2, 0.95
#: Vectors of a part of the index or of the table that a task multiplies.
PART_ROWS = 20_000
#: Queries and rows of an index that are multiplied at a time.
BLOCK = 2_048


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best of each query, score first, then the smaller id, with their rank from 1."""
    w = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def transpose(m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return m.select(*by, F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")


def row_norms(m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return m.groupBy(*by, "row_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def column_summary(m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return m.groupBy(*by, "col_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("value"), 6).alias("total"))


def shape(m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(n_rows, n_cols, n_cells, longest): counted by rows and by columns, so that no distinct set is held."""
    rows = m.groupBy(*by, "row_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_cells"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"))
    cols = m.select(*by, "col_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_cols"))
    return (rows.join(cols, list(by)) if by else rows.join(F.broadcast(cols))).select(*by, "n_rows", "n_cols", "n_cells", "longest")


def row_cosines(asked: DataFrame, m: DataFrame, salts: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, score): cosine of each asked row with every row that shares a column with it.

    The product is a join on the column with partial sums before the shuffle on the pair. A hot column's rows are
    spread over ``salts`` parts, against each of which the few asked cells of that column are repeated.
    """
    left = asked.select(*by, F.col("row_id").alias("query_id"), "col_id", F.col("value").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    right = m.select(*by, F.col("row_id").alias("id"), "col_id", "value", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int").alias("salt"))
    dots = left.join(right, [*by, "col_id", "salt"]).groupBy(*by, "query_id", "id").agg(F.sum(F.col("q") * F.col("value")).alias("dot"))
    norms = row_norms(m, by)
    qn = row_norms(asked, by).select(*by, F.col("row_id").alias("query_id"), F.col("norm").alias("qn"))
    joined = dots.join(norms.withColumnRenamed("row_id", "id"), [*by, "id"]).join(qn, [*by, "query_id"])
    both = F.col("norm") * F.col("qn")
    return joined.select(*by, "query_id", "id", F.round(F.when(both > 0, F.col("dot") / both), 6).alias("score")).where("score is not null")


def pair_cosines(pairs: DataFrame, m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id1, id2, score): cosine of two rows, 0 if one is missing or they share no column. With ``by``, pairs have it too."""
    wanted = pairs.select(*by, F.explode(F.array("id1", "id2")).alias("row_id")).distinct()
    rows = m.join(wanted, [*by, "row_id"], "left_semi")
    norms = row_norms(rows, by)
    a = rows.select(*by, F.col("row_id").alias("id1"), "col_id", F.col("value").alias("va"))
    b = rows.select(*by, F.col("row_id").alias("id2"), "col_id", F.col("value").alias("vb"))
    dots = pairs.join(a, [*by, "id1"]).join(b, [*by, "id2", "col_id"]).groupBy(*by, "id1", "id2").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    na = norms.select(*by, F.col("row_id").alias("id1"), F.col("norm").alias("na"))
    nb = norms.select(*by, F.col("row_id").alias("id2"), F.col("norm").alias("nb"))
    joined = pairs.join(dots, [*by, "id1", "id2"], "left").join(na, [*by, "id1"], "left").join(nb, [*by, "id2"], "left")
    both = F.col("na") * F.col("nb")
    score = F.when(F.col("dot").isNotNull() & (both > 0), F.col("dot") / both).otherwise(F.lit(0.0))
    return joined.select(*by, "id1", "id2", F.round(score, 6).alias("score"))


def symmetric_mean(m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, col_id, value): mean of a cell and its mirror; a missing one counts as 0."""
    both = m.unionByName(transpose(m, by))
    return both.groupBy(*by, "row_id", "col_id").agg(F.round(F.sum("value") / 2, 6).alias("value"))


def row_order(m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, place): the place of each row in a matrix sorted by rows, from 0; the rows of one ``by`` follow another's."""
    rows = m.withColumn("key", F.struct(*by, "row_id"))
    return dense_ids(rows, "key").select("key.*", F.col("dense_id").alias("place"))


def dense_ids(values: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """(column, dense_id): consecutive numbers from 0 for the different values, in their order.

    Values are range-partitioned and numbered within partitions; only the partitions' row counts, one number each, are
    broadcast to shift them. NULL has no number.
    """
    n = partitions or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    different = values.select(column).where(F.col(column).isNotNull()).distinct()
    placed = reliable(different.repartitionByRange(n, column).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return placed.withColumn("_local", local).join(F.broadcast(before), "_part").select(column, (F.col("_local") + F.col("_before")).alias("dense_id"))


def block(m: DataFrame, ids: DataFrame) -> DataFrame:
    """Cells whose row and column are both in ids (id)."""
    rows = m.join(ids.select(F.col("id").alias("row_id")), "row_id", "left_semi")
    return rows.join(ids.select(F.col("id").alias("col_id")), "col_id", "left_semi").select(*m.columns)


def quantized(m: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    code = M.pack(F.col("value"))
    return m.select(*by, "row_id", "col_id", code.alias("code"), F.round(M.unpack(code), 6).alias("value"))


def _unit(rows) -> np.ndarray:
    x = np.asarray(rows.tolist(), dtype=np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _nearest(k: int | None):
    """For two groups (query_id, q) and (id, v) the k nearest of each query, or all, as matrix products of bounded size."""

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, "int64"), "id": np.zeros(0, "int64"), "score": np.zeros(0)})
        if left.empty or right.empty:
            return empty
        v, ids, out = _unit(right["v"]), right["id"].to_numpy(), []
        for begin in range(0, len(left), 256):
            part = left.iloc[begin : begin + 256]
            scores = np.round(_unit(part["q"]) @ v.T, 6) + 0.0
            for q, row in zip(part["query_id"], scores):
                best = np.lexsort((ids, -row))[:k]
                out.append(pd.DataFrame({"query_id": q, "id": ids[best], "score": row[best]}))
        return pd.concat(out, ignore_index=True)

    return near


_FOUND = "query_id bigint, id bigint, score double"


def dense_cosines(asked: DataFrame, vectors: DataFrame, k: int | None = K) -> DataFrame:
    """The k nearest of ``vectors`` (id, v) by cosine for each asked (query_id, q), or all of them if k is None. Exact:
    every query meets every vector.

    Unit vectors meet in blocks: each task multiplies its own rows with one block of the queries at a time as a matrix
    and keeps the k best of each query, so what is shuffled is k rows a query and task, not all pairs. The work grows
    with the product of both; see :func:`indexed_cosines` for large tables.
    """
    n_blocks, parts = max(1, -(-asked.count() // BLOCK)), max(1, -(-vectors.count() // PART_ROWS))
    spread = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    wide = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    nearest = wide.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInPandas(_nearest(k), _FOUND)
    return nearest if k is None else top_k(nearest, k)


@dataclass(frozen=True)
class Cells:
    """Centres of cells of unit vectors, and how many of them a query looks into."""

    centres: np.ndarray
    probes: int


def fit_cells(vectors: DataFrame, k: int = K, recall: float = CELL_RECALL, steps: int = 8) -> Cells:
    """An index fitted on at most CELL_SAMPLE rows, always the same ones: centres by k-means, and the least number of
    probes with which every fiftieth row of the sample finds the share ``recall`` of its k nearest in the sample. The
    number of cells is the root of that of the vectors and MAX_CELLS at most, so the index has a bounded size."""
    some = vectors.orderBy(F.xxhash64("id"), "id").limit(CELL_SAMPLE).select("v").toPandas()
    if some.empty:
        return Cells(np.zeros((0, 1)), 0)
    x = _unit(some["v"])
    n = min(len(x), max(1, min(MAX_CELLS, int(vectors.count() ** 0.5))))
    centres = x[np.random.default_rng(11).choice(len(x), n, replace=False)]
    for _ in range(steps):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    order = np.argsort(-(x @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[None, :].repeat(len(x), 0), axis=1)
    asking = np.arange(0, len(x), SEARCH_STEP)
    needed = []  # for each of the k nearest of a row the probes after which one of its cells is looked into
    for i in asking:
        near = np.argsort(-(x @ x[i]), kind="stable")[:k]
        needed.append(place[i][order[near, :COPIES]].min(axis=1) + 1)
    probes = int(np.ceil(np.quantile(np.concatenate(needed), recall)))
    return Cells(centres, max(1, min(n, probes)))


def in_cells(rows: DataFrame, name: str, vector: str, centres: np.ndarray, probes: int) -> DataFrame:
    """(name, vector, cell): each row in its ``probes`` nearest cells."""

    def place(batches):
        for batch in batches:
            near = np.argsort(-(_unit(batch[vector]) @ centres.T), axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({name: batch[name], vector: batch[vector], "cells": list(near.astype("int32"))})

    kind = dict(rows.dtypes)
    placed = rows.select(name, vector).mapInPandas(place, f"{name} {kind[name]}, {vector} {kind[vector]}, cells array<int>")
    return placed.select(name, vector, F.explode("cells").alias("cell"))


def indexed_cosines(asked: DataFrame, vectors: DataFrame, k: int = K, cells: Cells | None = None) -> DataFrame:
    """About the k nearest of ``vectors`` (id, v) by cosine for each asked (query_id, q), with exact scores.

    Every vector stands in its COPIES nearest cells, every query looks into as many as the index was fitted to need.
    Large cells are split into parts of about PART_ROWS vectors and BLOCK queries, so that a cell of a third of all
    vectors is no single task.
    """
    cells = fit_cells(vectors, k) if cells is None else cells
    centres, probes = cells.centres, cells.probes
    if not len(centres):
        return asked.limit(0).select(F.col("query_id").cast("bigint").alias("query_id"), F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    kept = reliable(in_cells(vectors, "id", "v", centres, COPIES))
    asking = reliable(in_cells(asked, "query_id", "q", centres, probes))
    sizes = kept.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    loads = asking.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    plan = F.broadcast(sizes.join(loads, "cell"))  # a row a cell, MAX_CELLS at most
    rows = kept.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    rows = rows.select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")
    wide = asking.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
    wide = wide.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "query_id", "q")
    keys = ["cell", "part", "block"]
    nearest = wide.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_nearest(k), _FOUND)
    return top_k(nearest.repartition("query_id").dropDuplicates(["query_id", "id"]), k)


# --- queries ------------------------------------------------------------------------------------------------------
BY = ("metric",)


def neighbour_matrix(spark, d, metric: str | None = None):
    """Finite neighbour scores as sparse matrices, one for each metric; of repeated cells the greatest counts. With a
    metric given, its matrix alone, without the column."""
    cells = table(spark, d, "neighbours").where(M.finite(F.col("score")))
    if metric is not None:
        cells = cells.where(F.col("metric") == metric)
    by = BY if metric is None else ()
    keyed = cells.where("query_id is not null and id is not null and metric is not null").groupBy(*by, F.col("query_id").alias("row_id"), F.col("id").alias("col_id"))
    return keyed.agg(F.max("score").alias("value"))


def q_matrix_transpose(spark, d):
    return transpose(neighbour_matrix(spark, d), BY)


def q_matrix_sort(spark, d):
    m = neighbour_matrix(spark, d)
    w = Window.partitionBy("metric", "row_id").orderBy(F.desc("value"), "col_id")
    return m.withColumn("rank", F.row_number().over(w))


def q_matrix_row_order(spark, d):
    return row_order(neighbour_matrix(spark, d), BY)


def q_matrix_dump(spark, d):
    """Rows as text, columns in order, in parts of the column ids from DUMP_PART * part on."""
    cells = F.array_sort(F.collect_list(F.struct("col_id", F.concat_ws("=", "col_id", F.format_string("%.4f", "value")).alias("s"))))
    part = F.floor(F.col("col_id") / DUMP_PART)
    rows = neighbour_matrix(spark, d).groupBy("metric", "row_id", part.alias("part")).agg(cells.alias("cells"))
    return rows.select("metric", "row_id", "part", F.array_join(F.transform("cells", lambda c: c["s"]), " ").alias("line"))


DUMP_PART = 1_000


def q_row_norms(spark, d):
    return row_norms(neighbour_matrix(spark, d), BY).select("metric", "row_id", F.round("norm", 6).alias("norm"))


def q_column_summary(spark, d):
    return column_summary(neighbour_matrix(spark, d), BY)


def q_matrix_shape(spark, d):
    return shape(neighbour_matrix(spark, d), BY)


def q_quantize(spark, d):
    return quantized(neighbour_matrix(spark, d), BY)


def q_pairwise_topk(spark, d):
    m = neighbour_matrix(spark, d)
    return top_k(row_cosines(m.where(F.col("row_id") % SEARCH_STEP == 0), m, by=BY), K, BY)


def _known_pairs(spark, d):
    return table(spark, d, "gold").where("id1 is not null and id2 is not null").select("id1", "id2").distinct()


METRICS = ["category", "esa", "links", "pairwise", "text"]


def q_pairwise_pairs(spark, d):
    pairs = _known_pairs(spark, d).select("id1", "id2", F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric"))
    return pair_cosines(pairs, neighbour_matrix(spark, d), BY)


def q_symmetric_mean(spark, d):
    return symmetric_mean(neighbour_matrix(spark, d), BY)


def q_cosim_block(spark, d):
    ids = _known_pairs(spark, d).select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    return symmetric_mean(block(neighbour_matrix(spark, d), ids), BY)


def q_row_lookup(spark, d):
    """Rows of the judged pages only: the semi join reaches the scan as a filter on the row."""
    ids = _known_pairs(spark, d).select(F.col("id1").alias("row_id")).distinct()
    return neighbour_matrix(spark, d).join(ids, "row_id", "left_semi").select("metric", "row_id", "col_id", "value")


def q_known_topk(spark, d):
    return top_k(neighbour_matrix(spark, d).select("metric", F.col("row_id").alias("query_id"), F.col("col_id").alias("id"), F.col("value").alias("score")), RANK_LIMIT, BY)


def _vectors(spark, d):
    return table(spark, d, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def q_dense_topk(spark, d):
    vectors = _vectors(spark, d)
    asked = vectors.where(F.col("id") % SEARCH_STEP == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return dense_cosines(asked, vectors)


def q_dense_index_topk(spark, d):
    """The same search through the index of cells; its recall is measured in the tests."""
    vectors = _vectors(spark, d)
    asked = vectors.where(F.col("id") % SEARCH_STEP == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return indexed_cosines(asked, vectors)


def q_dense_ids(spark, d):
    return dense_ids(neighbour_matrix(spark, d), "col_id")


def q_dense_cosim(spark, d):
    """Cosines within a set of rows: every fiftieth vector with every other one of them, in blocks of the search."""
    asked = _vectors(spark, d).where(F.col("id") % SEARCH_STEP == 0)
    found = dense_cosines(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), asked, None)
    return found.where("query_id <> id").select(F.col("query_id").alias("id1"), F.col("id").alias("id2"), "score")


def q_dense_norms(spark, d):
    v = _vectors(spark, d)
    return v.select("id", F.round(F.sqrt(M.dot(F.col("v"), F.col("v"))), 5).alias("norm"), F.round(M.dot(F.col("v"), F.col("v"), 8), 5).alias("head"), F.size("v").alias("n_cols"))


QUERIES = {
    "matrix_transpose": q_matrix_transpose, "matrix_sort": q_matrix_sort, "matrix_row_order": q_matrix_row_order, "matrix_dump": q_matrix_dump, "dense_cosim": q_dense_cosim, "row_norms": q_row_norms, "column_summary": q_column_summary,
    "matrix_shape": q_matrix_shape, "quantize_roundtrip": q_quantize, "pairwise_cosine_topk": q_pairwise_topk, "pairwise_cosine_pairs": q_pairwise_pairs,
    "symmetric_mean": q_symmetric_mean, "cosim_block": q_cosim_block, "row_lookup": q_row_lookup, "known_most_similar": q_known_topk,
    "dense_id_assignment": q_dense_ids, "dense_cosine_topk": q_dense_topk, "dense_index_topk": q_dense_index_topk, "dense_norms": q_dense_norms,
}


def matrix_sql(metric: str | None = None) -> str:
    kept = "metric is not null" if metric is None else f"metric = '{metric}'"
    return f"""with m as (select {'metric, ' * (metric is None)}query_id as row_id, id as col_id, max(score) as value from neighbours where {kept} and isfinite(score)
  and query_id is not null and id is not null group by all)"""


_PAIRS = "pairs as (select distinct id1, id2 from gold where id1 is not null and id2 is not null)"
_NORMS = "norms as (select metric, row_id, sqrt(sum(value * value)) as norm from m group by all)"
_MIRRORED = "select metric, row_id, col_id, round(sum(value) / 2, 6) as value from (select metric, row_id, col_id, value from m union all select metric, col_id, row_id, value from m)"
SQL = {
    "matrix_transpose": f"{matrix_sql()} select metric, col_id as row_id, row_id as col_id, value from m",
    "matrix_sort": f"{matrix_sql()} select *, cast(row_number() over (partition by metric, row_id order by value desc, col_id) as int) as rank from m",
    "matrix_row_order": f"{matrix_sql()} select metric, row_id, row_number() over (order by metric, row_id) - 1 as place from (select distinct metric, row_id from m)",
    "matrix_dump": f"""{matrix_sql()} select metric, row_id, cast(floor(col_id / {DUMP_PART}) as bigint) as part, string_agg(col_id || '=' || format('{{:.4f}}', value), ' ' order by col_id) as line from m group by all""",
    "row_norms": f"{matrix_sql()}, {_NORMS} select metric, row_id, round(norm, 6) as norm from norms",
    "column_summary": f"{matrix_sql()} select metric, col_id, count(*) as cells, round(sum(value), 6) as total from m group by all",
    "matrix_shape": f"""{matrix_sql()} select metric, count(distinct row_id) as n_rows, count(distinct col_id) as n_cols, count(*) as n_cells, max(c) as longest
      from (select *, count(*) over (partition by metric, row_id) as c from m) group by 1""",
    "quantize_roundtrip": f"""{matrix_sql()}, c as (select metric, row_id, col_id, cast(trunc((least(greatest(value, -1.1::double), 1.1::double) + 1.1::double) / (1.1::double + 1.1::double) * 65535.0::double - 32768.0::double) as smallint) as code from m)
      select metric, row_id, col_id, code, round((code + 32768.0::double) / 65535.0::double * (1.1::double + 1.1::double) + -1.1::double, 6) as value from c""",
    "pairwise_cosine_topk": f"""{matrix_sql()}, {_NORMS}, s as (select a.metric, a.row_id as query_id, b.row_id as id, sum(a.value * b.value) as dot from m a join m b using (metric, col_id) where a.row_id % 50 = 0 group by all),
      r as (select s.metric, query_id, id, round(dot / (x.norm * y.norm), 6) as score from s join norms x on x.metric = s.metric and x.row_id = query_id join norms y on y.metric = s.metric and y.row_id = id where x.norm * y.norm > 0)
      select metric, query_id, id, score, cast(rn as int) as rank from (select *, row_number() over (partition by metric, query_id order by score desc, id) as rn from r) where rn <= 10""",
    "pairwise_cosine_pairs": f"""{matrix_sql()}, {_NORMS}, {_PAIRS}, pm as (select id1, id2, unnest({METRICS}) as metric from pairs),
      s as (select a.metric, id1, id2, sum(a.value * b.value) as dot from pairs join m a on a.row_id = id1 join m b on b.metric = a.metric and b.row_id = id2 and a.col_id = b.col_id group by all)
      select pm.metric, pm.id1, pm.id2, round(case when dot is not null and x.norm * y.norm > 0 then dot / (x.norm * y.norm) else 0 end, 6) as score
      from pm left join s on s.metric = pm.metric and s.id1 = pm.id1 and s.id2 = pm.id2 left join norms x on x.metric = pm.metric and x.row_id = pm.id1 left join norms y on y.metric = pm.metric and y.row_id = pm.id2""",
    "symmetric_mean": f"{matrix_sql()} {_MIRRORED} group by all",
    "cosim_block": f"""{matrix_sql()}, {_PAIRS}, ids as (select id1 as id from pairs union select id2 from pairs) {_MIRRORED}
      where row_id in (select id from ids) and col_id in (select id from ids) group by all""",
    "row_lookup": f"{matrix_sql()}, {_PAIRS} select * from m where row_id in (select id1 from pairs)",
    "known_most_similar": f"""{matrix_sql()} select metric, row_id as query_id, col_id as id, value as score, cast(rn as int) as rank from
      (select *, row_number() over (partition by metric, row_id order by value desc, col_id) as rn from m) where rn <= {RANK_LIMIT}""",
    "dense_id_assignment": f"{matrix_sql()} select col_id, row_number() over (order by col_id) - 1 as dense_id from (select distinct col_id from m)",
    "dense_cosim": """select a.vec_id as id1, b.vec_id as id2, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
      from embeddings a join embeddings b on a.vec_id % 50 = 0 and b.vec_id % 50 = 0 and a.vec_id <> b.vec_id""",
    "dense_cosine_topk": """with s as (select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
      from embeddings a join embeddings b on a.vec_id % 50 = 0)
      select query_id, id, score, cast(rn as int) as rank from (select *, row_number() over (partition by query_id order by score desc, id) as rn from s) where rn <= 10""",
    "dense_norms": """select vec_id as id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 5) as norm,
      round(list_sum(list_transform(embedding[1:8]::double[], lambda x: x * x)), 5) as head, cast(len(embedding) as int) as n_cols from embeddings""",
}
