"""Texts of varying length into containers of fixed capacity (problem 9)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.tokens import FOLDER, token_counts
from relata.session import reliable, table

#: Texts packed together. A group of this size leaves almost no room at its end that a larger one would fill, and it
#: bounds what one task holds, however many texts there are.
GROUP_SIZE = 20_000


class Tournament:
    """Free room of bins in a tournament tree: every inner node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take room for size in the first bin that has it; its number. There must be one."""
        most, at, leaves = self.most, 1, self.leaves
        while at < leaves:
            at *= 2
            if most[at] < size:
                at += 1
        most[at] -= size
        found = at - leaves
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size, in the order given: the largest sizes choose first, each the first bin with room for it.

    No size may exceed the capacity. Sizes of 0 go into the first bin.
    """
    if any(s > capacity for s in sizes):
        raise ValueError("a size exceeds the capacity")
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree = Tournament(len(sizes), capacity)
    out = [0] * len(sizes)
    for i in order:
        out[i] = tree.place(sizes[i])
    return out


def pieces(items: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity, doc_id, part, start, tokens): the parts that must be placed.

    Texts are told apart by doc_id; rows without one are texts of their own, told apart by the
    number ``row`` that items must then have. A text no larger than the capacity is one part. A larger one is split into full parts and a last one with the rest.
    containers is a small fixed table of a few rows; each row of items is repeated for each of them.
    """
    sized = containers.where("capacity > 0").select("container", F.col("capacity").cast("int").alias("capacity")).distinct()
    if "row" not in items.columns:
        items = items.withColumn("row", F.lit(None).cast("bigint"))
    kinds = [(r["container"], r["capacity"]) for r in sized.collect()]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(k).alias("capacity")) for c, k in kinds]))
    wide = items.select("doc_id", "row", "n_tokens", each.alias("c")).select("doc_id", "row", "n_tokens", "c.*")  # one row a text and container
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1)
    return wide.select("*", F.explode(F.sequence(F.lit(0), last)).alias("part")).select(
        "container", "capacity", "doc_id", "row", "part", (F.col("part") * F.col("capacity")).alias("start"),
        F.least(F.col("capacity"), F.col("n_tokens") - F.col("part") * F.col("capacity")).alias("tokens"),
    )


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "row", "part"], kind="stable").reset_index(drop=True)
    rows["number"] = first_fit_decreasing(rows["tokens"].tolist(), int(rows["capacity"].iloc[0]))
    return rows


def pack(parts: DataFrame, n_items: int, group_size: int = GROUP_SIZE) -> DataFrame:
    """``parts`` with the bin of each: (container, capacity, doc_id, part, start, tokens, bin).

    A part that fills a container is a bin of its own, ``d<doc_id>-<part>``. Of each text at most one part is left, and
    those are spread over random groups by a hash of their text, for each container on its own; their bins are
    ``g<group>-<number>``. Groups are of even size whatever the data, as no key but the text's own decides.
    """
    groups = max(1, -(-n_items // group_size))
    full = parts.where("tokens = capacity").withColumn("bin", F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.col("row").cast("string"))), F.lit("-"), F.col("part").cast("string")))
    rest = parts.where("tokens < capacity").withColumn("grp", F.pmod(F.xxhash64("doc_id", "row", "container"), F.lit(groups)).cast("int"))
    schema = "container string, capacity int, doc_id bigint, row bigint, part int, start int, tokens int, grp int, number int"
    placed = rest.groupBy("container", "grp").applyInPandas(_pack, schema)
    named = placed.withColumn("bin", F.concat(F.lit("g"), F.col("grp").cast("string"), F.lit("-"), F.col("number").cast("string")))
    columns = ["container", "capacity", "doc_id", "part", "start", "tokens", "bin"]
    return full.select(*columns).unionByName(named.select(*columns))


def waste(packed: DataFrame) -> DataFrame:
    """(container, capacity, bins, parts, tokens, fill): how well each container was used."""
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("parts"))
    return bins.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("parts").alias("parts"), F.sum("used").alias("tokens"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * F.first("capacity")), 6).alias("fill"),
    )


def _packed(spark, sf_dir: str, folder: str = FOLDER) -> DataFrame:
    # Two numbers a text, written once: the texts are encoded once, whatever reads the counts.
    counts = reliable(token_counts(table(spark, sf_dir, "documents"), folder=folder).withColumn("row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())))
    return pack(pieces(counts, table(spark, sf_dir, "containers")), counts.count())


def p9_bins(spark, sf_dir: str) -> DataFrame:
    """Where each text, or part of a text, goes. Empty and null texts take no room and go into a first bin."""
    return _packed(spark, sf_dir).select("container", "bin", "doc_id", "part", "start", "tokens")


def p9_fill(spark, sf_dir: str) -> DataFrame:
    return waste(_packed(spark, sf_dir))
