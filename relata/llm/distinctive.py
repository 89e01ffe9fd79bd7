"""How distinctive a term is for a record: probabilistic relevance weights (problem 6)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.llm.markup import current_first, visible
from relata.session import reliable, table

#: Saturation of the term frequency and strength of the length normalisation; the usual values of the published model.
K1, B = 1.2, 0.75

#: Ids that are broadcast at most; with more of them the joins are shuffled.
BROADCAST_IDS = 1_000_000

LETTERS = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """Runs of letters of the visible text in lower case, with their counts."""
    return Counter(LETTERS.findall(visible(text, formulas=False).lower()))


_COUNTED = "id int, docs bigint, len bigint, words array<string>, tfs array<int>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch one row (NULL, records, their length, terms, document frequencies), and for each record asked for a
    row (id, 1, length, terms, term frequencies)."""
    for batch in batches:
        df: Counter = Counter()
        total, rows = 0, []
        for i, text, asked in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
            tf = terms(text)
            n = sum(tf.values())
            df.update(tf.keys())
            total += n
            if asked:
                rows.append((i, 1, n, tf))
        rows.append((None, batch.num_rows, total, df))
        ends = pa.array([0, *accumulate(len(r[3]) for r in rows)], pa.int32())
        words = pa.array([w for r in rows for w in r[3]], pa.string())
        counts = pa.array([c for r in rows for c in r[3].values()], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, counts),
            ],
            names=["id", "docs", "len", "words", "tfs"],
        )


def current_texts(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, *keep) of each page's current row, null texts left out.

    Only ids that have several rows need a choice, which a look at the ids alone finds. Their texts are shuffled, all
    others stay where they are read. If such ids are more than may be broadcast, all texts go through the choice, with
    the same result.
    """
    rows = pages.where("id is not null").select(
        "id", F.col("touched").cast("timestamp").alias("touched"), F.col("loaded").cast("timestamp").alias("loaded"), "redirect", "text",
        *[c for c in keep if c != "redirect"],
    )
    several = reliable(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    w = Window.partitionBy("id").orderBy(*current_first())

    def chosen(some: DataFrame) -> DataFrame:
        tied = some.withColumn("tie", F.xxhash64("text", "redirect"))
        return tied.withColumn("rn", F.row_number().over(w)).where("rn = 1 and text is not null").select("id", "text", *keep)

    if several.count() > BROADCAST_IDS:
        return chosen(rows)
    few = F.broadcast(several)
    alone = rows.join(few, "id", "left_anti").where("text is not null").select("id", "text", *keep)
    return alone.unionByName(chosen(rows.join(few, "id", "left_semi")))


def counted_terms(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The counts of all records of texts (id, text) and of those asked for (id), written once: every text is read and
    parsed once, and what leaves a task is one summary a batch and the asked records' own counts."""
    ids = asked.select("id").where("id is not null").distinct().withColumn("asked", F.lit(True))
    marked = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left")
    return reliable(marked.select("id", "text", F.coalesce("asked", F.lit(False)).alias("asked")).mapInArrow(_counted, _COUNTED))


def distinctive_terms(texts: DataFrame, asked: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(id, term, tf, df, score) for each term of the records with an id of ``asked`` (id), held against the whole
    collection ``texts`` (id, text), one row a record.

    score = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg)). Texts without letters
    count as records of length 0 and have no terms.
    """
    counted = counted_terms(texts, asked)
    own = counted.where("id is not null").select("id", "len", F.explode(F.arrays_zip("words", "tfs")).alias("t")).select(
        "id", "len", F.col("t.words").alias("term"), F.col("t.tfs").alias("tf")
    )
    summaries = counted.where("id is null")
    whole = summaries.agg(F.sum("docs").alias("n"), F.sum("len").alias("total")).first()
    n, average = whole["n"] or 0, (whole["total"] or 0) / whole["n"] if whole["n"] else 0.0
    each = summaries.select(F.explode(F.arrays_zip("words", "tfs")).alias("t"))
    stats = each.groupBy(F.col("t.words").alias("term")).agg(F.sum("t.tfs").alias("df"))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.lit(average or 1.0))
    return own.join(stats, "term").select("id", "term", "tf", "df", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("score"))


def most_distinctive(scored: DataFrame, n: int) -> DataFrame:
    """The n terms of each record with the highest score, ties by the alphabetically first."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def p6_found(spark, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "term_probes").select(F.col("page_id").alias("id"))
    best = most_distinctive(distinctive_terms(current_texts(table(spark, sf_dir, "pages")), probes), 2)
    return best.select(F.col("id").alias("page_id"), "term")
