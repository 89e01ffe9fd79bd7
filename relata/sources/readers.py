"""Readers: page dumps, judged pairs, id and phrase lists, dictionaries, matrices, indexes and topic tables.

Readers of line formats come in two parts: one opens files, one turns a DataFrame of lines (value) into rows, so that
lines from anywhere can be parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Fixed value: texts end after so many characters.
TEXT_LIMIT = 500_000

_DUMP = StructType(
    [
        StructField("title", StringType()), StructField("ns", IntegerType()), StructField("id", IntegerType()),
        StructField("redirect", StructType([StructField("_title", StringType())])),
        StructField("revision", StructType([StructField("text", StringType())])),
    ]
)


def read_dump(spark: SparkSession, path: str, skip_broken: bool = True, text_limit: int = TEXT_LIMIT) -> DataFrame:
    """(id, ns, title, redirect, text) of the pages of a dump; many files may match the path.

    The codec (bzip2, gzip or none) follows from each name. Files are split over tasks. Broken records and files are
    skipped unless ``skip_broken`` is False. Texts are cut at exactly ``text_limit`` characters.
    """
    mode = "DROPMALFORMED" if skip_broken else "FAILFAST"
    rows = spark.read.format("xml").option("rowTag", "page").option("mode", mode).option("ignoreCorruptFiles", str(skip_broken).lower()).schema(_DUMP).load(path)
    return rows.select("id", "ns", "title", F.col("redirect._title").alias("redirect"), F.substring("revision.text", 1, text_limit).alias("text"))


def parse_gold(lines: DataFrame, separator: str = "\t") -> DataFrame:
    """(phrase1, phrase2, similarity) of lines with exactly three fields and a number as the last; others are skipped."""
    parts = F.split(F.trim("value"), "\t" if separator == "\t" else ",", -1)
    cut = lines.select(parts.alias("p")).where(F.size("p") == 3)
    rows = cut.select(F.trim(F.col("p")[0]).alias("phrase1"), F.trim(F.col("p")[1]).alias("phrase2"), F.col("p")[2].try_cast("double").alias("similarity"))
    return rows.where("similarity is not null")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return parse_gold(spark.read.text(path), "," if path.endswith("csv") else "\t")


def parse_ids(lines: DataFrame) -> DataFrame:
    """(id): the different integers, one a line; other lines are skipped."""
    return lines.select(F.trim("value").try_cast("int").alias("id")).where("id is not null").distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return parse_ids(spark.read.text(path))


_ENTRY = r"^([^\t]*)\t(\S+) (\S*)(?: (.*))?$"


def parse_dictionary(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(text, normal, fraction, article, flags, num, den) of lines ``text TAB fraction SPACE article [SPACE flags]``.

    A line of another form raises an error, or is left out unless ``strict``. num and den come from the flag
    ``W:num/den``; without it num is 0 and den is NULL.
    """
    from relata.functions import text as T

    fits = F.col("value").rlike(_ENTRY)
    checked = lines.select(F.when(fits, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no dictionary line: "), "value"))).alias("value")) if strict else lines.where(fits)
    part = lambda i: F.regexp_extract("value", _ENTRY, i)
    rows = checked.select(part(1).alias("text"), part(2).try_cast("float").alias("fraction"), part(3).alias("article"), part(4).alias("flags"))
    num, den = T.link_fraction(F.col("flags"))
    return rows.select(
        "text", T.normalize_phrase(F.col("text")).alias("normal"), "fraction", "article",
        F.filter(F.split("flags", " "), lambda x: x != "").alias("flags"), F.coalesce(num, F.lit(0)).alias("num"), den.alias("den"),
    )


def read_dictionary(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_dictionary(spark.read.text(path), strict)


def parse_phrases(lines: DataFrame) -> DataFrame:
    """(client_id, phrase) of lines ``client_id TAB phrase``; the phrase may hold tabs. Other lines are skipped."""
    parts = F.split("value", "\t", 2)
    return lines.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("client_id"), F.trim(parts[1]).alias("phrase"))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    return parse_phrases(spark.read.text(path))


def open_index(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, col_id, value); a filter on row_id reaches the scan, and row groups are sorted by it."""
    return spark.read.parquet(path)


def read_dense(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """((row_id, v), column ids): all rows share one list of columns."""
    columns = spark.read.parquet(f"{path}/columns").first()["col_ids"]
    return spark.read.parquet(f"{path}/rows"), list(columns)


def parse_topic_ids(lines: DataFrame) -> DataFrame:
    """(kind, dense_id, id) of lines of three tab-separated fields."""
    p = F.split("value", "\t")
    return lines.where(F.size(p) == 3).select(p[0].alias("kind"), p[1].try_cast("int").alias("dense_id"), p[2].try_cast("int").alias("id")).where("dense_id is not null and id is not null")


def parse_topic_weights(lines: DataFrame) -> DataFrame:
    """(dense_id, w): weights of lines of numbers led by an id; each row is divided by its sum unless that is 0."""
    numbers = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    rows = lines.select(numbers.alias("n")).where((F.size("n") > 1) & ~F.exists("n", lambda x: x.isNull()))
    weights = F.slice("n", F.lit(2), F.size("n") - 1)
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return rows.select(F.col("n")[0].cast("int").alias("dense_id"), F.when(total != 0, F.transform(weights, lambda x: x / total)).otherwise(weights).alias("w"))


def parse_topics(lines: DataFrame) -> DataFrame:
    """(dense_id, w) of a topic model's file: after the line that begins with ``lda``, an id and its weight for each topic."""
    return parse_topic_weights(lines.where(~F.trim("value").startswith("lda")))


def parse_predictions(lines: DataFrame) -> DataFrame:
    """(place, w) of predictions, one line for each document in order: its weights, divided by their sum. ``lines`` holds
    (place, value), as a file's lines have no order of their own."""
    rows = lines.select("place", F.concat_ws(" ", F.col("place").cast("string"), "value").alias("value"))
    return parse_topic_weights(rows).select(F.col("dense_id").alias("place"), "w")


def stop_words(language: str = "english", path: str | None = None) -> list[str]:
    """The words of a file, one a line, or Spark's own list of the language."""
    if path:
        with open(path, encoding="utf-8") as f:
            return sorted({line.strip() for line in f if line.strip()})
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)
