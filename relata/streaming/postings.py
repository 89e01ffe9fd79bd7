"""Term counts and link counts kept up to date from pages as they arrive.

The batch operators have no streams; this is their incremental form. Each micro-batch is aggregated on its own and
written under its number, so that a batch that is run again replaces its rows. Readers take, of all batches, the
version of each page that was edited last, so a page that is delivered again or late counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relata.functions import text as T


def page_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Pages from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _version(columns: list[str]):
    return F.struct(*[F.col(c).cast("timestamp").alias(c) if c in columns else F.lit(None).cast("timestamp").alias(c) for c in ("touched", "loaded")])


def merge_term_counts(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Postings of each micro-batch of pages (id, text[, touched][, loaded]); runs until all files that are there are read.

    Of several versions of a page in a batch the last one stays. Each page has a row without a term too, so that a
    version without text takes the place of an older one.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("id is not null").select("id", "text", _version(batch.columns).alias("version"))
        w = Window.partitionBy("id").orderBy(F.desc("version"), F.desc(F.xxhash64("text")))
        current = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1")
        words = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(T.word_tokens(F.col("text")), F.array().cast("array<string>")))
        counts = current.select("id", "version", F.explode(words).alias("term")).groupBy("id", "version", "term").agg(F.count(F.lit(1)).alias("tf"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(spark: SparkSession, out: str) -> DataFrame:
    """(term, tf, df) over the last version of each page, of equal versions the one of the last batch."""
    every = spark.read.parquet(out)
    last = every.where("term is null").groupBy("id").agg(F.max(F.struct("version", "batch")).alias("last")).select("id", "last.version", "last.batch")
    kept = every.where("term is not null").join(last, ["id", "batch"], "left_semi")
    return kept.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def arrivals(pages: DataFrame, lateness: str = "2 days", window: str = "1 day") -> DataFrame:
    """(day, pages): pages that arrived in each window; rows later than ``lateness`` are left out by the watermark."""
    timed = pages.select(F.col("loaded").cast("timestamp").alias("loaded"), "id")
    counted = timed.withWatermark("loaded", lateness).groupBy(F.window("loaded", window)).agg(F.count(F.lit(1)).alias("pages"))
    return counted.select(F.col("window.start").alias("day"), "pages")
