"""Command line: one sub-command for each step of the pipeline."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from relata import timing
from relata.config import Config
from relata.engine import Engine
from relata.functions import maths as M
from relata.functions import text as T
from relata.functions.query import parse
from relata.operators import corpus, ensemble, evaluate, indexes, links, matrix
from relata.session import build_session, reliable
from relata.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="relata", description="Relatedness of pages and phrases")
    p.add_argument("-c", "--configuration", help="JSON configuration")
    p.add_argument("-e", "--threads", default="*", help="threads of a local session")
    p.add_argument("-g", "--most-similar-gold", help="file of judged phrase pairs for lists")
    p.add_argument("-y", "--similarity-gold", help="file of judged phrase pairs")
    p.add_argument("-t", "--titles", action="store_true", help="phrases are titles of pages")
    p.add_argument("-m", "--models", help="folder that keeps what is dear to compute")
    p.add_argument("-r", "--results", type=int, help="results a query")
    p.add_argument("-v", "--valid-ids", help="file of ids that may be results")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> None:
        s = sub.add_parser(name)
        for a in arguments:
            s.add_argument(a)

    command("index", "dump", "out")
    command("query", "tables", "query")
    command("make-sims", "tables", "measure", "out")
    command("pairwise", "matrix", "out")
    command("transpose", "matrix", "out")
    command("svd", "matrix", "out")
    command("train", "tables", "measure", "out")
    command("analyze", "tables", "measure")
    command("fit", "tables", "measures")
    command("console", "tables", "measure", "phrases")
    command("phrases", "tables", "measure", "file", "out")
    command("valid-ids", "tables", "out")
    command("gold", "file", "out")
    command("topics", "matrix", "out")
    command("summarize", "matrix")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session(a.threads, app=f"relata {a.command}")
    config = Config.read(a.configuration) if a.configuration else None
    files = {k: v for k, v in (("similarity", a.similarity_gold), ("mostSimilar", a.most_similar_gold)) if v}
    engine = Engine(spark, a.tables, config, a.results, files, a.titles, a.models) if hasattr(a, "tables") else None
    valid = readers.read_ids(spark, a.valid_ids) if a.valid_ids else None
    if a.command == "index":
        pages = readers.read_dump(spark, a.dump).withColumns({"touched": F.lit(None).cast("timestamp"), "loaded": F.lit(None).cast("timestamp")})
        found = pages.select(F.col("id").alias("src_id"), F.explode(T.anchor_targets(F.col("text"))).alias("target_title"))
        shown = pages.select(F.col("id").alias("src_id"), F.posexplode(T.anchor_texts(F.col("text"))).alias("pos", "anchor"), T.anchor_targets(F.col("text")).alias("targets"))
        linked = shown.select("src_id", F.get("targets", F.col("pos")).alias("target_title"), "anchor")
        sections = config.data.get("indexes", {}) if config else {"main": {"skipLists": True, "skipDabs": True, "fields": ["id", "ns", "title", "text"]}}
        for name, settings in sections.items():
            with timing.phase(f"index {name}"):
                writers.write_index(indexes.documents(pages, found, settings), a.out, name)
                if "text" in settings.get("fields", ["text"]):
                    writers.write_index(indexes.index_postings(pages, linked, settings), a.out, f"{name}-postings")
    elif a.command == "query":
        pages = corpus.with_type(engine.pages()).join(links.inlink_counts(engine.edges()), "id", "left").na.fill(0, ["ninlinks"])
        pages.where(parse(a.query)).select("id", "ninlinks", "title").show(engine.results, truncate=False)
    elif a.command == "make-sims":
        writers.write_sparse(engine.measure(a.measure).all_lists(engine.pages().where("redirect is null").select("id"), engine.results, valid), a.out)
    elif a.command == "pairwise":
        m = readers.read_sparse(spark, a.matrix)
        found = matrix.top_k(matrix.row_cosines(m, m), a.results or 20)
        writers.write_sparse(found.select(F.col("query_id").alias("row_id"), F.col("id").alias("col_id"), F.col("score").alias("value")), a.out)
    elif a.command == "transpose":
        writers.write_sparse(matrix.transpose(readers.read_sparse(spark, a.matrix)), a.out)
    elif a.command == "svd":
        from pyspark.ml.recommendation import ALS

        model = ALS(rank=20, userCol="row_id", itemCol="col_id", ratingCol="value", seed=7).fit(readers.read_sparse(spark, a.matrix))
        model.userFactors.write.mode("overwrite").parquet(f"{a.out}/rows")
        model.itemFactors.write.mode("overwrite").parquet(f"{a.out}/columns")
    elif a.command == "topics":
        rows, columns = ensemble.matrix_topics(readers.read_sparse(spark, a.matrix))
        rows.write.mode("overwrite").parquet(f"{a.out}/rows")
        columns.write.mode("overwrite").parquet(f"{a.out}/columns")
    elif a.command == "train":
        m = engine.measure(a.measure)
        if not hasattr(m, "train"):
            raise SystemExit(f"{a.measure} can't be trained")
        m.train(engine.gold()).save(a.out)
    elif a.command == "analyze":
        gold = engine.gold().groupBy("id1", "id2").agg(F.avg("y").alias("y"))
        scored = engine.measure(a.measure).similarity(gold).join(gold, ["id1", "id2"])
        evaluate.correlations(scored.select(F.lit(a.measure).alias("metric"), F.col("score").alias("x"), "y")).show(truncate=False)
    elif a.command == "fit":
        names = a.measures.split(",")
        wide = gold = reliable(engine.gold().groupBy("id1", "id2").agg(F.avg("y").alias("y")))
        for n in names:
            wide = wide.join(engine.measure(n).similarity(gold).select("id1", "id2", F.when(M.finite(F.col("score")), F.col("score")).alias(n)), ["id1", "id2"], "left")
        covered = reliable(wide.dropna())
        b0, b = ensemble.fit_from_moments(covered, names, "y")
        print(ensemble.write_equation(b0, dict(zip(names, map(float, b)))))
        evaluate.joint_fit(covered, names, "y", b0, dict(zip(names, map(float, b)))).show(truncate=False)
    elif a.command == "console":
        parts = [x.strip() for x in a.phrases.split(",")]
        if len(parts) == 1:
            engine.phrase_most_similar(spark.createDataFrame([(parts[0],)], "phrase string"), a.measure).show(engine.results, truncate=False)
        else:
            engine.phrase_similarity(spark.createDataFrame([tuple(parts[:2])], "a string, b string"), a.measure).show(truncate=False)
    elif a.command == "phrases":
        asked = readers.read_phrases(spark, a.file)
        phrases = reliable(asked.select("phrase").distinct())
        mapped = reliable(engine.map_phrases(phrases, 1))
        numbered = matrix.dense_ids(phrases, "phrase").withColumnRenamed("dense_id", "phrase_id")
        writers.write_table(asked.join(numbered, "phrase").join(mapped, "phrase", "left"), f"{a.out}/mapping")
        lists = engine.phrase_most_similar(phrases, a.measure).join(numbered, "phrase")
        writers.write_sparse(lists.select(F.col("phrase_id").alias("row_id"), F.col("id").alias("col_id"), F.col("score").alias("value")), f"{a.out}/lists")
        pairs = reliable(engine.phrase_matrix(phrases, a.measure))
        cells = pairs.join(numbered.select(F.col("phrase").alias("a"), F.col("phrase_id").alias("row_id")), "a").join(numbered.select(F.col("phrase").alias("b"), F.col("phrase_id").alias("col_id")), "b")
        writers.write_sparse(cells.where("score is not null").select("row_id", "col_id", F.col("score").alias("value")), f"{a.out}/similarities")
        writers.write_table(pairs, f"{a.out}/pairs")
    elif a.command == "valid-ids":
        writers.write_table(corpus.q_valid_titles(spark, a.tables), a.out)
    elif a.command == "gold":
        gold = readers.read_gold(spark, a.file).withColumn("source", F.lit(a.file))
        writers.write_table(evaluate.stratified(evaluate.combined_gold(gold)), a.out)
    elif a.command == "summarize":
        writers.matrix_summary(readers.read_sparse(spark, a.matrix)).show(200)
    for name, calls, seconds in timing.phase.report():
        print(f"{name}: {calls} times, {seconds:.1f} s")
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
