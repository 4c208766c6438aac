"""Command line: python -m gridwright COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import edits, generate, render, score
from .plans import api
from .sources import files


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridwright")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        p = sub.add_parser(name)
        for flag, more in options:
            p.add_argument(flag, **more)

    path, out = ("path", {}), ("--output", {"required": True})
    command("extract", path, out, ("--recursive", {"action": "store_true"}), ("--format", {"choices": ["csv", "markdown", "styled"], "default": "csv"}))
    command("replay", ("csv_path", {}), ("json_path", {}), out)
    command("render", path, out, ("--recursive", {"action": "store_true"}), ("--seed", {"type": int, "default": 0}))
    command("random-edits", path, out, ("--logs", {"type": int, "default": 50}), ("--count", {"type": int, "default": 50}), ("--tables", {"type": int, "default": -1}), ("--seed", {"type": int, "default": 0}))
    command("score", ("parsed", {}), ("truth", {}), ("--metric", {"choices": ["grid", "tree"], "default": "grid"}))
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gridwright").getOrCreate()
    name = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")

    if a.command == "extract":
        filings = files.read_filings(spark, a.path, recursive=a.recursive)
        made = {"csv": lambda: api.to_csv(api.extract(filings)), "markdown": lambda: api.to_markdown(filings), "styled": lambda: api.to_styled(filings)}[a.format]()
        text = next(c for c in made.columns if c not in ("doc_id", "tid"))
        render.write_texts(made.withColumn("doc_id", name("doc_id")), a.output, text, "doc_id", "tid")
    elif a.command == "replay":
        grids = files.with_header(files.read_csv(spark, a.csv_path)).withColumnRenamed("doc_id", "path")
        log = files.read_edits(spark, a.json_path)
        found = files.resolve_files(log.where("fileName is not null"), grids.select("path"))
        # Each log replays on its own, into a folder named after it.
        steps = log.join(found, "fileName").withColumn("target", F.concat_ws("|", "log", "path"))
        targets = steps.select("log", "path", "target").distinct().join(grids, "path")
        done = edits.replay(targets, steps, "target").withColumn("folder", files.log_folder(F.col("log"))).withColumn("file", name("path"))
        whole = F.concat(F.array("header"), F.col("grid"))
        render.write_csv(done.withColumn("grid", whole).withColumn("file", F.concat(F.col("file"), F.lit("_edited"))), a.output, "folder", "file")
        done.groupBy(edits.status(F.col("applied"), F.col("skipped")).alias("status")).count().show()
    elif a.command == "render":
        grids = files.read_csv(spark, a.path, a.recursive).withColumn("doc_id", name("doc_id"))
        parts = generate.random_html(grids, a.seed)
        render.write_document(parts, a.output, "doc_id")
    elif a.command == "random-edits":
        grids = files.read_csv(spark, a.path)
        ordered = grids.orderBy("doc_id").limit(a.tables) if a.tables > 0 else grids
        dims = ordered.select(F.col("doc_id").alias("path"), name("doc_id").alias("fileName"), (F.size("grid") - 1).alias("rows"), F.size(F.col("grid")[0]).alias("cols"))
        numbered = dims.orderBy("path").rdd.zipWithIndex().map(lambda x: (x[1] + 1, *x[0][1:])).toDF("tableIndex long, fileName string, rows int, cols int")
        made = generate.random_logs(spark, numbered, a.logs, a.count, a.seed)
        render.write_texts(render.edits_json(made, "log"), a.output, "body", "log")
    elif a.metric == "grid":
        left, right = (files.read_csv(spark, p).withColumn("name", name("doc_id")) for p in (a.parsed, a.truth))
        score.compare_files(left, right).show(truncate=False)
    else:
        left, right = (files.read_filings(spark, p).withColumn("name", name("doc_id")) for p in (a.parsed, a.truth))
        both = left.select("name", F.col("html").alias("html1")).join(right.select("name", F.col("html").alias("html2")), "name")
        score.teds(both).select("name", "teds").show(truncate=False)


if __name__ == "__main__":
    main()
