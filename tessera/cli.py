"""Command line: conversion of summaries and evaluation.

    python -m tessera.cli to-spl IN OUT
    python -m tessera.cli to-text IN OUT
    python -m tessera.cli evaluate SYSTEMS MODELS --system-pattern 'S\\.(\\d+)\\.txt' --model-pattern 'M\\.[A-D]\\.#ID#\\.txt'
    python -m tessera.cli report FOLDER MODELS --system-pattern ... --model-pattern ...
    python -m tessera.cli config SYSTEMS MODELS OUT --system-pattern ... --model-pattern ...
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import rouge
from .sources import texts
from .sources.blocks import read_files


def _pairs(spark: SparkSession, args) -> DataFrame:
    text = texts.from_spl_html(F.col("content")) if args.spl else F.col("content")
    side = lambda path: read_files(spark, path).select("file", text.alias("text"))
    return rouge.pair_up(side(args.systems), side(args.models), args.system_pattern, args.model_pattern)


def evaluate(spark: SparkSession, args) -> list[tuple]:
    pairs = _pairs(spark, args).select("id", F.col("model_file").alias("model_id"), "system", "model").persist()
    options = rouge.PROJECT if args.project else rouge.DEFAULT
    rows = []
    for metric, scores in rouge.evaluate(pairs, options):
        r = scores.agg(F.avg("recall"), F.avg("precision"), F.avg("f_score")).first()
        rows.append((metric, *[round(100 * (x or 0.0), 3) for x in r]))
    pairs.unpersist()
    return rows


def report(spark: SparkSession, args) -> list[tuple]:
    """ROUGE-1 of every folder below ``systems``: a system each, all scored in one pass."""
    text = texts.from_spl_html(F.col("content")) if args.spl else F.col("content")
    found = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(args.systems)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    found = found.select(folder.alias("system_id"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    side = found.select("system_id", "name", text.alias("text")).withColumn("file", F.col("name"))
    models = read_files(spark, args.models).select("file", text.alias("text"))
    pairs = rouge.pair_up(side, models, args.system_pattern, args.model_pattern, keep=("system_id",))
    pairs = pairs.select(F.struct("system_id", "id").alias("id"), F.col("model_file").alias("model_id"), "system", "model")
    options = rouge.PROJECT if args.project else rouge.DEFAULT
    _, scores = next(rouge.evaluate(pairs, options))
    rows = rouge.by_system(scores.select(F.col("id.system_id").alias("system_id"), "recall", "precision", "f_score")).orderBy("system_id").collect()
    return [(r["system_id"], r["precision"], r["recall"], r["f_score"]) for r in rows]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("to-spl", "to-text"):
        c = commands.add_parser(name)
        c.add_argument("source")
        c.add_argument("target")
    for name in ("evaluate", "config", "report"):
        c = commands.add_parser(name)
        c.add_argument("systems")
        c.add_argument("models")
        if name == "config":
            c.add_argument("target")
        c.add_argument("--system-pattern", required=True)
        c.add_argument("--model-pattern", required=True)
        c.add_argument("--spl", action="store_true", help="files are pages of anchors")
        c.add_argument("--project", action="store_true", help="the preset with 100 words and gaps of 4")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "to-spl":
        texts.map_folder(spark, args.source, args.target, texts.to_spl_html)
    elif args.command == "to-text":
        texts.map_folder(spark, args.source, args.target, texts.from_spl_html)
    elif args.command == "evaluate":
        for row in evaluate(spark, args):
            print("%-12s R %.3f P %.3f F %.3f" % row)
    elif args.command == "report":
        for row in report(spark, args):
            print("%s\n[prec]: %.1f%% [rec]: %.1f%% [fscore]: %.1f%%" % row)
    else:
        pairs = _pairs(spark, args).select(F.col("id").alias("doc_id"), F.col("system_file").alias("system"), F.col("model_file").alias("model"))
        texts.write_lines(texts.rouge_config(pairs, args.models, args.systems), args.target)


if __name__ == "__main__":
    main()
