"""Command line: build a graph, ask it, evaluate it, score predictions, compare logs."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession, functions as F

from hopweave.config import Config
from hopweave.plans import evaluation
from hopweave.plans.engine import Engine
from hopweave.sources import documents, logs


def session() -> SparkSession:
    return SparkSession.builder.appName("hopweave").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def logged(a: argparse.Namespace) -> logging.Logger:
    """The run's logger: console and a file in --log, where that is given."""
    return logs.experiment_log(a.log) if a.log else logging.getLogger("hopweave")


def build(a: argparse.Namespace, spark: SparkSession) -> None:
    engine = Engine(spark)
    if a.extend:
        engine.load(a.graph)
    if a.samples:
        engine.build_from_samples(documents.samples(spark, a.input)).write.mode("overwrite").parquet(f"{a.graph}_filter")
    else:
        engine.build(documents.documents(spark, a.input))
    # an extended graph reads the old files, so it can't replace them in place
    target = f"{a.graph}_new" if a.extend else a.graph
    engine.save(target)
    logged(a).info("saved to %s", target)
    print(f"saved to {target}")
    engine.graph.counts().show()


def query(a: argparse.Namespace, spark: SparkSession) -> None:
    engine = Engine(spark, online=True).load(a.graph)
    lines = [a.question] if a.question else (line.strip() for line in sys.stdin)
    for line in filter(None, lines):
        engine.query(spark.createDataFrame([(0, line)], "qid long, question string"), beam_width=a.beam, max_steps=a.steps).select("prediction", "best_path").show(truncate=False)


def evaluate(a: argparse.Namespace, spark: SparkSession) -> None:
    engine = Engine(spark, online=True).load(a.graph)
    samples = documents.samples(spark, a.input)
    samples = samples.orderBy("sample_pos").limit(a.limit) if a.limit else samples
    filters = spark.read.parquet(f"{a.graph}_filter") if a.filtered else None
    documents.write_results(engine.evaluate(samples, filters), a.output)
    means = evaluation.averages(spark.read.json(a.output))
    logged(a).info("means: %s", means.first().asDict())
    means.show()


def official(a: argparse.Namespace, spark: SparkSession) -> None:
    answers, support = documents.predictions(spark, a.predictions)
    evaluation.means(evaluation.official(documents.samples(spark, a.gold), answers, support)).show(vertical=True)


def compare(a: argparse.Namespace, spark: SparkSession) -> None:
    both = None
    for run, path in (("new", a.new), ("old", a.old)):
        one = logs.stats(logs.parse(logs.read_log(spark, path).withColumn("run", F.lit(run)), a.limit))
        both = one if both is None else both.unionByName(one)
    logs.compare(both, "new", "old").show(truncate=False)


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="hopweave", description=__doc__)
    subs = top.add_subparsers(required=True)
    p = subs.add_parser("build")
    p.add_argument("--input", required=True)
    p.add_argument("--graph", required=True)
    p.add_argument("--samples", action="store_true", help="the input holds question samples, not documents")
    p.add_argument("--extend", action="store_true", help="go on from the saved graph, leaving out titles that it has")
    p.set_defaults(run=build)
    p = subs.add_parser("query")
    p.add_argument("--graph", required=True)
    p.add_argument("--question", help="without it questions are read line by line")
    p.add_argument("--beam", type=int, default=3)
    p.add_argument("--steps", type=int, default=Config().max_steps)
    p.set_defaults(run=query)
    p = subs.add_parser("evaluate")
    p.add_argument("--graph", required=True)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--filtered", action="store_true", help="each question only uses its own contexts")
    p.add_argument("--limit", type=int)
    p.set_defaults(run=evaluate)
    p = subs.add_parser("metrics")
    p.add_argument("predictions")
    p.add_argument("gold")
    p.set_defaults(run=official)
    p = subs.add_parser("compare")
    p.add_argument("new")
    p.add_argument("old")
    p.add_argument("--limit", type=int, default=2000)
    p.set_defaults(run=compare)
    for p in subs.choices.values():
        p.add_argument("--log", help="a folder for a log file of the run")
    a = top.parse_args(args)
    a.run(a, session())


if __name__ == "__main__":
    main()
