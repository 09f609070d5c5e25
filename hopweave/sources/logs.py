"""Evaluation logs: read, taken apart, summed up and compared."""

from __future__ import annotations

import logging
import os
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Fixed formats of the log lines.
PREDICTION_LINE = "🤖 预测: (.*)"
METRIC_LINE = r"📊 指标: F1=([0-9.]+) \| P=([0-9.]+) \| R=([0-9.]+) \| (.*?) \(耗时: ([0-9.]+)s\)"
FILTER_LINE = r"📋 doc_filter: (\d+) 个文档"
IDK_MARKS = ("idk", "⚪")


def experiment_log(folder: str, name: str = "hopweave") -> logging.Logger:
    """A logger of the driver that writes to the console and to a file of its own, named by the time."""
    os.makedirs(folder, exist_ok=True)
    logger = logging.getLogger(f"{name}.{time.time_ns()}")
    logger.setLevel(logging.INFO)
    logger.propagate = False
    form = logging.Formatter("%(asctime)s | %(message)s", "%H:%M:%S")
    for handler in (logging.StreamHandler(), logging.FileHandler(f"{folder}/{name}_{time.strftime('%Y%m%d_%H%M%S')}.log", encoding="utf-8")):
        handler.setFormatter(form)
        logger.addHandler(handler)
    return logger


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(run, line, value): the lines of the logs at `path` in order, a file for a run; files are split between tasks."""
    # a file's splits are read in any order, so a line's place is its split's place and then its own
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("run"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"), "value")


def parse(lines: DataFrame, limit: int = 2000) -> DataFrame:
    """(run, n, prediction, f1, prec, recall, status, seconds): the first `limit` metric lines, each with the prediction of its place."""
    part = lambda i: F.regexp_extract("value", METRIC_LINE, i)
    place = F.row_number().over(W.partitionBy("run").orderBy("line"))
    metric = lines.where(F.col("value").rlike(METRIC_LINE)).withColumn("n", place).where(F.col("n") <= limit)
    metric = metric.select("run", "n", *(part(i).cast("double").alias(c) for i, c in ((1, "f1"), (2, "prec"), (3, "recall"))), part(4).alias("status"), part(5).cast("double").alias("seconds"))
    said = lines.where(F.col("value").rlike(PREDICTION_LINE)).withColumn("n", place).where(F.col("n") <= limit)
    said = said.select("run", "n", F.trim(F.regexp_extract("value", PREDICTION_LINE, 1)).alias("prediction"))
    return metric.join(said, ["run", "n"], "left")


def idk(prediction: Column, status: Column) -> Column:
    marked = [F.contains(F.lower(status), F.lit(m)) for m in IDK_MARKS]
    return F.coalesce(F.contains(F.lower(prediction), F.lit("i don't know")), F.lit(False)) | marked[0] | marked[1]


def stats(parsed: DataFrame) -> DataFrame:
    """(run, total, idk, miss, low_f1, perfect, mean_latency, mean_f1)."""
    gave_up = idk(F.col("prediction"), F.col("status"))
    f1 = F.col("f1")
    return parsed.groupBy("run").agg(
        F.count("*").alias("total"), F.count_if(gave_up).alias("idk"), F.count_if(~gave_up & (f1 == 0)).alias("miss"),
        F.count_if(~gave_up & (f1 > 0) & (f1 != 1)).alias("low_f1"), F.count_if(~gave_up & (f1 == 1)).alias("perfect"), F.avg("seconds").alias("mean_latency"), F.avg("f1").alias("mean_f1"),
    )


def filter_lines(lines: DataFrame) -> DataFrame:
    """(run, filters): how many questions had a filter."""
    return lines.where(F.col("value").rlike(FILTER_LINE)).groupBy("run").agg(F.count("*").alias("filters"))


def compare(summed: DataFrame, new: str, old: str) -> DataFrame:
    """(metric, new, old, diff) of two runs of `stats`; rates are percentages of each run's total."""
    rate = lambda c: (F.col(c) * 100.0 / F.col("total")).alias(c)
    wide = summed.where(F.col("run").isin(new, old)).select("run", F.col("total").cast("double").alias("total"), rate("idk"), rate("miss"), rate("perfect"), "mean_latency", "mean_f1")
    long = wide.unpivot("run", [c for c in wide.columns if c != "run"], "metric", "value")
    side = lambda r: F.max(F.when(F.col("run") == r, F.col("value")))
    return long.groupBy("metric").agg(side(new).alias("new"), side(old).alias("old")).withColumn("diff", F.col("new") - F.col("old"))
