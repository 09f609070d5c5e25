"""Evaluation: answers, supporting facts, hits, status and averages, as records and as summary rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hopweave.functions.answers import answer_scores, asks_judge, harmonic, hits, joint_scores, judged, set_scores, status
from hopweave.models import Judge

METRICS = ("em", "f1", "prec", "recall")


def official(gold: DataFrame, answers: DataFrame, support: DataFrame) -> DataFrame:
    """(sample_id, answer, sp, joint) of the gold rows that have an answer; sp and joint are null without predicted facts.

    gold: (sample_id, answer, supporting_facts); answers: (sample_id, prediction); support: (sample_id, sp).
    """
    rows = gold.join(answers, "sample_id").join(support, "sample_id", "left")
    rows = rows.select("sample_id", answer_scores(F.col("prediction"), F.col("answer")).alias("answer"), F.when(F.col("sp").isNotNull(), set_scores(F.col("sp"), F.col("supporting_facts"))).alias("sp"))
    return rows.withColumn("joint", F.when(F.col("sp").isNotNull(), joint_scores(F.col("answer"), F.col("sp"))))


def means(scored: DataFrame) -> DataFrame:
    """One row of twelve means over all rows; what a row lacks counts as 0."""
    out = [F.coalesce(F.sum(F.coalesce(F.col(f"{part}.{m}"), F.lit(0.0))) / F.count("*"), F.lit(0.0)).alias(m if part == "answer" else f"{part}_{m}") for part in ("answer", "sp", "joint") for m in METRICS]
    return scored.agg(*out)


def records(results: DataFrame, gold: DataFrame, judge: Judge | None = None, method: str = "hopweave", legacy: bool = False) -> DataFrame:
    """A record for each gold row (sample_id, question, answer, supporting_facts), its result joined by qid = sample_id.

    results: (qid, prediction, nodes, best_path_titles, duration). Rows without a result failed: no prediction, zeros.
    """
    rows = gold.join(results.withColumnRenamed("qid", "sample_id").drop("question"), "sample_id", "left")
    titles = F.array_distinct(F.filter(F.transform(F.coalesce("nodes", F.array().cast(results.schema["nodes"].dataType)), lambda n: n["doc_title"]), lambda t: t != ""))
    wanted = F.array_sort(F.array_distinct(F.transform("supporting_facts", lambda f: f["title"])))
    rows = rows.withColumn("found_", titles).withColumn("wanted_", F.coalesce(wanted, F.array().cast("array<string>")))
    rows = rows.withColumn("score_", answer_scores(F.col("prediction"), F.col("answer"))).withColumn("ground_truth", F.col("answer"))
    failed = F.col("prediction").isNull()
    if judge is None:
        rows = rows.withColumn("semantic_", F.lit("N/A"))
    else:
        asked = F.coalesce(asks_judge(F.col("prediction"), F.col("score_.f1"), legacy), F.lit(False))
        told = judge.judge(rows.where(asked), "verdict_").withColumn("semantic_", judged(F.col("verdict_"))).drop("verdict_")
        rows = told.unionByName(rows.where(~asked).withColumn("semantic_", F.lit("N/A")))
    rows = rows.withColumn("hits_", hits(F.col("wanted_"), F.col("found_"), F.coalesce("best_path_titles", F.array().cast("array<string>"))))
    zero = lambda m: F.when(failed, 0.0).otherwise(F.col(f"score_.{m}"))
    return rows.select(
        F.col("sample_id").alias("id"), F.col("question").alias("query"), "prediction", "ground_truth",
        F.struct(zero("f1").alias("f1"), zero("prec").alias("precision"), zero("recall").alias("recall"), F.col("semantic_").alias("semantic")).alias("metrics"), "duration",
        F.struct(F.col("wanted_").alias("support_titles"), F.size("found_").alias("retrieved_title_count"), F.col("hits_.hit_titles"), F.col("hits_.retrieval_hit"), F.col("hits_.bridge_hit"), F.col("hits_.path_hit")).alias("retrieval"),
        F.when(failed, "Failed").otherwise(status(F.col("prediction"), F.col("score_.f1"), F.col("semantic_"), legacy)).alias("status"), F.lit(method).alias("method"),
    )


def averages(recorded: DataFrame) -> DataFrame:
    """One row: count, mean scores and hit rates; failed samples count in the denominator only."""
    rate = lambda c: (F.count_if(F.col(f"retrieval.{c}")) / F.count("*")).alias(c)
    mean = lambda c: (F.sum(f"metrics.{c}") / F.count("*")).alias(c)
    return recorded.agg(F.count("*").alias("count"), mean("f1"), mean("precision"), mean("recall"), rate("retrieval_hit"), rate("bridge_hit"), rate("path_hit"))


def token_overlap(pairs: DataFrame, key: str, tokens_a: str, tokens_b: str) -> DataFrame:
    """(key, same, n_a, n_b, f1) for long texts: tokens counted by two aggregations rather than inside a row."""
    side = lambda c, a, b: pairs.select(key, F.explode(c).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    counted = side(tokens_a, 1, 0).unionByName(side(tokens_b, 0, 1)).groupBy(key, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = counted.groupBy(key).agg(F.sum(F.least("a", "b")).alias("same"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    p, r = F.try_divide("same", "n_a"), F.try_divide("same", "n_b")
    return out.withColumn("f1", F.coalesce(harmonic(p, r), F.lit(0.0)))
