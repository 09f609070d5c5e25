"""Evaluation jobs and log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.functions import answers
from hopweave.functions.text import capital_tokens
from hopweave.plans import evaluation
from hopweave.sources import logs

from .fixtures import CAPITAL, PAIRS, SCORES, answer_tokens, pairs, table


def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, a, b, c): the capitalized words of a conversation's turns, dealt by the turn's number into three sets."""
    rows = table(spark, sf_dir, "conversations")
    one = rows.select("conv_id", (F.col("turn") % 3).alias("part"), F.explode_outer(capital_tokens(F.col("text"))).alias("w"))
    words = lambda k: F.collect_set(F.when(F.col("part") == k, F.col("w")))
    return one.groupBy("conv_id").agg(words(0).alias("a"), words(1).alias("b"), words(2).alias("c"))


def retrieval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = answers.hits(F.col("a"), F.col("b"), F.col("c"))
    return word_sets(spark, sf_dir).select("conv_id", h.alias("h")).select("conv_id", F.array_join("h.hit_titles", ",").alias("hit_titles"), "h.retrieval_hit", "h.bridge_hit", "h.path_hit")


def sp_joint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve means: each turn is an answer whose gold is the next turn; supporting facts are the conversation's words.

    Every fifth conversation has no answer and every seventh no supporting facts.
    """
    facts = lambda c: F.transform(c, lambda w: F.struct(w.alias("title"), F.length(w).alias("sent_id")))
    rows = pairs(spark, sf_dir).join(word_sets(spark, sf_dir), "conv_id").withColumn("sample_id", F.concat_ws("-", "conv_id", "turn"))
    gold = rows.select("sample_id", F.col("gold").alias("answer"), facts("b").alias("supporting_facts"))
    said = rows.where("conv_id % 5 <> 0").select("sample_id", "prediction")
    support = rows.where("conv_id % 7 <> 0").select("sample_id", facts("a").alias("sp"))
    means = evaluation.means(evaluation.official(gold, said, support))
    return means.select(*(F.round(c, 6).alias(c) for c in means.columns))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as predictions; every ninth gives up, and every eleventh is judged consistent."""
    said = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("I don't know. "), F.col("prediction"))).otherwise(F.col("prediction"))
    rows = pairs(spark, sf_dir).withColumn("prediction", said)
    semantic = F.when(F.col("conv_id") % 11 == 0, "Consistent").otherwise("N/A")
    return rows.withColumn("s", answers.answer_scores(F.col("prediction"), F.col("gold"))).withColumn("semantic", semantic)


def status_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_pairs(spark, sf_dir)
    asked = answers.asks_judge(F.col("prediction"), F.col("s.f1"))
    return rows.groupBy(answers.status(F.col("prediction"), F.col("s.f1"), F.col("semantic")).alias("status")).agg(F.count("*").alias("n"), F.count_if(asked).alias("judged"))


def run_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_pairs(spark, sf_dir).join(word_sets(spark, sf_dir), "conv_id")
    h = answers.hits(F.col("a"), F.col("b"), F.col("c"))
    recorded = rows.select(F.struct(F.col("s.f1").alias("f1"), F.col("s.prec").alias("precision"), F.col("s.recall").alias("recall")).alias("metrics"), h.alias("retrieval"))
    out = evaluation.averages(recorded)
    return out.select("count", *(F.round(c, 6).alias(c) for c in out.columns if c != "count"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, line, value): a log for each source, made of its documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("run"))
    d = F.col("doc_id")
    said = F.concat(F.lit("12:00:00 | 🤖 预测: "), F.when(d % 6 == 0, "I don't know. ").otherwise(F.concat(F.lit("text "), d.cast("string"))))
    f1 = F.format_number((d % 5) / 4, 2)
    metric = F.concat(F.lit("12:00:01 | 📊 指标: F1="), f1, F.lit(" | P="), f1, F.lit(" | R="), f1, F.lit(" | "), F.when(d % 8 == 0, "⚪ IDK").otherwise("❌ MISS"), F.lit(" (耗时: "), F.format_number(d % 17 + 0.25, 2), F.lit("s)"))
    scope = F.concat(F.lit("📋 doc_filter: "), (d % 10).cast("string"), F.lit(" 个文档"))
    lines = docs.select("run", F.posexplode(F.array(said, F.lit("noise | F1=1.00"), metric, scope)).alias("i", "value"), "doc_id")
    return lines.select("run", (F.col("doc_id") * 4 + F.col("i")).alias("line"), "value")


def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir)
    out = logs.stats(logs.parse(lines)).join(logs.filter_lines(lines), "run")
    return out.withColumn("mean_latency", F.round("mean_latency", 6)).withColumn("mean_f1", F.round("mean_f1", 6))


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.compare(logs.stats(logs.parse(log_lines(spark, sf_dir))), "src0", "src1")
    return out.select("metric", *(F.round(c, 6).alias(c) for c in ("new", "old", "diff")))


WORD_SETS = f"""ws AS (
  SELECT conv_id, coalesce(list(DISTINCT w) FILTER (part = 0 AND w IS NOT NULL), []) AS a, coalesce(list(DISTINCT w) FILTER (part = 1 AND w IS NOT NULL), []) AS b, coalesce(list(DISTINCT w) FILTER (part = 2 AND w IS NOT NULL), []) AS c
  FROM (SELECT conv_id, turn % 3 AS part, unnest(CASE WHEN len({CAPITAL}) = 0 THEN [NULL] ELSE {CAPITAL} END) AS w FROM conversations) GROUP BY conv_id
), h AS (
  SELECT conv_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS hit_titles, len(list_intersect(a, b)) >= 1 AS retrieval_hit,
    len(a) > 0 AND len(list_intersect(a, b)) >= least(2, len(a)) AS bridge_hit, len(a) > 0 AND len(list_intersect(a, c)) >= least(2, len(a)) AS path_hit FROM ws
)"""

SAID = "CASE WHEN conv_id % 9 = 0 THEN 'I don''t know. ' || prediction ELSE prediction END"
SCORED = f"WITH {PAIRS}, tok AS (SELECT conv_id, turn, {answer_tokens(SAID)} AS p, {answer_tokens('gold')} AS g FROM p), {SCORES}"

JOINT = f"""
WITH {PAIRS}, {WORD_SETS}, tok AS (
  SELECT p.conv_id, {answer_tokens('prediction')} AS p, {answer_tokens('gold')} AS g, a, b, p.conv_id % 7 <> 0 AS has_sp FROM p JOIN ws USING (conv_id) WHERE p.conv_id % 5 <> 0
), {SCORES}, q AS (
  SELECT *, CASE WHEN has_sp AND len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END AS sp_prec, CASE WHEN has_sp AND len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0.0 END AS sp_recall,
    CASE WHEN has_sp AND len(list_intersect(a, b)) = len(a) AND len(a) = len(b) THEN 1.0 ELSE 0.0 END AS sp_em FROM scored
), x AS (
  SELECT *, CASE WHEN sp_prec + sp_recall > 0 THEN 2 * sp_prec * sp_recall / (sp_prec + sp_recall) ELSE 0.0 END AS sp_f1, prec * sp_prec AS joint_prec, recall * sp_recall AS joint_recall, em * sp_em AS joint_em FROM q
), y AS (SELECT *, CASE WHEN joint_prec + joint_recall > 0 THEN 2 * joint_prec * joint_recall / (joint_prec + joint_recall) ELSE 0.0 END AS joint_f1 FROM x)
SELECT {', '.join(f"round(coalesce(avg({c}), 0.0), 6) AS {c}" for c in [p + m for p in ('', 'sp_', 'joint_') for m in ('em', 'f1', 'prec', 'recall')])} FROM y
"""

#: Log lines as text, taken apart by patterns again.
LOGS = r"""
WITH d AS (SELECT doc_id, source AS run FROM documents
), l AS (
  SELECT run, doc_id * 4 + 0 AS line, '12:00:00 | 🤖 预测: ' || CASE WHEN doc_id % 6 = 0 THEN 'I don''t know. ' ELSE 'text ' || doc_id END AS value FROM d
  UNION ALL SELECT run, doc_id * 4 + 1, 'noise | F1=1.00' FROM d
  UNION ALL SELECT run, doc_id * 4 + 2, '12:00:01 | 📊 指标: F1=' || printf('%.2f', (doc_id % 5) / 4.0) || ' | P=' || printf('%.2f', (doc_id % 5) / 4.0) || ' | R=' || printf('%.2f', (doc_id % 5) / 4.0) || ' | '
    || CASE WHEN doc_id % 8 = 0 THEN '⚪ IDK' ELSE '❌ MISS' END || ' (耗时: ' || printf('%.2f', doc_id % 17 + 0.25) || 's)' FROM d
  UNION ALL SELECT run, doc_id * 4 + 3, '📋 doc_filter: ' || (doc_id % 10) || ' 个文档' FROM d
), s AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY line) AS n, trim(regexp_extract(value, '预测: (.*)', 1)) AS prediction FROM l WHERE contains(value, '🤖 预测: ')
), k AS (
  SELECT run, row_number() OVER (PARTITION BY run ORDER BY line) AS n, regexp_extract(value, 'F1=([0-9.]+)', 1)::DOUBLE AS f1, regexp_extract(value, '耗时: ([0-9.]+)s', 1)::DOUBLE AS seconds, value FROM l WHERE contains(value, '📊 指标: ')
), j AS (SELECT k.*, contains(lower(prediction), 'i don''t know') OR contains(lower(value), 'idk') OR contains(value, '⚪') AS idk FROM k JOIN s USING (run, n) WHERE n <= 2000
), st AS (
  SELECT run, count(*) AS total, count(*) FILTER (idk) AS idk, count(*) FILTER (NOT idk AND f1 = 0) AS miss, count(*) FILTER (NOT idk AND f1 > 0 AND f1 <> 1) AS low_f1, count(*) FILTER (NOT idk AND f1 = 1) AS perfect,
    avg(seconds) AS mean_latency, avg(f1) AS mean_f1 FROM j GROUP BY run
)"""

QUERIES = {
    "retrieval_hits": (retrieval_hits, f"WITH {WORD_SETS} SELECT * FROM h"),
    "sp_joint_metrics": (sp_joint_metrics, JOINT),
    "status_buckets": (
        status_buckets,
        f"""{SCORED} SELECT CASE WHEN conv_id % 11 = 0 THEN 'Sem-Match' WHEN contains(ps, 'i dont know') THEN 'IDK' WHEN f1 >= 0.5 THEN 'High F1' WHEN f1 > 0 THEN 'Low F1' ELSE 'MISS' END AS status,
        count(*) AS n, count(*) FILTER (f1 < 0.8 AND NOT contains(ps, 'i dont know')) AS judged FROM scored GROUP BY 1""",
    ),
    "run_averages": (
        run_averages,
        f"""{SCORED}, {WORD_SETS} SELECT count(*) AS count, round(avg(f1), 6) AS f1, round(avg(prec), 6) AS precision, round(avg(recall), 6) AS recall,
        round(avg(retrieval_hit::INT), 6) AS retrieval_hit, round(avg(bridge_hit::INT), 6) AS bridge_hit, round(avg(path_hit::INT), 6) AS path_hit FROM scored JOIN h USING (conv_id)""",
    ),
    "log_stats": (
        log_stats,
        LOGS + " SELECT run, total, idk, miss, low_f1, perfect, round(mean_latency, 6) AS mean_latency, round(mean_f1, 6) AS mean_f1, filters FROM st JOIN (SELECT run, count(*) AS filters FROM l WHERE regexp_matches(value, 'doc_filter: [0-9]+ 个文档') GROUP BY run) USING (run)",
    ),
    "run_comparison": (
        run_comparison,
        LOGS + """, u AS (UNPIVOT (SELECT run, total::DOUBLE AS total, idk * 100.0 / total AS idk, miss * 100.0 / total AS miss, perfect * 100.0 / total AS perfect, mean_latency, mean_f1 FROM st) ON total, idk, miss, perfect, mean_latency, mean_f1 INTO NAME metric VALUE value)
        SELECT a.metric, round(a.value, 6) AS new, round(b.value, 6) AS old, round(a.value - b.value, 6) AS diff FROM u a JOIN u b ON a.metric = b.metric AND a.run = 'src0' AND b.run = 'src1'""",
    ),
}
