"""Loaders, sinks and saved graphs: each query writes what the operator reads, in its own format, and returns what comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from hopweave.config import Config
from hopweave.operators import edges, ids, mentions, setops, summaries
from hopweave.plans import evaluation
from hopweave.plans.graph import KnowledgeGraph
from hopweave.plans.search import with_mode
from hopweave.sources import documents as docs_io
from hopweave.sources import logs
from hopweave.sources.lineage import cut, shared_folder

from . import fixtures as fx
from .evaluation import LOGS, log_lines
from .fixtures import CHUNKS, MENTIONS, RELATIONS, SCORES, TURNS, answer_tokens


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/inputs-{uuid.uuid4()}"


def json_of(c: Column) -> Column:
    """A string as JSON."""
    boxed = F.to_json(F.array(c))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def json_file(lines: DataFrame, order: str, path: str) -> str:
    """One JSON array of `lines` (order, line); the benchmark table that it is made of doesn't grow with the corpus."""
    held = F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"])
    lines.agg(F.concat(F.lit("["), F.array_join(held, ",\n"), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return path


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "benchmark").select("item_id", "text")


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document has no title."""
    title = F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("item_"), F.col("item_id").cast("string")))
    lines = items(spark, sf_dir).select("item_id", F.to_json(F.struct(title.alias("title"), "text")).alias("line"))
    return docs_io.documents(spark, json_file(lines, "item_id", folder(spark))).select("pos", "title", F.md5("text").alias("text"))


def sample_file(spark: SparkSession, sf_dir: str) -> str:
    """Items as question samples; each has itself, in two sentences, and one title that many share as contexts."""
    i, text = F.col("item_id"), F.col("text")
    name, many = (F.concat(F.lit(p), (x).cast("string")) for p, x in (("item_", i), ("group_", i % 7)))
    opened = lambda t: F.concat(F.lit("["), json_of(t), F.lit(","))
    context = F.concat(F.lit("["), opened(name), F.to_json(F.array(F.lit("First."), text)), F.lit("],"), opened(many), F.to_json(F.array(F.concat(F.lit("Of "), name))), F.lit("]]"))
    facts = F.concat(F.lit("["), opened(name), F.lit("0],"), opened(name), F.lit("1]]"))
    line = F.concat(F.lit('{"_id":'), json_of(i.cast("string")), F.lit(',"question":'), json_of(F.substring(text, 1, 80)), F.lit(',"answer":'), json_of(F.substring(text, 1, 60)), F.lit(',"context":'), context, F.lit(',"supporting_facts":'), facts, F.lit("}"))
    return json_file(items(spark, sf_dir).select("item_id", line.alias("line")), "item_id", folder(spark))


def load_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of all samples as documents."""
    rows = docs_io.contexts(docs_io.samples(spark, sample_file(spark, sf_dir)))
    return rows.select("sample_pos", "sample_id", "ctx_pos", "title", F.md5("text").alias("text"))


def official_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve means of a prediction file against a sample file: each item is answered by the next one's beginning."""
    gold = docs_io.samples(spark, sample_file(spark, sf_dir))
    rows = items(spark, sf_dir)
    after = rows.select((F.col("item_id") - 1).alias("item_id"), F.substring("text", 1, 60).alias("said"))
    said = rows.join(after, "item_id").withColumn("id", F.col("item_id").cast("string"))
    one = lambda c: F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(c)), ","), F.lit("}"))
    answers = F.concat(json_of(F.col("id")), F.lit(":"), json_of(F.col("said")))
    support = F.when(F.col("item_id") % 7 != 0, F.concat(json_of(F.col("id")), F.lit(':[["item_'), "id", F.lit('",0],["other",3]]')))
    path = folder(spark)
    said.agg(F.concat(F.lit('{"answer":'), one(answers), F.lit(',"sp":'), one(support), F.lit("}")).alias("value")).coalesce(1).write.text(path)
    means = evaluation.means(evaluation.official(gold, *docs_io.predictions(spark, path)))
    return means.select(*(F.round(c, 6).alias(c) for c in means.columns))


def mapping_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as samples, texts as titles: both mappings written, read and joined again."""
    docs = fx.table(spark, sf_dir, "documents")
    samples = docs.select(F.col("doc_id").alias("sample_pos"), F.col("source").alias("sample_id"), F.col("doc_id").alias("ctx_pos"), F.md5("text").alias("title"), "text")
    unique, mapping = ids.unique_documents(samples)
    path = folder(spark)
    docs_io.write_mappings(unique, mapping, path)
    titles, sample_chunks = docs_io.read_mappings(spark, path)
    return sample_chunks.join(titles, "chunk_id").select(F.col("ctx_pos").alias("doc_id"), F.col("sample_id").alias("source"), "title", "chunk_id")


def results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all turns as JSON lines; what an earlier run left there is gone."""
    rows = fx.pairs(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("prediction"), F.struct((F.length("gold") / 8).alias("f1"), F.lit("N/A").alias("semantic")).alias("metrics"))
    path = folder(spark)
    docs_io.write_results(rows.withColumn("prediction", F.lit("old")), path)
    docs_io.write_results(rows, path)
    return spark.read.json(path).select("id", F.md5("prediction").alias("prediction"), "metrics.f1", "metrics.semantic")


def graph_of_tables(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    chunks, words = cut(fx.chunks(spark, sf_dir)), fx.tokens(spark, sf_dir)
    m = cut(fx.mentioned(spark, sf_dir, words))
    turns = fx.turns(spark, sf_dir)
    nodes, links = summaries.summary_tree(turns, turns.select("title", "chunk_id", "pos", (F.col("turn") % 2).cast("int").alias("cluster")))
    users = fx.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("src"), (F.col("event_id") % 50).cast("string").alias("dst"), F.col("value").alias("score"), "event_id")
    return KnowledgeGraph(
        chunks=chunks.select("pos", "chunk_id", "title", "text"), mentions=m, relations=fx.relations(spark, sf_dir, words).distinct(), next=edges.next_edges(chunks), related=edges.canonical(users, "event_id"),
        bridge=mentions.bridge_edges(mentions.occurrences(m), sampled=False), summaries=nodes, summary_edges=links, vectors=fx.vectors(spark, sf_dir),
    )


def saved_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that replaces an emptied one in place and is loaded without any model: rows of each table."""
    path, graph = folder(spark), graph_of_tables(spark, sf_dir)
    KnowledgeGraph(**{name: df.limit(0) for name, df in graph.tables().items()}).save(path)
    graph.save(path)
    loaded = KnowledgeGraph.load(spark, path)
    loaded.views("saved_")
    return loaded.counts()


def vectors_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved vectors, appended in two batches and read back through the partition of one type."""
    path, rows = folder(spark), fx.vectors(spark, sf_dir)
    for part in (0, 1):
        rows.where(F.col("id") % 2 == part).write.mode("append").partitionBy("type").parquet(path)
    return spark.read.parquet(path).where("type = 'summary'").select("id", "type", F.size("embedding").alias("dim"))


def graph_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes and edges that a batch of chunks writes: documents, chunks, their order and their mentions."""
    chunks = fx.chunks(spark, sf_dir)
    row = lambda kind, a, b: (F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    m = fx.mentioned(spark, sf_dir)
    out = chunks.select(*row("CONTAINS", F.col("title"), F.col("chunk_id"))).union(edges.next_edges(chunks).select(*row("NEXT", F.col("src"), F.col("dst"))))
    nodes = mentions.entity_nodes(m)
    return out.union(m.select(*row("MENTIONS", F.col("chunk_id"), F.col("name")))).union(nodes.select(*row("ENTITY", F.col("name"), F.col("type"))))


def sample_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with its sample's filter; one without is open, a small one and a large one differ in mode."""
    asked = items(spark, sf_dir).select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    n = F.when(F.col("qid") % 3 == 1, 20).when(F.col("qid") % 3 == 2, 21)
    mapping = asked.select(F.col("qid").alias("sample_id"), F.explode(F.sequence(F.lit(1), n)).alias("k")).select("sample_id", F.concat(F.lit("chunk_"), F.col("k").cast("string")).alias("chunk_id"))
    return with_mode(asked, docs_io.filters(mapping.union(mapping)), Config()).select("qid", "n_filter", "mode")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.in_batches(fx.chunks(spark, sf_dir).select("title", "pos"), Config().batch_size).groupBy("batch").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def log_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first 17 samples of each run's log."""
    return logs.parse(log_lines(spark, sf_dir), limit=17).groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 6).alias("seconds"))


def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as the engine takes them: defaults, and the variant that keeps short texts."""
    names = ("beam_width", "max_steps", "knn_k", "small_space", "ppr_max_iter", "summary_chars", "summary_error_chars")
    a, b = Config(), Config.in_memory(beam_width=3)
    return spark.createDataFrame([(n, float(getattr(a, n)), float(getattr(b, n))) for n in names], "name string, value double, in_memory double")


class Beginnings:
    """A summarizer without a model: the hash of what it was given, and its length; an error for every fifth hint."""

    def summarize(self, df: DataFrame, text: str = "text", hint: str = "hint", out: str = "summary") -> DataFrame:
        failed = F.substring_index(hint, "_", -1).cast("long") % 5 == 0
        return df.withColumn(out, F.when(~failed, F.concat(F.md5(text), F.lit(" of "), F.length(text).cast("string"))))


def model_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by a model, with both variants' thresholds and what stays after an error."""
    rows = fx.documents(spark, sf_dir).select("doc_id", "text", F.col("title").alias("hint"))
    offline = summaries.generated(rows, Beginnings(), Config()).select("doc_id", F.col("summary").alias("offline"))
    return offline.join(summaries.generated(rows, Beginnings(), Config.in_memory()).select("doc_id", F.col("summary").alias("in_memory")), "doc_id")


def guarded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges from orders to parts; only those whose ends are both known stay."""
    lines = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), "l_linenumber")
    orders = fx.table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey")
    parts = fx.table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey")
    return edges.with_ends(lines, orders, parts)


def doc_title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by chunk id for twice as many ids as there are chunks."""
    chunks = fx.chunks(spark, sf_dir)
    wanted = chunks.select(F.explode(F.array("chunk_id", F.concat(F.lit("summary_"), "chunk_id"))).alias("id"))
    return setops.doc_titles(wanted, chunks).select("id", "doc_title")


def first_of_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 turns of each role by place: a run that takes no more samples than that."""
    rows = fx.turns(spark, sf_dir).join(fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return rows.withColumn("n", F.row_number().over(W.partitionBy("role").orderBy("pos"))).where("n <= 10").select("role", "n", "chunk_id")


ITEM = "row_number() OVER (ORDER BY item_id) - 1"
PREDICTED = f"""
WITH tok AS (
  SELECT b.item_id, {answer_tokens('left(n.text, 60)')} AS p, {answer_tokens('left(b.text, 60)')} AS g, b.item_id % 7 <> 0 AS has_sp FROM benchmark b JOIN benchmark n ON n.item_id = b.item_id + 1
), {SCORES}, q AS (SELECT *, CASE WHEN has_sp THEN 0.5 ELSE 0.0 END AS sp_prec, CASE WHEN has_sp THEN 0.5 ELSE 0.0 END AS sp_recall, 0.0 AS sp_em, CASE WHEN has_sp THEN 0.5 ELSE 0.0 END AS sp_f1 FROM scored
), x AS (SELECT *, prec * sp_prec AS joint_prec, recall * sp_recall AS joint_recall, em * sp_em AS joint_em FROM q
), y AS (SELECT *, CASE WHEN joint_prec + joint_recall > 0 THEN 2 * joint_prec * joint_recall / (joint_prec + joint_recall) ELSE 0.0 END AS joint_f1 FROM x)
SELECT {', '.join(f"round(coalesce(avg({c}), 0.0), 6) AS {c}" for c in [p + m for p in ('', 'sp_', 'joint_') for m in ('em', 'f1', 'prec', 'recall')])} FROM y
"""
SAVED = f"""
WITH {MENTIONS}, {RELATIONS}, {TURNS}, g AS (SELECT DISTINCT title, turn % 2 AS k FROM t
), l2 AS (SELECT title FROM g GROUP BY title HAVING count(*) > 1
), b AS (SELECT name FROM m WHERE type <> 'Date' GROUP BY name HAVING count(*) BETWEEN 2 AND 20
), e AS (SELECT user_id::VARCHAR AS a, (event_id % 50)::VARCHAR AS b FROM events)
SELECT 'chunks' AS "table", count(*) AS rows FROM c UNION ALL SELECT 'mentions', count(*) FROM m UNION ALL SELECT 'relations', count(*) FROM (SELECT DISTINCT * FROM r)
UNION ALL SELECT 'next', count(*) - 1 FROM c UNION ALL SELECT 'related', count(*) FROM (SELECT DISTINCT least(a, b), greatest(a, b) FROM e WHERE a <> b)
UNION ALL SELECT 'bridge', count(*) FROM (SELECT DISTINCT x.chunk_id, y.chunk_id FROM b JOIN m x USING (name) JOIN m y ON x.name = y.name AND x.chunk_id < y.chunk_id)
UNION ALL SELECT 'summaries', (SELECT count(*) FROM g) + (SELECT count(*) FROM l2) UNION ALL SELECT 'summary_edges', (SELECT count(*) FROM t) + (SELECT count(*) FROM g WHERE title IN (FROM l2)) UNION ALL SELECT 'vectors', count(*) FROM embeddings
"""


def model_sql() -> str:
    from .texts import summary_sql

    hint = "'doc_' || doc_id"
    clean = fx.strip("replace(text, chr(10), ' ')")
    said = lambda n: f"md5(left(text, {n})) || ' of ' || length(left(text, {n}))"
    return f"""SELECT doc_id, CASE WHEN length(text) < 500 THEN {summary_sql('text', hint)} WHEN doc_id % 5 = 0 THEN '[' || {hint} || '] ' || left(text, 200) || '...' ELSE '[' || {hint} || '] ' || {said(2000)} END AS offline,
    CASE WHEN text = '' THEN '' WHEN length(text) < 500 THEN '[' || {hint} || '] ' || {clean} WHEN doc_id % 5 = 0 THEN '[' || {hint} || '] ' || left({clean}, 300) || '...' ELSE '[' || {hint} || '] ' || {said(4000)} END AS in_memory FROM documents"""


QUERIES = {
    "load_documents": (load_documents, f"WITH n AS (SELECT *, {ITEM} AS pos FROM benchmark) SELECT pos, CASE WHEN item_id % 3 = 0 THEN 'Document_' || pos ELSE 'item_' || item_id END AS title, md5(text) AS text FROM n"),
    "load_samples": (
        load_samples,
        f"""WITH n AS (SELECT *, {ITEM} AS pos FROM benchmark) SELECT pos AS sample_pos, item_id::VARCHAR AS sample_id, 0 AS ctx_pos, 'item_' || item_id AS title, md5('First. ' || text) AS text FROM n
        UNION ALL SELECT pos, item_id::VARCHAR, 1, 'group_' || (item_id % 7), md5('Of item_' || item_id) FROM n""",
    ),
    "official_files": (official_files, PREDICTED),
    "mapping_tables": (
        mapping_tables,
        "WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text), n AS (SELECT text, 'chunk_' || (row_number() OVER (ORDER BY first) - 1) AS chunk_id FROM f) SELECT doc_id, source, md5(text) AS title, chunk_id FROM documents JOIN n USING (text)",
    ),
    "results_sink": (results_sink, f"WITH {fx.PAIRS} SELECT conv_id || '-' || turn AS id, md5(prediction) AS prediction, length(gold) / 8 AS f1, 'N/A' AS semantic FROM p"),
    "saved_graph": (saved_graph, SAVED),
    "vectors_by_type": (vectors_by_type, "SELECT vec_id AS id, 'summary' AS type, len(embedding)::INT AS dim FROM embeddings WHERE label = 0"),
    "graph_write": (
        graph_write,
        f"""WITH {MENTIONS} SELECT 'CONTAINS' AS kind, title AS a, chunk_id AS b FROM c UNION ALL SELECT 'NEXT', lag(chunk_id) OVER (ORDER BY pos), chunk_id FROM c QUALIFY lag(chunk_id) OVER (ORDER BY pos) IS NOT NULL
        UNION ALL SELECT 'MENTIONS', chunk_id, name FROM m UNION ALL SELECT 'ENTITY', name, arg_max(type, pos) FROM m GROUP BY name""",
    ),
    "sample_filters": (sample_filters, "SELECT item_id AS qid, CASE item_id % 3 WHEN 1 THEN 20 WHEN 2 THEN 21 END AS n_filter, CASE item_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'A' ELSE 'B' END AS mode FROM benchmark"),
    "batches": (batches, f"WITH {CHUNKS} SELECT pos // 16 AS batch, count(*) AS n, min(pos) AS first FROM c GROUP BY 1"),
    "log_limit": (log_limit, LOGS.replace("n <= 2000", "n <= 17") + " SELECT run, count(*) AS n, round(sum(seconds), 6) AS seconds FROM j GROUP BY run"),
    "config_values": (
        config_values,
        "SELECT * FROM (VALUES ('beam_width', 8.0::DOUBLE, 3.0::DOUBLE), ('max_steps', 3, 3), ('knn_k', 3, 3), ('small_space', 20, 20), ('ppr_max_iter', 30, 30), ('summary_chars', 2000, 4000), ('summary_error_chars', 200, 300)) v(name, value, in_memory)",
    ),
    "model_summaries": (model_summaries, model_sql()),
    "guarded_edges": (
        guarded_edges,
        "SELECT l_orderkey AS source, l_partkey AS target, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)",
    ),
    "doc_title_lookup": (doc_title_lookup, f"WITH {CHUNKS} SELECT chunk_id AS id, title AS doc_title FROM c UNION ALL SELECT 'summary_' || chunk_id, '' FROM c"),
    "first_of_samples": (
        first_of_samples,
        "WITH t AS (SELECT role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM conversations), n AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY pos)::INT AS n, 'chunk_' || pos AS chunk_id FROM t) SELECT * FROM n WHERE n <= 10",
    ),
}
