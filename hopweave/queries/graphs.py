"""The graph build: identifiers, entities, edges, summaries and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.config import Config
from hopweave.functions.text import capital_tokens
from hopweave.operators import edges, ids, knn, mentions, summaries
from hopweave.sources.documents import merge_cache
from hopweave.sources.lineage import cut

from . import fixtures as fx
from .fixtures import CAPITAL, CHUNKS, MENTIONS, RELATIONS, SIMILAR, TURNS, VECTORS

KNN_LEAST = 0.2


def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as titles, sources as samples: each text once, numbered by first appearance, and the mapping onto it."""
    docs = fx.table(spark, sf_dir, "documents")
    samples = docs.select(F.col("doc_id").alias("sample_pos"), F.col("source").alias("sample_id"), F.col("doc_id").alias("ctx_pos"), F.md5("text").alias("title"), "text")
    _, mapping = ids.unique_documents(samples)
    return mapping.select(F.col("sample_id").alias("source"), F.col("ctx_pos").alias("doc_id"), "chunk_id")


def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    out = ids.dedup_ratio(docs.select(F.col("source").alias("sample_id")), docs.select("text").distinct(), 100)
    return out.withColumn("dedup_ratio", F.round("dedup_ratio", 9))


def chunk_ids_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order, each with the one before it, across conversations and inside one."""
    rows = fx.turns(spark, sf_dir)
    inside = ids.number_chunks(fx.turns(spark, sf_dir).drop("pos", "chunk_id", "prev_id"), ["conv_id", "turn"], within="title")
    return rows.join(inside.select("conv_id", "turn", F.col("prev_id").alias("prev_in_title")), ["conv_id", "turn"]).select("conv_id", "turn", "chunk_id", "prev_id", "prev_in_title")


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.mentioned(spark, sf_dir)


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions.inverted_index(mentions.occurrences(fx.mentioned(spark, sf_dir), labels=None))
    return found.select("name", "n_chunks", F.array_join("chunks", ",").alias("chunks"))


def entity_band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.band_stats(mentions.occurrences(fx.mentioned(spark, sf_dir)))


def bridge_edges_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.bridge_edges(mentions.occurrences(fx.mentioned(spark, sf_dir)), sampled=False)


def bridge_edges_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.bridge_edges(mentions.occurrences(fx.mentioned(spark, sf_dir)), full=False)


def last_write_wins_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose type changes with the chunk and the place in it: the last one stays."""
    kinds = F.array(*map(F.lit, ("Person", "Location", "Event")))
    words = F.transform(capital_tokens(F.col("text")), lambda w, i: F.struct(w.alias("name"), F.get(kinds, ((F.col("pos") + i) % 3).cast("int")).alias("type")))
    return mentions.entity_nodes(mentions.mentions(fx.chunks(spark, sf_dir).select("chunk_id", "pos", words.alias("entities"))))


def relation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the first 60% of chunks, then those of the last 60% merged in, with the names that only they have."""
    words = fx.tokens(spark, sf_dir)
    rels = cut(fx.relations(spark, sf_dir, words))
    n = words.count()
    at = F.substring("source_chunk", 7, 20).cast("long")
    merged = edges.upsert(rels.where(at < 0.6 * n), rels.where(at >= 0.4 * n), ["source", "target", "type", "source_chunk"])
    nodes = mentions.entity_nodes(fx.mentioned(spark, sf_dir, words).where("name > 'm'"), merged)
    return merged.groupBy("source", "target", "type").agg(F.count("*").alias("chunks")).join(nodes.select(F.col("name").alias("source"), F.col("type").alias("source_type")), "source")


def canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edges between users in both directions: one edge for a pair, with the score that was written last."""
    rows = fx.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("src"), (F.col("event_id") % 50).cast("string").alias("dst"), F.col("value").alias("score"), "event_id")
    return edges.canonical(rows, "event_id")


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.vectors(spark, sf_dir).select(F.col("id").alias("pos"), "embedding")
    return knn.semantic_edges(rows, 3, KNN_LEAST)


def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related(spark, sf_dir).select("src", "dst", F.round("score", 6).alias("score"))


def cluster_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = fx.turns(spark, sf_dir).groupBy("title").agg(F.count("*").alias("n"))
    by_label = fx.table(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("title")).agg(F.count("*").alias("n"))
    return sizes.unionByName(by_label).select("title", "n", summaries.cluster_count(F.col("n")).alias("k"))


def by_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, chunk_id, pos, cluster): turns in two clusters, by whether they are odd."""
    return fx.turns(spark, sf_dir).select("title", "chunk_id", "pos", (F.col("turn") % 2).cast("int").alias("cluster"))


def cluster_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.cluster_texts(fx.turns(spark, sf_dir), by_turn(spark, sf_dir))


def summary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the tree over those clusters."""
    nodes, _ = summaries.summary_tree(fx.turns(spark, sf_dir), by_turn(spark, sf_dir))
    return nodes


def summary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links = summaries.summary_tree(fx.turns(spark, sf_dir), by_turn(spark, sf_dir))
    return links


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the vectors of each label, which stand for titles."""
    rows = fx.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("title"), F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("pos"), "embedding")
    return summaries.clusters(rows, Config())


def incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't there yet, numbered from the first free position on."""
    chunks = fx.chunks(spark, sf_dir)
    there = chunks.where("pos % 3 = 0")
    start = there.agg(F.max("pos")).first()[0]
    new = edges.missing(chunks.select("title", "text", F.col("pos").alias("at")), there, "title")
    return ids.number_chunks(new, ["at"], (start if start is not None else -1) + 1).select("title", "chunk_id", "prev_id")


def doc_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = fx.chunks(spark, sf_dir)
    old = chunks.where("pos % 3 <> 1").select("chunk_id", "title", F.lit("old").alias("text"))
    return merge_cache(old, chunks.where("pos % 2 = 0").select("chunk_id", "title", F.md5("text").alias("text")))


def graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities, mentions, relations and chunks there are."""
    words = fx.tokens(spark, sf_dir)
    m, r = fx.mentioned(spark, sf_dir, words), fx.relations(spark, sf_dir, words)
    out = m.agg(F.countDistinct("name").alias("entities"), F.count("*").alias("mentions"), F.countDistinct("chunk_id").alias("chunks"))
    return out.crossJoin(r.agg(F.count("*").alias("relations")))  # two single rows


SAMPLED = f"""
WITH {MENTIONS}, o AS (SELECT DISTINCT name, chunk_id FROM m WHERE type <> 'Date'
), b AS (SELECT name FROM o GROUP BY name HAVING count(*) BETWEEN 21 AND 50
), p AS (
  SELECT x.name, x.chunk_id AS a, y.chunk_id AS b, dense_rank() OVER (PARTITION BY x.name ORDER BY x.chunk_id) AS k,
    row_number() OVER (PARTITION BY x.name, x.chunk_id ORDER BY md5(x.name || '|' || x.chunk_id || '|' || y.chunk_id), y.chunk_id) AS r
  FROM b JOIN o x USING (name) JOIN o y ON x.name = y.name AND x.chunk_id <> y.chunk_id
), q AS (SELECT name, least(a, b) AS src, greatest(a, b) AS dst, min(k * 10 + r) AS spot FROM p WHERE r <= 5 GROUP BY ALL
), z AS (SELECT src, dst, row_number() OVER (PARTITION BY name ORDER BY spot) AS n FROM q)
SELECT DISTINCT src, dst, 1.0::DOUBLE AS score FROM z WHERE n <= 50
"""

UPSERT = f"""
WITH {MENTIONS}, {RELATIONS}, n AS (SELECT count(*) AS n FROM documents
), u AS (SELECT source, target, count(*) AS chunks FROM r GROUP BY ALL
), e AS (SELECT name, arg_max(type, pos) AS type FROM m WHERE name > 'm' GROUP BY name)
SELECT source, target, 'FOLLOWED_BY' AS type, chunks, e.type AS source_type FROM u LEFT JOIN e ON e.name = source
"""

KNN = f"""
WITH {VECTORS}, s AS (SELECT a.id AS src, b.id AS dst, {SIMILAR} AS score FROM v a JOIN v b ON a.id <> b.id
), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM s)
SELECT src, dst, round(score, 6) AS score FROM k WHERE r <= 3 AND score >= {KNN_LEAST} AND src < dst
"""

CLUSTERED = f"{TURNS}, g AS (SELECT title, (turn % 2)::INT AS cluster, count(*) AS n_chunks, string_agg(text, ' ' ORDER BY pos) AS text FROM t GROUP BY ALL)"
L1 = f"{CLUSTERED}, l1 AS (SELECT 'summary_l1_' || title || '_' || cluster AS id, {{l1}} AS text, 1 AS level, title, cluster FROM g)"


def tree_sql() -> str:
    from .texts import summary_sql

    first = L1.format(l1=summary_sql("text", "title"))
    return f"""WITH {first}, o AS (SELECT title, string_agg(text, chr(10) ORDER BY cluster) AS body, 'Overall summary for ' || title AS hint FROM l1 GROUP BY title HAVING count(*) > 1)
    SELECT id, text, level, title FROM l1 UNION ALL SELECT 'summary_l2_' || title, {summary_sql("body", "hint")}, 2, title FROM o"""


QUERIES = {
    "dedup_documents": (
        dedup_documents,
        "WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text), n AS (SELECT text, 'chunk_' || (row_number() OVER (ORDER BY first) - 1) AS chunk_id FROM f) SELECT source, doc_id, chunk_id FROM documents JOIN n USING (text)",
    ),
    "dedup_ratio": (dedup_ratio, "SELECT count(DISTINCT source) AS samples, count(DISTINCT text) AS documents, round(1 - count(DISTINCT text) / (count(DISTINCT source) * 100), 9) AS dedup_ratio FROM documents"),
    "chunk_ids_prev": (
        chunk_ids_prev,
        f"WITH {TURNS} SELECT conv_id, turn, chunk_id, lag(chunk_id) OVER (ORDER BY pos) AS prev_id, lag(chunk_id) OVER (PARTITION BY conv_id ORDER BY pos) AS prev_in_title FROM t",
    ),
    "entity_mentions": (entity_mentions, f"WITH {MENTIONS} SELECT * FROM m"),
    "inverted_index": (inverted_index, f"WITH {MENTIONS} SELECT name, count(*) AS n_chunks, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunks FROM m GROUP BY name HAVING count(*) BETWEEN 2 AND 50"),
    "entity_band_stats": (
        entity_band_stats,
        f"""WITH {MENTIONS}, n AS (SELECT name, count(*) AS n FROM m WHERE type <> 'Date' GROUP BY name) SELECT count(*) AS total, count(*) FILTER (n < 2) AS filtered_low, count(*) FILTER (n > 50) AS filtered_high,
        count(*) FILTER (n BETWEEN 2 AND 50) AS used, count(*) FILTER (n BETWEEN 2 AND 20) AS full_connect, count(*) FILTER (n BETWEEN 21 AND 50) AS sampled FROM n""",
    ),
    "bridge_edges_full": (
        bridge_edges_full,
        f"""WITH {MENTIONS}, b AS (SELECT name FROM m WHERE type <> 'Date' GROUP BY name HAVING count(*) BETWEEN 2 AND 20)
        SELECT DISTINCT x.chunk_id AS src, y.chunk_id AS dst, 1.0::DOUBLE AS score FROM b JOIN m x USING (name) JOIN m y ON x.name = y.name AND x.chunk_id < y.chunk_id""",
    ),
    "bridge_edges_sampled": (bridge_edges_sampled, SAMPLED),
    "last_write_wins_type": (
        last_write_wins_type,
        f"""WITH {CHUNKS}, w AS (SELECT pos, {CAPITAL} AS ws FROM c), x AS (SELECT pos, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM w)
        SELECT lower(w) AS name, arg_max(['Person', 'Location', 'Event'][(pos + i) % 3 + 1], pos * 1000000 + i) AS type FROM x WHERE lower(w) NOT IN ({fx.STOP}) GROUP BY 1""",
    ),
    "relation_upsert": (relation_upsert, UPSERT),
    "canonical_edges": (
        canonical_edges,
        """WITH e AS (SELECT event_id, user_id::VARCHAR AS a, (event_id % 50)::VARCHAR AS b, value FROM events)
        SELECT least(a, b) AS src, greatest(a, b) AS dst, arg_max(value, event_id) AS score FROM e WHERE a <> b GROUP BY 1, 2""",
    ),
    "knn_edges": (knn_edges, KNN),
    "cluster_count": (
        cluster_count,
        f"WITH {TURNS}, n AS (SELECT title, count(*) AS n FROM t GROUP BY title UNION ALL SELECT 'label_' || label, count(*) FROM embeddings GROUP BY label) SELECT title, n, greatest(1, least(n // 3, 5))::INT AS k FROM n",
    ),
    "cluster_text": (cluster_text, f"WITH {CLUSTERED} SELECT title, cluster, n_chunks, text FROM g"),
    "summary_tree": (summary_tree, tree_sql()),
    "summary_edges": (
        summary_edges,
        f"""WITH {TURNS}, g AS (SELECT DISTINCT title, turn % 2 AS k FROM t) SELECT 'summary_l1_' || title || '_' || (turn % 2) AS source, chunk_id AS target, 'CONTAINS_CHUNK' AS type FROM t
        UNION ALL SELECT 'summary_l2_' || title, 'summary_l1_' || title || '_' || k, 'CONTAINS_SUMMARY' FROM g WHERE title IN (SELECT title FROM g GROUP BY title HAVING count(*) > 1)""",
    ),
    "clusters": (clusters, None),
    "incremental_anti": (
        incremental_anti,
        f"""WITH {CHUNKS}, s AS (SELECT max(pos) + 1 AS start FROM c WHERE pos % 3 = 0), n AS (SELECT title, start + row_number() OVER (ORDER BY pos) - 1 AS p, start FROM c, s WHERE pos % 3 <> 0)
        SELECT title, 'chunk_' || p AS chunk_id, CASE WHEN p > start THEN 'chunk_' || (p - 1) END AS prev_id FROM n""",
    ),
    "doc_cache_merge": (doc_cache_merge, f"WITH {CHUNKS} SELECT chunk_id, title, CASE WHEN pos % 2 = 0 THEN md5(text) ELSE 'old' END AS text FROM c WHERE pos % 3 <> 1 OR pos % 2 = 0"),
    "graph_totals": (graph_totals, f"WITH {MENTIONS}, {RELATIONS} SELECT count(DISTINCT name) AS entities, count(*) AS mentions, count(DISTINCT chunk_id) AS chunks, (SELECT count(*) FROM r) AS relations FROM m"),
}
