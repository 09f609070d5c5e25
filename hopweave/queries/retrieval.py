"""Retrieval: vector search, expansion, page rank, scores and the search itself."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.config import Config
from hopweave.functions import scores
from hopweave.functions.text import capital_tokens
from hopweave.operators import linking, mentions, neighbours, pagerank, setops, vectors
from hopweave.operators.edges import both_ways, next_edges
from hopweave.operators.ids import chunk_id
from hopweave.plans.build import build
from hopweave.plans.search import search
from hopweave.sources.lineage import cut

from . import fixtures as fx
from .fixtures import CAPITAL, MENTIONS, RELATIONS, SIMILAR, TURNS, VECTORS
from .graphs import related

#: Synthetic vectors are far apart, so edges are made and read at lower scores than by default.
READ_AT = 0.3
CAP, BRIDGE_CAP, LINK_CAP = 15, 10, 5


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, embedding): every fiftieth vector."""
    return fx.vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")


def found(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "id", F.round("score", 6).alias("score"))


def knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(vectors.search(asked(spark, sf_dir), fx.vectors(spark, sf_dir), 10))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(vectors.search(asked(spark, sf_dir), fx.vectors(spark, sf_dir), 5, "summary"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = fx.vectors(spark, sf_dir)
    q = asked(spark, sf_dir)
    # a stated set of questions and what each has visited
    visited = q.select("qid").join(every.select("id"), (F.col("qid") + F.col("id")) % 3 == 0)
    return vectors.hybrid(q, every, visited, 5)


def summary_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about every conversation find its second-level summary and then the next one's first level."""
    from .graphs import summary_edges

    convs = fx.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    own = F.concat(F.lit("summary_l2_conv_"), F.col("conv_id").cast("string"))
    after = lambda k: F.concat(F.lit("summary_l1_conv_"), (F.col("conv_id") + 1).cast("string"), F.lit(f"_{k}"))
    hits = convs.select(F.col("conv_id").alias("qid"), F.posexplode(F.array(own, after(1), after(0))).alias("i", "id")).select("qid", (F.col("i") + 1).alias("rank"), "id")
    return vectors.drill(hits, summary_edges(spark, sf_dir), 8)


def summary_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graphs import summary_edges, summary_tree

    return vectors.children(summary_tree(spark, sf_dir).where("level = 2").select("id"), summary_edges(spark, sf_dir))


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, chunk_id): every fiftieth chunk as a question of its own."""
    return fx.chunks(spark, sf_dir).where("pos % 50 = 0").select(F.col("pos").alias("qid"), "chunk_id")


def co_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.co_mentions(frontier(spark, sf_dir), cut(fx.mentioned(spark, sf_dir)), CAP)


def relation_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.tokens(spark, sf_dir)
    return mentions.co_mentions(frontier(spark, sf_dir), cut(fx.mentioned(spark, sf_dir, words)), CAP, fx.relations(spark, sf_dir, words))


def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, entity): the capitalized words of benchmark items, lower-cased and cut to six letters."""
    words = F.array_distinct(F.transform(capital_tokens(F.col("text")), lambda w: F.lower(F.substring(w, 1, 6))))
    return fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(words).alias("entity"))


def query_entity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.linked_chunks(query_entities(spark, sf_dir), cut(fx.mentioned(spark, sf_dir)), LINK_CAP).select("entity", "id")


def ppr_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = query_entities(spark, sf_dir).groupBy("qid").agg(F.collect_list("entity").alias("entities"))
    return linking.rank_seeds(entities, cut(fx.mentioned(spark, sf_dir))).withColumn("weight", F.round("weight", 9))


def graph_tables(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """What an expansion reads: vectors' neighbours stand for those of the chunks at their numbers."""
    chunks, words = cut(fx.chunks(spark, sf_dir)), fx.tokens(spark, sf_dir)
    m = cut(fx.mentioned(spark, sf_dir, words))
    near = related(spark, sf_dir).select(chunk_id(F.col("src")).alias("src"), chunk_id(F.col("dst")).alias("dst"), "score")
    return SimpleNamespace(chunks=chunks, mentions=m, relations=cut(fx.relations(spark, sf_dir, words)), next=next_edges(chunks), related=near, bridge=cut(mentions.bridge_edges(mentions.occurrences(m))))


def expand_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step out from every fiftieth chunk, whose next chunk has been visited; its entity is the chunk's first word."""
    graph, front = graph_tables(spark, sf_dir), frontier(spark, sf_dir)
    seen = front.select("qid", F.col("chunk_id").alias("id")).unionByName(front.select("qid", chunk_id(F.col("qid") + 1).alias("id")))
    first = F.lower(F.substring(F.get(capital_tokens(F.col("text")), F.lit(0)), 1, 6))
    entities = graph.chunks.where("pos % 50 = 0").select(F.col("pos").alias("qid"), first.alias("entity")).where("entity IS NOT NULL")
    config = Config(neighbour_cap=CAP, bridge_cap=BRIDGE_CAP, query_entity_cap=LINK_CAP, related_read_score=READ_AT)
    near = neighbours.Neighbourhood.of(graph, config, entities.select("entity").distinct(), 2)
    return neighbours.expand(front, seen, near, entities).select("qid", "id", "label")


def walk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges both ways): the vectors in a row and their nearest neighbours."""
    nodes = fx.vectors(spark, sf_dir).select("id")
    steps = nodes.join(nodes.select((F.col("id") - 1).alias("id")), "id").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return nodes, both_ways(steps.union(related(spark, sf_dir).select("src", "dst"))).distinct()


def walk_seeds(nodes: DataFrame) -> DataFrame:
    return nodes.where("id % 50 = 0").select(F.col("id").alias("qid"), "id", F.lit(1.0).alias("weight"))


def ppr_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps from an even start for every fiftieth vector."""
    nodes, edges = walk(spark, sf_dir)
    return pagerank.rank_steps(nodes, cut(edges), walk_seeds(nodes), 3, places=9)


def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled ranks of all nodes for the same questions."""
    nodes, edges = walk(spark, sf_dir)
    text = lambda *cs: [F.col(c).cast("string").alias(c) for c in cs]
    seeds = walk_seeds(nodes).select("qid", *text("id"), "weight")
    ranks = pagerank.ranks(nodes.select(*text("id")), edges.select(*text("src", "dst")), seeds, tol=1e-4)
    # rounded half up as F.round does, which takes longer for a table of questions times nodes than all else
    return ranks.everywhere(seeds.select("qid")).withColumn("ppr", F.floor(F.col("ppr") * 1e9 + 0.5) / 1e9)


def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("value"))
    return setops.min_max(rows, "lang", "value").withColumn("value", F.round("value", 9))


def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    names = ("QueryEnt", "EntBridge", "RelPath", "SummaryDrill", "Sem", "VectorJump", "Seq", "EntMention", "Doc")
    source = F.get(F.array(*map(F.lit, names)), (d % 9).cast("int"))
    ppr = F.when(d % 4 != 0, (d % 100) / 100)
    entities = F.when(d % 5 != 0, F.array(F.lit("the"), F.lit("onen"), F.lit("zzz"))).otherwise(F.array().cast("array<string>"))
    score = scores.trust((d % 21 - 10).cast("double"), ppr, F.col("text"), entities, d % 4, source)
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.round(score, 9).alias("trust"))


def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as questions: the 16 best documents of each, ties in order."""
    rows = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), "doc_id", (F.col("n_chars") % 97).alias("score"))
    return setops.top(rows, ["qid"], [F.desc("score"), F.asc("doc_id")], 16)


def doc_filter_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the filters of two questions, the good and the toxic documents, let pass."""
    labels = fx.table(spark, sf_dir, "labels")
    ids = labels.where("quality = 1").select(F.lit("good").alias("qid"), "doc_id").unionByName(labels.where("toxic = 1").select(F.lit("toxic").alias("qid"), "doc_id"))
    docs = fx.documents(spark, sf_dir).where("text <> ''")
    rows = docs.select(F.explode(F.array(F.lit("good"), F.lit("toxic"))).alias("qid"), F.col("doc_id").alias("id"), "title")
    return setops.within_filter(rows, ids.withColumnRenamed("doc_id", "chunk_id"))


def best_first_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of all documents, asked by all benchmark items; those with odd numbers may use 12 documents each."""
    docs = fx.documents(spark, sf_dir)
    config = Config(knn_min_score=READ_AT, related_read_score=READ_AT)
    graph = build(docs, config=config)
    items = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    n = graph.chunks.count()
    own = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: chunk_id((F.col("qid") * 31 + i * 17) % n))
    result = search(graph, items, items.where("qid % 2 = 1").select("qid", F.explode(own).alias("chunk_id")), config=config)
    rows = result.select("qid", F.posexplode_outer("nodes").alias("rank", "n"), "best_path")
    return rows.select("qid", "rank", F.col("n.id").alias("id"), F.col("n.title").alias("label"), F.col("n.depth").alias("depth"), F.round("n.score", 6).alias("score"), "best_path")


LABELS = (("RelPath", "SELECT f.qid, m2.chunk_id AS id FROM f JOIN m m1 USING (chunk_id) JOIN r ON r.source = m1.name JOIN m m2 ON m2.name = r.target"), ("EntMention", "SELECT f.qid, m2.chunk_id AS id FROM f JOIN m m1 USING (chunk_id) JOIN m m2 USING (name)"), ("Sem", "SELECT f.qid, CASE WHEN src = chunk_id THEN dst ELSE src END AS id FROM f JOIN rel ON chunk_id IN (src, dst) WHERE score > 0.3"), ("Seq", "SELECT f.qid, c.chunk_id AS id FROM f JOIN c ON abs(c.pos - f.qid) = 1"))


def capped(name: str, sql: str, cap: int, part: str = "qid") -> str:
    seen = "NOT EXISTS (SELECT 1 FROM seen s WHERE s.qid = z.qid AND s.id = z.id)"
    return f"{name} AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY {part} ORDER BY id) AS k FROM (SELECT DISTINCT * FROM ({sql})) z WHERE {seen}) WHERE k <= {cap})"


EXPAND = f"""
WITH {MENTIONS}, {RELATIONS}, {VECTORS}, f AS (SELECT pos AS qid, chunk_id FROM c WHERE pos % 50 = 0
), seen AS (SELECT qid, chunk_id AS id FROM f UNION SELECT qid, 'chunk_' || (qid + 1) FROM f
), k AS (SELECT a.id AS src, b.id AS dst, {SIMILAR} AS score FROM v a JOIN v b ON a.id <> b.id
), rel AS (SELECT 'chunk_' || src AS src, 'chunk_' || dst AS dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM k) WHERE r <= 3 AND score >= 0.2 AND src < dst
), o AS (SELECT DISTINCT name, chunk_id FROM m WHERE type <> 'Date'
), band AS (SELECT name, count(*) AS n FROM o GROUP BY name HAVING count(*) BETWEEN 2 AND 50
), p AS (
  SELECT x.name, x.chunk_id AS a, y.chunk_id AS b, n, dense_rank() OVER (PARTITION BY x.name ORDER BY x.chunk_id) AS k,
    row_number() OVER (PARTITION BY x.name, x.chunk_id ORDER BY md5(x.name || '|' || x.chunk_id || '|' || y.chunk_id), y.chunk_id) AS r
  FROM band JOIN o x USING (name) JOIN o y ON x.name = y.name AND x.chunk_id <> y.chunk_id
), q AS (SELECT name, n, least(a, b) AS src, greatest(a, b) AS dst, min(k * 10 + r) AS spot FROM p WHERE n <= 20 OR r <= 5 GROUP BY ALL
), br AS (SELECT DISTINCT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY spot) AS z FROM q) WHERE n <= 20 OR z <= 50
), ent AS (SELECT pos AS qid, lower(substr(({CAPITAL})[1], 1, 6)) AS entity FROM c WHERE pos % 50 = 0 AND len({CAPITAL}) > 0
), {', '.join(capped(label, sql, CAP) for label, sql in LABELS)},
{capped('EntBridge', 'SELECT f.qid, CASE WHEN src = chunk_id THEN dst ELSE src END AS id FROM f JOIN br ON chunk_id IN (src, dst)', BRIDGE_CAP)},
{capped('QueryEnt', 'SELECT ent.qid, m.chunk_id AS id FROM ent JOIN m ON contains(m.name, entity) OR contains(entity, m.name)', LINK_CAP)}
, every AS ({' UNION ALL '.join(f"SELECT qid, id, {i} AS spot, '{label}' AS label FROM {label}" for i, label in enumerate(neighbours.PRECEDENCE))})
SELECT qid, id, arg_min(label, spot) AS label FROM every GROUP BY qid, id
"""

FRONTIER = f"{MENTIONS}, f AS (SELECT pos AS qid, chunk_id FROM c WHERE pos % 50 = 0)"
FIRST = "SELECT qid, chunk_id, id FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY id) AS k FROM p) WHERE k <= 15"
SEARCHED = f"{VECTORS}, d AS (SELECT a.id AS qid, b.id AS id, b.type, {SIMILAR} AS score FROM v a JOIN v b ON true WHERE a.id % 50 = 0)"
ENTITIES = f"e AS (SELECT DISTINCT item_id AS qid, lower(substr(unnest({CAPITAL}), 1, 6)) AS entity FROM benchmark)"
DRILL = f"""
WITH {TURNS}, g AS (SELECT DISTINCT title, turn % 2 AS k FROM t
), l2 AS (SELECT title FROM g GROUP BY title HAVING count(*) > 1
), q AS (SELECT DISTINCT conv_id AS qid FROM conversations
), x AS (
  SELECT qid, 1 AS spot, 'summary_l2_conv_' || qid AS summary, 'summary_l1_conv_' || qid || '_' || (turn % 2) AS via, chunk_id AS id FROM q JOIN t ON t.conv_id = qid WHERE title IN (SELECT title FROM l2)
  UNION ALL SELECT qid, CASE turn % 2 WHEN 1 THEN 2 ELSE 3 END, 'summary_l1_conv_' || (qid + 1) || '_' || (turn % 2), '', chunk_id FROM q JOIN t ON t.conv_id = qid + 1
), r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY spot, via, id) AS rank, id, summary FROM x)
SELECT qid, rank::INT AS rank, id, summary FROM r WHERE rank <= 8
"""
PPR = f"""
WITH {VECTORS}, n AS (SELECT count(*) AS n FROM v
), k AS (SELECT a.id AS src, b.id AS dst, {SIMILAR} AS score FROM v a JOIN v b ON a.id <> b.id
), rel AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM k) WHERE r <= 3 AND score >= 0.2 AND src < dst
), one AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON b.id = a.id + 1 UNION SELECT src, dst FROM rel
), e AS (SELECT src, dst FROM one UNION SELECT dst, src FROM one
), w AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS share FROM e
), s AS (SELECT id AS qid FROM v WHERE id % 50 = 0
), x0 AS (SELECT qid, v.id, 1.0::DOUBLE / n AS x FROM s, v, n
), {', '.join(f"x{i} AS (SELECT qid, id, sum(y) AS x FROM (SELECT qid, dst AS id, 0.85 * x * share AS y FROM x{i - 1} JOIN w ON src = id UNION ALL SELECT qid, qid, 0.15 FROM s) GROUP BY qid, id)" for i in (1, 2, 3))}
SELECT qid, id, round(x, 9) AS x FROM x3
"""
SEEDS = f"""
WITH {MENTIONS}, {ENTITIES}, t AS (SELECT qid, entity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY entity) AS k FROM e) WHERE k <= 5
), h AS (SELECT u.entity, m.chunk_id AS id, row_number() OVER (PARTITION BY u.entity ORDER BY m.chunk_id, m.name) AS k FROM (SELECT DISTINCT entity FROM t) u JOIN m ON contains(m.name, u.entity) OR contains(u.entity, m.name)
), s AS (SELECT qid, id, count(*) AS n FROM t JOIN h USING (entity) WHERE k <= 10 GROUP BY qid, id)
SELECT qid, id, round(n / sum(n) OVER (PARTITION BY qid), 9) AS weight FROM s
"""
TRUST = """
WITH x AS (
  SELECT doc_id, 1 / (1 + exp(-(doc_id % 21 - 10) / 5)) AS a, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 100) / 100 END AS r, 1 / (1 + 0.15::DOUBLE * (doc_id % 4)) AS p,
    CASE WHEN doc_id % 5 <> 0 THEN 0.3::DOUBLE + 0.7::DOUBLE * (contains(lower(text), 'the')::INT + contains(lower(text), 'onen')::INT + contains(lower(text), 'zzz')::INT) / 3 ELSE 0.3::DOUBLE END AS c,
    [1.0, 0.9, 0.85, 0.85, 0.8, 0.75, 0.65, 0.9, 0.9][doc_id % 9 + 1]::DOUBLE AS w FROM documents
)
SELECT doc_id, round(CASE WHEN r IS NULL THEN 0.55::DOUBLE * a + 0.15::DOUBLE * c + 0.15::DOUBLE * p + 0.15::DOUBLE * w ELSE 0.5::DOUBLE * a + 0.1::DOUBLE * r + 0.15::DOUBLE * c + 0.12::DOUBLE * p + 0.13::DOUBLE * w END, 9) AS trust FROM x
"""

QUERIES = {
    "knn_search": (knn_search, f"WITH {SEARCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM d) SELECT qid, rank::INT AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 10"),
    "knn_filtered": (knn_filtered, f"WITH {SEARCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM d WHERE type = 'summary') SELECT qid, rank::INT AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 5"),
    "hybrid_search": (
        hybrid_search,
        f"""WITH {SEARCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS spot FROM d), o AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY spot) AS rank FROM r WHERE spot <= 10 AND type <> 'summary' AND (qid + id) % 3 <> 0)
        SELECT qid, rank::INT AS rank, id FROM o WHERE rank <= 5""",
    ),
    "summary_drill": (summary_drill, DRILL),
    "summary_children": (
        summary_children,
        f"WITH {TURNS}, g AS (SELECT DISTINCT title, turn % 2 AS k FROM t) SELECT 'summary_l2_' || title AS id, 'summary_l1_' || title || '_' || k AS child FROM g WHERE title IN (SELECT title FROM g GROUP BY title HAVING count(*) > 1)",
    ),
    "co_mention": (co_mention, f"WITH {FRONTIER}, p AS (SELECT DISTINCT qid, f.chunk_id, b.chunk_id AS id FROM f JOIN m a ON a.chunk_id = f.chunk_id JOIN m b ON b.name = a.name AND b.chunk_id <> f.chunk_id) {FIRST}"),
    "relation_path": (
        relation_path,
        f"WITH {FRONTIER}, {RELATIONS}, p AS (SELECT DISTINCT qid, f.chunk_id, b.chunk_id AS id FROM f JOIN m a ON a.chunk_id = f.chunk_id JOIN r ON r.source = a.name JOIN m b ON b.name = r.target AND b.chunk_id <> f.chunk_id) {FIRST}",
    ),
    "query_entity_link": (
        query_entity_link,
        f"WITH {MENTIONS}, {ENTITIES}, h AS (SELECT DISTINCT entity, chunk_id AS id FROM (SELECT DISTINCT entity FROM e) JOIN m ON contains(name, entity) OR contains(entity, name)) SELECT entity, id FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY id) AS k FROM h) WHERE k <= 5",
    ),
    "ppr_seed": (ppr_seed, SEEDS),
    "ppr_iter": (ppr_iter, PPR),
    "page_rank": (page_rank, None),
    "expand_neighbours": (expand_neighbours, EXPAND),
    "minmax_norm": (
        minmax_norm,
        "SELECT doc_id, lang, round(CASE WHEN max(n_chars) OVER w > min(n_chars) OVER w THEN (n_chars - min(n_chars) OVER w) / (max(n_chars) OVER w - min(n_chars) OVER w) ELSE n_chars END, 9) AS value FROM documents WINDOW w AS (PARTITION BY lang)",
    ),
    "trust_score": (trust_score, TRUST),
    "frontier_topk": (frontier_topk, "SELECT source AS qid, doc_id, n_chars % 97 AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars % 97 DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 16"),
    "doc_filter_semi": (
        doc_filter_semi,
        "SELECT DISTINCT 'good' AS qid, doc_id AS id, 'doc_' || doc_id AS title FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text <> '' UNION ALL SELECT DISTINCT 'toxic', doc_id, 'doc_' || doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND text <> ''",
    ),
    "best_first_search": (best_first_search, None),
}
