"""Building the graph: documents to chunks, entities, relations, summaries, semantic and bridge edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hopweave.config import Config
from hopweave.functions.text import left, parse_triples
from hopweave.models import Models
from hopweave.operators.edges import canonical, missing, next_edges, with_ends
from hopweave.operators.ids import number_chunks
from hopweave.operators.knn import semantic_edges
from hopweave.operators.mentions import bridge_edges, mentions, occurrences, relation_edges
from hopweave.operators.summaries import clusters, summary_tree
from hopweave.sources.lineage import cut

from .graph import KnowledgeGraph


def extracted(chunks: DataFrame, models: Models, config: Config) -> DataFrame:
    """Chunks with entities, relations (asked for only where there are enough entities) and embeddings."""
    rows = models.entities.extract(chunks.withColumn("head_", left(F.col("text"), config.entity_chars)), "head_").drop("head_")
    enough = F.size("entities") >= config.min_entities_for_relations
    asked = rows.where(enough).withColumn("head_", left(F.col("text"), config.relation_chars))
    told = models.relations.extract(asked, "head_").withColumn("rels", parse_triples(F.col("triples"))).drop("head_", "triples")
    rest = rows.where(F.coalesce(~enough, F.lit(True))).withColumn("rels", F.array().cast("array<struct<source:string,target:string,type:string>>"))
    return models.embedder.embed(told.unionByName(rest))


def build(docs: DataFrame, order: Sequence[str] = ("doc_id",), models: Models | None = None, config: Config | None = None, start: int = 0, existing: DataFrame | None = None, within_title: bool = False, n_cells: int = 0) -> KnowledgeGraph:
    """The graph of `docs` (title, text and the columns of `order`), a chunk for each row.

    `start` is the first free position of a saved graph and `existing` its chunks (title): documents of titles that
    are there already are left out before any model sees them.
    """
    models, config = models or Models(), config or Config()
    if existing is not None:
        docs = missing(docs, existing.select("title").distinct(), "title")
    chunks = number_chunks(docs.select("title", "text", *(c for c in order if c not in ("title", "text"))), list(order), start, "title" if within_title else None)
    chunks = cut(chunks.select("pos", "chunk_id", "prev_id", "title", "text"))
    rows = cut(extracted(chunks, models, config))
    mentioned = cut(mentions(rows, config=config))
    clustered = cut(clusters(rows, config))
    summaries, edges = summary_tree(rows, clustered, models.summarizer, config)
    summaries = cut(summaries)
    edges = with_ends(edges, summaries.select("id"), summaries.select("id").union(chunks.select("chunk_id")))
    chunk_of = lambda p: F.concat(F.lit("chunk_"), F.col(p).cast("string"))
    near = semantic_edges(rows, config.knn_k, config.knn_min_score, n_cells=n_cells).select(chunk_of("src").alias("src"), chunk_of("dst").alias("dst"), "score")
    vectors = rows.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("type"), "title", "text", "embedding")
    vectors = vectors.unionByName(models.embedder.embed(summaries.select("id", F.lit("summary").alias("type"), "title", "text")))
    return KnowledgeGraph(
        chunks=chunks.select("pos", "chunk_id", "title", "text"), mentions=mentioned, relations=cut(relation_edges(rows)), next=next_edges(chunks), related=cut(canonical(near)),
        bridge=cut(bridge_edges(occurrences(mentioned, config), config)), summaries=summaries, summary_edges=cut(edges), vectors=cut(vectors),
    )


def extend(graph: KnowledgeGraph, docs: DataFrame, order: Sequence[str] = ("doc_id",), models: Models | None = None, config: Config | None = None, batch_only: bool = False) -> KnowledgeGraph:
    """`graph` with new documents: ids go on from the next free position.

    Semantic and bridge edges are made anew over old and new chunks; with `batch_only` just among the new ones.
    """
    models, config = models or Models(), config or Config()
    start = (graph.chunks.agg(F.max("pos")).first()[0] if graph.chunks.limit(1).count() else -1) + 1
    new = build(docs, order, models, config, start, graph.chunks)
    whole = graph.merged(new)
    if batch_only:
        return whole
    bridge = cut(bridge_edges(occurrences(whole.mentions, config), config))
    rows = whole.vectors.where("type = 'chunk'").join(whole.chunks.select(F.col("chunk_id").alias("id"), "pos"), "id")
    chunk_of = lambda p: F.concat(F.lit("chunk_"), F.col(p).cast("string"))
    near = semantic_edges(rows, config.knn_k, config.knn_min_score).select(chunk_of("src").alias("src"), chunk_of("dst").alias("dst"), "score")
    tables = whole.tables() | {"bridge": bridge, "related": cut(canonical(near))}
    return KnowledgeGraph(**tables)
