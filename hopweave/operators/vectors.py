"""Searches over the vector table: filtered, hybrid, and guided by summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hopweave.sources.lineage import cut

from .knn import nearest
from .setops import shared, top


def search(questions: DataFrame, vectors: DataFrame, k: int, kind: str | None = None, question_id: str = "qid") -> DataFrame:
    """(qid, rank, id, score): the k vectors nearest to each question's, of one kind if that is given."""
    items = vectors.where(F.col("type") == kind) if kind else vectors
    q = questions.select(F.col(question_id).alias("id"), "embedding")
    return nearest(q, items, k)


def unvisited(found: DataFrame, visited: DataFrame) -> DataFrame:
    """The rows of `found` (qid, id, ...) that their question hasn't visited; `visited` (qid, id) may be much larger."""
    found = cut(found)
    return found.join(shared(visited, found, ["qid", "id"]), ["qid", "id"], "left_anti")


def hybrid(questions: DataFrame, vectors: DataFrame, visited: DataFrame, k: int = 5, pre_filter: bool = False) -> DataFrame:
    """(qid, rank, id): the first k chunks of the 2k nearest vectors that the question hasn't visited.

    With `pre_filter` summaries don't take places among the 2k. `visited`: (qid, id).
    """
    found = search(questions, vectors, 2 * k, "chunk" if pre_filter else None).withColumnRenamed("rank", "at")
    kinds = vectors.select("id", "type")
    open_ = unvisited(found.join(kinds, "id").where("type <> 'summary'"), visited)
    return top(open_, ["qid"], [F.asc("at")], k).select("qid", "rank", "id")


def children(summary_ids: DataFrame, summary_edges: DataFrame, key: str = "id") -> DataFrame:
    """`summary_ids` with each summary's child."""
    return summary_ids.join(summary_edges.select(F.col("source").alias(key), F.col("target").alias("child")), key)


def drill(found: DataFrame, summary_edges: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, summary): the first k chunks below ranked summaries (qid, rank, id), at most two levels down.

    Chunks come by their summary's rank, then by their ids; a chunk below two of the summaries comes twice.
    """
    is_summary = F.col("child").startswith("summary_")
    ranked = found.select("qid", F.col("rank").alias("at"), F.col("id").alias("summary"))
    one = children(ranked, summary_edges, "summary")
    direct = one.where(~is_summary).select("qid", "at", "summary", F.lit("").alias("via"), F.col("child").alias("id"))
    two = one.where(is_summary).withColumnRenamed("child", "via")
    below = children(two, summary_edges, "via").where(~is_summary).select("qid", "at", "summary", "via", F.col("child").alias("id"))
    return top(direct.unionByName(below), ["qid"], [F.asc("at"), F.asc("via"), F.asc("id")], k).select("qid", "rank", "id", "summary")


def summary_guided(questions: DataFrame, vectors: DataFrame, summary_edges: DataFrame, k: int) -> DataFrame:
    return drill(search(questions, vectors, k, "summary"), summary_edges, k)
