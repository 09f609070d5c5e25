"""One step out from chunks: along the order of the text, likeness, entities, relations and bridges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hopweave.config import Config
from hopweave.sources.lineage import cut

from .edges import both_ways
from .linking import linked_chunks
from .mentions import first_mentions, leads
from .setops import by_precedence, small, top

#: A chunk that is reached in several ways has the label that comes first here.
PRECEDENCE = ("RelPath", "EntMention", "Sem", "Seq", "EntBridge", "QueryEnt")


@dataclass(frozen=True)
class Neighbourhood:
    """The tables that expansions read, in the form that they need; made once for all rounds."""

    names: DataFrame  # chunk_id, name
    first: DataFrame  # name, chunk_id, label: those with the name or one that a relation leads to, as many as a cap and the visited ones can use up
    steps: DataFrame  # src, dst both ways, label: likeness, order and bridges
    links: DataFrame | None  # entity, id
    config: Config

    @classmethod
    def of(cls, graph, config: Config, entities: DataFrame | None = None, visits: int = 1) -> Neighbourhood:
        """`entities`: (entity), those of all questions; `visits`: how many chunks a question may have visited."""
        cap = config.neighbour_cap + visits + 1
        strong = graph.related.where(F.col("score") > config.related_read_score)
        labelled = [both_ways(edges.select("src", "dst")).withColumn("label", F.lit(label)) for label, edges in (("Sem", strong), ("Seq", graph.next), ("EntBridge", graph.bridge))]
        steps = cut(labelled[0].union(labelled[1]).union(labelled[2]))
        links = cut(linked_chunks(entities, graph.mentions, config.query_entity_cap + visits)) if entities is not None else None
        named = cut(first_mentions(graph.mentions, cap))
        first = cut(named.withColumn("label", F.lit("EntMention")).union(leads(graph.relations, named, cap).withColumn("label", F.lit("RelPath"))))
        return cls(graph.mentions.select("chunk_id", "name"), first, steps, links, config)


def expand(frontier: DataFrame, visited: DataFrame, near: Neighbourhood, entities: DataFrame | None = None) -> DataFrame:
    """(qid, id, label, precedence): the unvisited neighbours of each question's chunk.

    `frontier`: (qid, chunk_id), one for a question; `visited`: (qid, id), which holds the chunk itself; `entities`:
    (qid, entity). Each way is capped by id: as a whole, and for query entities by entity. All ways are capped in one pass.
    """
    config = near.config
    front = small(cut(frontier.select("qid", "chunk_id")))
    stepped = near.steps.join(front, near.steps.src == front.chunk_id).select("qid", F.col("dst").alias("id"), "label", F.lit("").alias("of"))
    mine = small(cut(near.names.join(front, "chunk_id").select("qid", "chunk_id", "name")))
    by_name = near.first.withColumnRenamed("chunk_id", "id").join(mine, "name").where("id <> chunk_id").select("qid", "id", "label", F.lit("").alias("of"))
    ways = stepped.union(by_name)
    if entities is not None and near.links is not None:
        mine = entities.join(frontier.select("qid"), "qid", "left_semi").join(near.links.select("entity", "id"), "entity")
        ways = ways.union(mine.select("qid", "id", F.lit("QueryEnt").alias("label"), F.col("entity").alias("of")))
    unseen = ways.distinct().join(visited.select("qid", "id"), ["qid", "id"], "left_anti")
    caps = F.when(F.col("label") == "EntBridge", config.bridge_cap).when(F.col("label") == "QueryEnt", config.query_entity_cap).otherwise(config.neighbour_cap)
    kept = top(unseen, ["qid", "label", "of"], [F.asc("id")], caps)
    return by_precedence(kept, PRECEDENCE, ["qid", "id"])
