"""The knowledge graph as tables: chunks, mentions, relations, edges, summaries and vectors."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.operators.edges import upsert

#: Columns that name a row, for merging a batch into a saved graph.
KEYS = {
    "chunks": ["chunk_id"], "mentions": ["chunk_id", "name"], "relations": ["source", "target", "type", "source_chunk"], "next": ["src", "dst"],
    "related": ["src", "dst"], "bridge": ["src", "dst"], "summaries": ["id"], "summary_edges": ["source", "target"], "vectors": ["id"],
}


@dataclass(frozen=True)
class KnowledgeGraph:
    """Edges between chunks are undirected and stored once, with src < dst (`next`: in order)."""

    chunks: DataFrame  # pos, chunk_id, title, text
    mentions: DataFrame  # chunk_id, pos, name, type
    relations: DataFrame  # source, target, type, source_chunk
    next: DataFrame  # src, dst
    related: DataFrame  # src, dst, score
    bridge: DataFrame  # src, dst, score
    summaries: DataFrame  # id, text, level, title
    summary_edges: DataFrame  # source, target, type
    vectors: DataFrame  # id, type, title, text, embedding

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Each table as Parquet, the vectors partitioned by type so that a filter on it reads only its files."""
        for name, df in self.tables().items():
            writer = df.write.mode(mode)
            (writer.partitionBy("type") if name == "vectors" else writer).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KnowledgeGraph:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})

    def merged(self, batch: KnowledgeGraph) -> KnowledgeGraph:
        """This graph with a batch's rows, which win."""
        new = batch.tables()
        return KnowledgeGraph(**{name: upsert(df, new[name], KEYS[name]) for name, df in self.tables().items()})

    def views(self, prefix: str = "graph_") -> None:
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)

    def counts(self) -> DataFrame:
        """(table, rows)."""
        out = None
        for name, df in self.tables().items():
            one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
            out = one if out is None else out.unionByName(one)
        return out
