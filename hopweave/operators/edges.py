"""Edges and upserts: canonical pairs, symmetric views, merging tables by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def next_edges(chunks: DataFrame) -> DataFrame:
    return chunks.where("prev_id IS NOT NULL").select(F.col("prev_id").alias("src"), F.col("chunk_id").alias("dst"))


def canonical(edges: DataFrame, order: str | None = None) -> DataFrame:
    """(src, dst, score) with src < dst, once for a pair: the score that was written last by `order`, else the largest."""
    pair = edges.withColumn("a_", F.least("src", "dst")).withColumn("b_", F.greatest("src", "dst")).where("a_ <> b_")
    score = F.max_by("score", order) if order else F.max("score")
    return pair.groupBy("a_", "b_").agg(score.alias("score")).select(F.col("a_").alias("src"), F.col("b_").alias("dst"), "score")


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, ...) in both directions."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).union(edges.select("dst", "src", *rest))


def with_ends(edges: DataFrame, sources: DataFrame, targets: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """Edges whose ends exist; `sources` and `targets` have one column, the ids."""
    keep = edges.join(sources.toDF(a), a, "left_semi").join(targets.toDF(b), b, "left_semi")
    return keep.select(*edges.columns)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of `new` and those of `old` whose key isn't in it."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def missing(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The rows whose key doesn't exist yet; run it before the costly stages."""
    return rows.join(existing.select(key), key, "left_anti")
