"""Unions by precedence and ranked cuts of the search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column, name: str = "rank") -> DataFrame:
    """The first `n` rows of each key with their rank; a literal `n` is also cut before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= n)


#: Rows that are broadcast at most.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """`df`, a cut table, to be broadcast in a join if it has at most BROADCAST_ROWS rows; the other side then isn't shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shared(pairs: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The `keys` of `pairs` that `rows`, a cut table, has as well: found where `pairs` are made, which may be far more and aren't shuffled."""
    return pairs.select(*keys).join(small(rows.select(*keys)), list(keys), "left_semi")


def by_precedence(rows: DataFrame, labels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, label, precedence): of rows (keys, label) each key once, under the label that comes first in `labels`."""
    spot = (F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("int")
    best = rows.groupBy(*keys).agg(F.min(F.struct(spot.alias("i"), "label")).alias("p"))
    return best.select(*keys, "p.label", F.col("p.i").alias("precedence"))


def min_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """`df` with `value` scaled to 0..1 within its key; unchanged where all values of a key are equal."""
    ends = df.groupBy(key).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    scaled = F.when(F.col("hi_") > F.col("lo_"), (F.col(value) - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))).otherwise(F.col(value))
    return df.join(ends, key).withColumn(value, scaled).drop("lo_", "hi_")


def within_filter(rows: DataFrame, doc_filter: DataFrame, key: str = "qid", id_: str = "id") -> DataFrame:
    """Rows whose id is in their question's filter (`doc_filter`: key, chunk_id)."""
    return rows.join(doc_filter.select(key, F.col("chunk_id").alias(id_)), [key, id_], "left_semi")


def doc_titles(rows: DataFrame, chunks: DataFrame, id_: str = "id") -> DataFrame:
    """`rows` with doc_title, their chunk's title; empty where there is no such chunk. `chunks`: (chunk_id, title)."""
    known = chunks.select(F.col("chunk_id").alias(id_), F.col("title").alias("doc_title"))
    return rows.join(known, id_, "left").withColumn("doc_title", F.coalesce("doc_title", F.lit("")))


def in_batches(rows: DataFrame, size: int, place: str = "pos") -> DataFrame:
    """`rows` with batch, the number of their run of `size` places; a plan takes all batches at once."""
    return rows.withColumn("batch", F.floor(F.col(place) / size).cast("long"))
