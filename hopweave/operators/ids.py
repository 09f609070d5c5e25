"""Dense positions, first occurrences and the identifiers that follow from them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows that one task numbers at most and at least, and the most ranges that they are dealt into.
RANGE_ROWS, LEAST_ROWS, MOST_RANGES = 1_000_000, 500, 65_536


def range_of(c: Column, bounds: list) -> Column:
    """How many of the rising `bounds` are below a number: first by blocks of them and then inside one, so both searches are short."""
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    kind = f"array<{'double' if isinstance(bounds[0], float) else 'bigint'}>"
    literal = lambda xs: F.array(*map(F.lit, xs)).cast(kind)
    block = F.size(F.filter(literal([b[-1] for b in blocks]), lambda b: b < c))
    inside = F.coalesce(F.get(F.array(*map(literal, blocks)), block), F.array().cast(kind))
    return F.least(block * step, F.lit(len(bounds))) + F.size(F.filter(inside, lambda b: b < c))


def dense_index(df: DataFrame, order: Sequence[str], name: str = "pos", start: int = 0) -> DataFrame:
    """`df` with a dense number from `start` on, by `order`, whose first column is a number that few rows share.

    Rows are dealt into ranges of that column (bounds from one sketch), numbered inside their range, and shifted by
    the sizes of the ranges before; no window spans the table.
    """
    key = order[0]
    n = df.count()
    # what follows works on the same partitions, so there are enough of them for all cores
    ranges = min(MOST_RANGES, max(-(-n // RANGE_ROWS), min(2 * df.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS)))
    if ranges <= 1:
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long") - 1 + start)
    bounds = sorted(set(df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]))
    dealt = df.withColumn("range_", range_of(F.col(key), bounds))
    sizes = {r["range_"]: r["count"] for r in dealt.groupBy("range_").count().collect()}
    shifts = list(accumulate((sizes.get(i, 0) for i in range(len(bounds) + 1)), initial=start))
    shift = F.get(F.array(*(F.lit(x).cast("long") for x in shifts)), F.col("range_").cast("int"))
    inside = F.row_number().over(W.partitionBy("range_").orderBy(*order))
    return dealt.withColumn(name, inside - 1 + shift).drop("range_")


def chunk_id(pos: Column) -> Column:
    return F.concat(F.lit("chunk_"), pos.cast("string"))


def number_chunks(docs: DataFrame, order: Sequence[str], start: int = 0, within: str | None = None) -> DataFrame:
    """`docs` with pos, chunk_id and prev_id: the chunk before in input order (null at the start), across documents.

    With `within` (a title column) prev_id stays inside a title.
    """
    rows = dense_index(docs, order, "pos", start)
    if within:
        prev = F.lag("pos").over(W.partitionBy(within).orderBy("pos"))
    else:
        prev = F.when(F.col("pos") > start, F.col("pos") - 1)
    return rows.withColumn("chunk_id", chunk_id(F.col("pos"))).withColumn("prev_id", chunk_id(prev))


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of each key the row that comes first; summed up on the map side, so a frequent key is no large group."""
    return df.groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c != key)), F.struct(*order)).alias("row_")).select(key, "row_.*")


def unique_documents(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((title, text, pos, chunk_id), (sample_id, ctx_pos, chunk_id)) of (sample_pos, sample_id, ctx_pos, title, text).

    The first text of a title stays; documents are numbered by their first appearance.
    """
    first = first_per_key(samples.select("title", "text", "sample_pos", "ctx_pos"), "title", ["sample_pos", "ctx_pos"])
    docs = dense_index(first, ["sample_pos", "ctx_pos"]).withColumn("chunk_id", chunk_id(F.col("pos")))
    mapping = samples.join(docs.select("title", "chunk_id"), "title").select("sample_id", "ctx_pos", "chunk_id")
    return docs.select("title", "text", "pos", "chunk_id"), mapping


def dedup_ratio(samples: DataFrame, docs: DataFrame, per_sample: int = 10) -> DataFrame:
    """One row: samples, documents and the share of contexts that were repeats, at `per_sample` contexts a sample."""
    a, b = samples.agg(F.countDistinct("sample_id").alias("samples")), docs.agg(F.count("*").alias("documents"))
    # both sides are one row
    return a.crossJoin(b).select("samples", "documents", (1 - F.col("documents") / (F.col("samples") * per_sample)).alias("dedup_ratio"))
