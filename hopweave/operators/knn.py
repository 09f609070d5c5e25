"""Nearest neighbours by cosine: exact by blocks, or within cells around sampled centres.

Few queries go to where the vectors are: every task of the scan keeps each query's own best k, so only
(tasks x queries x k) narrow rows are shuffled. Many queries meet the vectors in blocks: each pair of blocks is a task of
its own, and both sides are dealt into few large blocks, so a vector is shuffled `LEAST_PARTS` times as long as blocks of
`BLOCK` rows are enough. Inside a task scores are made in tiles of bounded size and single precision; what may be among a
query's best is scored again in double precision. Those scores are rounded to nine places before they are compared, so that ties
don't hang on the order of summation; ties go to the smaller id. Zero, null and empty vectors take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .setops import top

#: Rows and bytes (in double precision) of a block, and blocks that either side is dealt into at least.
BLOCK, BLOCK_BYTES, LEAST_PARTS = 131_072, 67_108_864, 8
#: Queries of up to this many bytes travel with the scan.
SCAN_BYTES = 32_000_000
#: Queries and rows of a tile of scores, and pairs that are scored again at a time.
TILE_Q, TILE_X, AGAIN = 1_024, 2_048, 32_768
PLACES = 9


def unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    x = (vectors if isinstance(vectors, np.ndarray) else np.stack(vectors.to_numpy())).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def columns(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of Arrow rows (id, v, ...), whose vectors are of one length."""
    v = rows["v"].combine_chunks() if isinstance(rows, pa.Table) else rows["v"]
    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
    if len(v) and len(set(v.value_lengths().unique().to_pylist())) > 1:
        raise ValueError("vectors must be of one length")
    return rows["id"].to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows["id"].to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """Strings as objects: Arrow strings that were concatenated can't go back to Spark."""
    return df.astype({c: object for c in ("qid", "id") if c in df and not pd.api.types.is_numeric_dtype(df[c])})


def usable(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part; floats stay floats until they are scored."""
    v = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_).alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")


def order_of(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of `ids`."""
    return ids if ids.dtype.kind in "iuf" else np.unique(ids, return_inverse=True)[1]


class Best:
    """Of each query the k best rows among those that were added."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.q, self.k, self.own = ids, unit(vectors), k, exclude_self
        self.near = self.q.astype(np.float32)
        #: More than a score in single precision and the rounding can be off.
        self.slack = np.float32((vectors.shape[1] + 8) * 2.0**-22 + 10.0**-PLACES)
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.empty((len(ids), k), dtype=object if ids.dtype.kind == "O" else ids.dtype)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        x = unit(vectors)
        fine = np.isfinite(x).all(axis=1)
        if not len(self.ids) or not fine.any():
            return
        ids, x = ids[fine], x[fine]
        if self.found.dtype != ids.dtype:  # nothing was added yet
            self.found = self.found.astype(ids.dtype)
        # of one vector's exact copies only those with the first ids can stay; a query leaves out the rows of its own id
        most = self.k + (int(np.unique(ids, return_counts=True)[1].max()) if self.own else 0)
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)[1].ravel()
        by = np.lexsort((order_of(ids), same))
        begins = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]])
        place = np.arange(len(by)) - np.repeat(begins, np.diff(np.r_[begins, len(by)]))
        stay = np.sort(by[place < most])
        ids, x = ids[stay], x[stay]
        near = x.astype(np.float32)
        for j in range(0, len(ids), TILE_X):
            for i in range(0, len(self.ids), TILE_Q):
                self.tile(i, ids[j : j + TILE_X], x[j : j + TILE_X], near[j : j + TILE_X], most)

    def tile(self, i: int, ids: np.ndarray, x: np.ndarray, near: np.ndarray, most: int) -> None:
        s = self.near[i : i + TILE_Q] @ near.T
        least = self.scores[i : i + TILE_Q, -1].astype(np.float32) - self.slack
        new = np.flatnonzero(np.isneginf(least))
        if len(new) and most < len(ids):  # queries that don't have k rows yet: their best of this tile bound the rest
            least[new] = -np.partition(-s[new], most - 1, axis=1)[:, most - 1] - 2 * self.slack
        row, col = np.divmod(np.flatnonzero(s >= least[:, None]), s.shape[1])
        kept = []
        for a in range(0, len(row), AGAIN):
            r, c = row[a : a + AGAIN] + i, col[a : a + AGAIN]
            score = np.round(np.einsum("ij,ij->i", self.q[r], x[c]), PLACES)
            good = (score >= self.scores[r, -1]) & np.isfinite(score)
            if self.own:
                good &= self.ids[r] != ids[c]
            kept.append((r[good], c[good], score[good]))
        if kept:
            r, c, score = (np.concatenate(parts) for parts in zip(*kept, strict=True))
            if len(r):
                self.merge(r, ids[c], score)

    def merge(self, r: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        rows = np.unique(r)
        held = np.isfinite(self.scores[rows])
        r = np.concatenate([np.repeat(rows, held.sum(axis=1)), r])
        ids, score = np.concatenate([self.found[rows][held], ids]), np.concatenate([self.scores[rows][held], score])
        by = np.lexsort((order_of(ids), -score, r))
        r, ids, score = r[by], ids[by], score[by]
        begins = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        place = np.arange(len(r)) - np.repeat(begins, np.diff(np.r_[begins, len(r)]))
        stay = place < self.k
        self.scores[r[stay], place[stay]], self.found[r[stay], place[stay]] = score[stay], ids[stay]

    def rows(self) -> pd.DataFrame:
        row, place = np.nonzero(np.isfinite(self.scores))
        return pd.DataFrame({"qid": self.ids[row], "id": self.found[row, place], "score": self.scores[row, place]})


def arrow(found: pd.DataFrame, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pandas(plain(found), schema=schema, preserve_index=False)


def shape(x: DataFrame, q: DataFrame) -> tuple[str, pa.Schema]:
    """What a task returns, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {"qid": q.schema["id"].dataType, "id": x.schema["id"].dataType}
    return ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", score double", pa.schema([*((c, to_arrow_type(t)) for c, t in kinds.items()), ("score", pa.float64())])


def scan(queries: pa.Table, items: DataFrame, k: int, schema: tuple[str, pa.Schema], exclude_self: bool) -> DataFrame:
    q_ids, q = columns(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        for b in batches:
            if b.num_rows:
                best = best or Best(q_ids, q, k, exclude_self)
                best.add(*columns(b))
        if best:
            yield from arrow(best.rows(), schema[1]).to_batches(65_536)

    return items.mapInArrow(run, schema[0])


def blocks(queries: DataFrame, items: DataFrame, k: int, schema: tuple[str, pa.Schema], exclude_self: bool, cells: tuple[str, str] | None, n_q: int, n_x: int, width: int) -> DataFrame:
    """Pairs of blocks, by cell if there are any; a cell of any size is dealt into as many parts as the whole needs. `width`: bytes of a vector."""
    size = max(1, min(BLOCK, BLOCK_BYTES // max(1, width)))
    q_parts, x_parts = max(LEAST_PARTS, -(-n_q // size)), max(LEAST_PARTS, -(-n_x // size))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["cell"] if cells else []
    left = queries.withColumn("p", part(q_parts)).withColumn("q", every(x_parts))
    right = items.withColumn("q", part(x_parts)).withColumn("p", every(q_parts))
    keys = [*cell, "p", "q"]
    if not cells:  # as many partitions as tasks, which aren't merged
        left, right = (df.repartition(q_parts * x_parts, *keys) for df in (left, right))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema[1].empty_table()
        best = Best(*columns(a), k, exclude_self)
        best.add(*columns(b))
        return arrow(best.rows(), schema[1])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema[0])


def centres(items: DataFrame, n: int) -> np.ndarray:
    """`n` rows chosen by a hash of their id: a bounded sample for any table."""
    rows = items.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(n).toPandas()
    return unit(rows["v"])


def with_cells(df: DataFrame, centre: np.ndarray, probes: int) -> DataFrame:
    """`df` with a row for each of its `probes` nearest cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = np.argsort(-(unit(b["v"]) @ centre.T), axis=1, kind="stable")[:, :probes]
                yield plain(b.loc[b.index.repeat(near.shape[1])].assign(cell=near.ravel()))

    return df.mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, v {df.schema['v'].dataType.simpleString()}, cell int")


def nearest(queries: DataFrame, items: DataFrame, k: int, id_: str = "id", vector: str = "embedding", exclude_self: bool = False, n_cells: int = 0, probes: int = 8) -> DataFrame:
    """(qid, rank, id, score): the k rows of `items` nearest to each row of `queries`, best first.

    Exact by default. With `n_cells`, rows meet only in the cells of sampled centres: an item lies in its nearest
    cell, a query looks into its `probes` nearest.
    """
    x, q = usable(items, id_, vector), usable(queries, id_, vector)
    schema = shape(x, q)
    size = q.agg(F.count("*").alias("n"), F.sum(F.size("v") * 8).alias("bytes")).first()
    if (size["bytes"] or 0) <= SCAN_BYTES:
        held = q.toArrow()
        found = scan(held, x, k, schema, exclude_self) if len(held) else x.limit(0).select(F.lit(None).cast(q.schema["id"].dataType).alias("qid"), "id", F.lit(0.0).alias("score"))
    else:
        cells = None
        if n_cells:
            centre = centres(x, n_cells)
            x, q, cells = with_cells(x, centre, 1), with_cells(q, centre, probes), ("cell", "cell")
        found = blocks(q, x, k, schema, exclude_self, cells, size["n"], x.count(), size["bytes"] // size["n"])
    return top(found, ["qid"], [F.desc("score"), F.asc("id")], k).select("qid", "rank", "id", "score")


def semantic_edges(vectors: DataFrame, k: int = 3, least: float = 0.5, pos: str = "pos", vector: str = "embedding", n_cells: int = 0) -> DataFrame:
    """(src, dst, score) by position: each row's k nearest others that score `least` and stand after it."""
    rows = vectors.select(F.col(pos).cast("long").alias("id"), F.col(vector).alias("embedding"))
    found = nearest(rows, rows, k, exclude_self=True, n_cells=n_cells)
    return found.where((F.col("score") >= least) & (F.col("qid") < F.col("id"))).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "score")
