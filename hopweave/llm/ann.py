"""Nearest neighbours by vantage-point trees, one per shard.

Every row is indexed. A bounded sample of the rows gives the cells' pivots; each row belongs to the cell of its nearest
pivot, and a cell of more than SHARD rows is several shards. Each shard's tree is built where it is searched. A tree
node splits its rows by their distance to a vantage point; a search leaves out a side whose distance bound (triangle
inequality), times `factor`, is over the tenth-best distance so far. Factor one leaves out only what can't matter, so
the search is exact; larger factors leave out more.

Queries are a stated set, in blocks of bounded size. Each first searches the cell of its nearest pivot, whose k-th best
distance bounds its answer; then only those other cells that the same inequality can't rule out, with that bound from
the start. Shards answer with their own best k, and the best k of those are the result.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors meet
only those of their own dimension; a query's candidates are all rows of other ids, repeated rows included; query rows
of one id with different vectors are answered each by itself, equal ones once; ties go to the smaller id; at factor one
the result doesn't depend on the rows' order or partitions; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut, table

#: Rows of a shard, cells of the index, queries that meet a shard in one task, rows of a tree's leaf.
SHARD, LEAST_CELLS, MOST_CELLS, QUERY_BLOCK, LEAF = 16_384, 32, 1_024, 4_096, 128
K, FACTOR = 10, 1.0
#: Over the rounding of distances.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b, their squares summed in the order of the components."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[None, :, i]
        total += d * d
    return np.sqrt(total)


class Tree:
    """A vantage-point tree over `points` (n x d) with ids."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = points, ids
        self.nodes: list[tuple] = []  # (rows,) of a leaf or (vantage, lo/hi of inner, inner, lo/hi of outer, outer)
        self.root = self.build(np.arange(len(ids)))

    def build(self, rows: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append((rows,))
        if len(rows) <= LEAF:
            return me
        vantage = rows[0]
        d = distances(self.points[[vantage]], self.points[rows])[0]
        middle = np.median(d)
        inner = d <= middle
        if inner.all():  # many at one distance: an even cut is as good
            inner = np.arange(len(rows)) < len(rows) // 2
        sides = [(d[m].min(), d[m].max(), self.build(rows[m])) for m in (inner, ~inner)]
        self.nodes[me] = (vantage, *sides)
        return me

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances), each queries x k; -1 and inf where there are fewer candidates. What lies beyond `most` may be left out."""
        best, names = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)

        def visit(node: int, q: np.ndarray) -> None:
            if not len(q):
                return
            at = self.nodes[node]
            if len(at) == 1:
                rows = at[0]
                d = distances(queries[q], self.points[rows])
                ids = np.broadcast_to(self.ids[rows], d.shape)
                d = np.where(ids == own[q, None], np.inf, d)
                d, ids = np.concatenate((best[q], d), axis=1), np.concatenate((names[q], np.where(np.isinf(d), np.iinfo(np.int64).max, ids)), axis=1)
                order = np.lexsort((ids, d))[:, :k]
                best[q], names[q] = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)
                return
            vantage, *sides = at
            d = distances(queries[q], self.points[[vantage]])[:, 0]
            bounds = [np.maximum(0, np.maximum(lo - d, d - hi)) for lo, hi, _ in sides]
            first = bounds[0] <= bounds[1]
            # the nearer side first, then the other one where it can still matter
            for side, later in ((0, False), (1, False), (1, True), (0, True)):
                mine = first if (side == 0) != later else ~first
                able = mine & (bounds[side] * factor <= np.minimum(best[q, k - 1], most[q]) * (1 + SLACK) + SLACK)
                visit(sides[side][2], q[able])

        visit(self.root, np.arange(len(queries)))
        return np.where(np.isinf(best), -1, names), best


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, dim) of the rows that take part; v is double."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)").withColumn("dim", F.size("v"))


Pivots = dict[int, np.ndarray]  # by dimension


def in_cells(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """`rows` (id, v, dim) with cell, the nearest pivot's number (-1 in a dimension that has none), and gap, the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, gap = np.full(len(b), -1, np.int32), np.zeros(len(b))
            for dim, at in b.groupby("dim").indices.items():
                if dim in pivots:
                    d = distances(np.stack(b["v"].to_numpy()[at]), pivots[dim])
                    cell[at], gap[at] = d.argmin(axis=1), d.min(axis=1)
            yield b.assign(cell=cell, gap=gap)

    return rows.mapInPandas(run, "id long, v array<double>, dim int, cell int, gap double")


def answers(asked: DataFrame, index: DataFrame, k: int, factor: float, blocks: int) -> DataFrame:
    """(query_id, vec_id, score, q, cell, part): the best k of each shard; asked (dim, cell, part, block, id, q, v, most), index (dim, cell, part, id, v)."""
    schema = "query_id long, vec_id long, score double, q long, cell int, part int"

    def run(names: tuple, right: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "q": [], "cell": [], "part": []}).astype({"score": float})
        left = left.sort_values("id", kind="stable")
        own = right["id"].to_numpy()
        tree = Tree(np.stack(left["v"].to_numpy()), left["id"].to_numpy())
        ids, score = tree.search(np.stack(right["v"].to_numpy()), own, k, factor, right["most"].to_numpy(float))
        there = ~np.isinf(score)
        many = lambda x: np.repeat(x, k)[there.ravel()]
        return pd.DataFrame({"query_id": many(own), "vec_id": ids[there], "score": score[there], "q": many(right["q"].to_numpy()), "cell": names[1], "part": names[2]})

    keys = ["dim", "cell", "part", "block"]
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(run, schema)


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query that were found, by Euclidean distance."""
    index, asked = usable(rows, key, vector), cut(usable(queries, key, vector).distinct())
    n, q = index.count(), asked.count()
    cells, blocks = min(MOST_CELLS, max(LEAST_CELLS, n // SHARD)), max(1, -(-q // QUERY_BLOCK))
    sample = index.orderBy(F.xxhash64("id", "v"), "id", "v").limit(cells).collect()
    pivots = {dim: np.array([r.v for r in sample if r.dim == dim]) for dim in {r.dim for r in sample}}
    index = cut(in_cells(index, pivots))
    # a cell's rows are dealt over its shards by their place, as one id or vector may fill them
    known = index.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi")).collect()
    parts = {(r.dim, r.cell): -(-r.n // SHARD) for r in known}
    rings = {(r.dim, r.cell): (r.lo, r.hi) for r in known}
    several = [x for (dim, cell), m in parts.items() if m > 1 for x in (F.lit(f"{dim} {cell}"), F.lit(m))]
    many = F.coalesce(F.element_at(F.create_map(*several), F.concat_ws(" ", "dim", "cell")), F.lit(1)) if several else F.lit(1)
    index = index.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), many).cast("int")).select("dim", "cell", "part", "id", "v")

    def goes(batches: Iterator[pd.DataFrame], home: bool) -> Iterator[pd.DataFrame]:
        """The shards that each query visits: all of its own cell, or all of the other cells that may hold something nearer than `most`."""
        for b in batches:
            for dim, at in b.groupby("dim").indices.items():
                d = distances(np.stack(b["v"].to_numpy()[at]), pivots[dim]) if dim in pivots else np.zeros((len(at), 0))
                own = b["cell"].to_numpy()[at]
                for (of, cell), m in parts.items():
                    if of != dim:
                        continue
                    far = 0.0
                    if cell >= 0:
                        lo, hi = rings[of, cell]
                        far = np.maximum(0, np.maximum(lo - d[:, cell], d[:, cell] - hi))
                    wanted = own == cell if home else (own != cell) & (far * factor <= b["most"].to_numpy()[at] * (1 + SLACK) + SLACK)
                    for part in range(m):
                        yield b.iloc[at[wanted]].assign(cell=np.int32(cell), part=np.int32(part))[["dim", "cell", "part", "block", "id", "q", "v", "most"]]

    asked = in_cells(asked, pivots).withColumn("q", F.xxhash64("v")).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    visits = "dim int, cell int, part int, block int, id long, q long, v array<double>, most double"
    asked = cut(asked.withColumn("most", F.lit(float("inf"))).drop("gap"))
    first = cut(answers(asked.mapInPandas(lambda b: goes(b, True), visits), index, k, factor, blocks))
    # one shard's k-th best bounds the answer
    bound = first.groupBy("query_id", "q", "cell", "part").agg(F.max("score").alias("worst"), F.count("*").alias("n")).where(F.col("n") == k)
    bound = bound.groupBy(F.col("query_id").alias("id"), "q").agg(F.min("worst").alias("bound"))
    asked = asked.join(bound, ["id", "q"], "left").withColumn("most", F.coalesce("bound", F.lit(float("inf")))).drop("bound")
    found = first.unionByName(answers(asked.mapInPandas(lambda b: goes(b, False), visits), index, k, factor, blocks))
    best = W.partitionBy("query_id", "q").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0
), d AS (
  SELECT q.vec_id AS query_id, q.v AS q, c.vec_id AS vec_id,
    sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, q ORDER BY score, vec_id) AS rank, vec_id, score FROM d)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
