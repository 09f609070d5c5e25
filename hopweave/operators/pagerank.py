"""Personalized page rank for many questions at once.

The walk starts evenly from all nodes, jumps back to a question's seeds with probability 1 - alpha and from dangling
nodes, and stops when it changes by less than n * tol; a question that doesn't get there in `max_iter` steps has no
ranks. A walk is the sum of two parts. What is left of the even start is the same for all questions, so it is computed
once. What came from the seeds is not zero only near them, so it is kept as sparse rows (qid, id). Neither part is
ever a table of questions times nodes, and small graphs (of checked size) are solved in memory where the questions are.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from hopweave.sources.lineage import cut

from .edges import both_ways

#: Graphs of up to so many nodes and directed edges are sent to the tasks.
SMALL_NODES, SMALL_EDGES = 50_000, 1_000_000
#: Questions that a node meets at a time, and rows of all questions and nodes that one task makes.
QUESTIONS, TASK_ROWS = 256, 4_194_304


def walk_edges(next_: DataFrame, related: DataFrame, co: DataFrame) -> DataFrame:
    """(src, dst): the undirected edges of the walk, once for each direction."""
    every = next_.select("src", "dst").union(related.select("src", "dst")).union(co.select("src", "dst"))
    return both_ways(every.where("src <> dst")).distinct()


def co_mention_edges(mentioned: DataFrame, most: int | None = 500) -> DataFrame:
    """(src, dst): pairs of chunks that share an entity, the first `most` of them in order.

    The pairs that come first have the smallest ends, so of a name only its first most + 1 chunks can be in one.
    """
    from .mentions import first_mentions

    few = first_mentions(mentioned, most + 1) if most else mentioned.select("name", "chunk_id")
    a, b = few.withColumnRenamed("chunk_id", "src"), few.withColumnRenamed("chunk_id", "dst")
    if most:  # sources before which a name already has `most` pairs aren't needed
        k, n = F.row_number().over(W.partitionBy("name").orderBy("src")), F.count("*").over(W.partitionBy("name"))
        a = a.withColumn("k", k).withColumn("n", n).where((F.col("k") - 1) * F.col("n") - F.col("k") * (F.col("k") - 1) / 2 < most).drop("k", "n")
    pairs = a.join(b, "name").where("src < dst").select("src", "dst").distinct()
    return pairs.orderBy("src", "dst").limit(most) if most else pairs


def solve(src: np.ndarray, dst: np.ndarray, n: int, seeds: np.ndarray, alpha: float, max_iter: int, tol: float) -> np.ndarray | None:
    """Ranks of one question over nodes 0..n-1; `seeds` adds up to one."""
    degree = np.bincount(src, minlength=n)
    share = 1 / np.maximum(degree, 1)
    x = np.full(n, 1 / n)
    for _ in range(max_iter):
        before = x
        x = alpha * (np.bincount(dst, weights=(before * share)[src], minlength=n) + before[degree == 0].sum() * seeds) + (1 - alpha) * seeds
        if np.abs(x - before).sum() < n * tol:
            return x
    return None


def scaled(x: np.ndarray) -> np.ndarray:
    lo, hi = x.min(), x.max()
    return (x - lo) / (hi - lo) if hi > lo else x


def spread(rows: DataFrame, edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What each node gets from its neighbours' `value`; `edges`: (src, dst, share)."""
    moved = rows.join(edges, rows.id == edges.src).groupBy(*keys, F.col("dst")).agg(F.sum(F.col(value) * F.col("share")).alias("got"))
    return moved.withColumnRenamed("dst", "id")


def everywhere(even: DataFrame, own: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id, x) of all `questions` (qid) and all nodes of `even` (id, u): u, or what `own` (qid, id, x) has instead.

    The rows of `own` are gathered by node and block of questions, and every node meets the blocks inside a task, so that
    the result is never shuffled, however large it is.
    """
    questions = cut(questions.select("qid").distinct())
    n, m = even.count(), questions.count()
    block = F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-m // QUESTIONS)))).cast("int").alias("block")
    blocks = questions.groupBy(block).agg(F.sort_array(F.collect_list("qid")).alias("qids"))
    held = own.groupBy("id", block).agg(F.map_from_entries(F.collect_list(F.struct("qid", "x"))).alias("x"))
    held = held.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("block", "x"))).alias("own"))
    rows = even.select("id", "u").join(held, "id", "left").repartition(max(1, -(-n * m // TASK_ROWS)), "id").crossJoin(F.broadcast(blocks))
    rows = rows.select("id", "u", F.try_element_at("own", "block").alias("own"), "qids").select("id", "u", "own", F.explode("qids").alias("qid"))
    return rows.select("qid", "id", F.coalesce(F.try_element_at("own", "qid"), "u").alias("x"))


class Ranks(ABC):
    """Ranks of some questions, to be looked up for pairs (qid, id)."""

    @abstractmethod
    def of(self, wanted: DataFrame) -> DataFrame:
        """(qid, id, ppr), scaled to 0..1 over the graph; 0 for ids that it doesn't have, no row for questions without ranks."""

    @abstractmethod
    def everywhere(self, questions: DataFrame) -> DataFrame:
        """(qid, id, ppr) of all nodes for the `questions` (qid) that have ranks."""


class NoRanks(Ranks):
    def of(self, wanted: DataFrame) -> DataFrame:
        return wanted.select("qid", "id", F.lit(0.0).alias("ppr")).limit(0)

    def everywhere(self, questions: DataFrame) -> DataFrame:
        return questions.select("qid", F.lit("").alias("id"), F.lit(0.0).alias("ppr")).limit(0)


class SmallRanks(Ranks):
    """The graph goes to the tasks, and each question is solved where it is looked up."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float, max_iter: int, tol: float):
        self.ids = sorted(r.id for r in nodes.collect())
        at = {x: i for i, x in enumerate(self.ids)}
        pairs = edges.toPandas()
        self.src, self.dst = (pairs[c].map(at).to_numpy(np.int64) for c in ("src", "dst"))
        self.seeds, self.how = seeds, (alpha, max_iter, tol)

    def solved(self, start: pd.DataFrame, at: dict[str, int]) -> np.ndarray | None:
        """Scaled ranks of the question with these seeds, if it has any and settles."""
        p = np.zeros(len(at))
        for i, w in zip(start["id"], start["weight"], strict=True):
            if i in at:
                p[at[i]] += w
        x = solve(self.src, self.dst, len(at), p / p.sum(), *self.how) if p.sum() > 0 else None
        return None if x is None else scaled(x)

    def of(self, wanted: DataFrame) -> DataFrame:
        ids, graph, kind = self.ids, self.carried(), self.seeds.schema["qid"].dataType.simpleString()
        at = {x: i for i, x in enumerate(ids)}

        def run(start: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            x = graph.solved(start, at) if len(start) and len(asked) else None
            if x is None:
                return pd.DataFrame({"qid": [], "id": [], "ppr": []}, dtype=object)
            asked = asked.drop_duplicates("id")
            return pd.DataFrame({"qid": asked["asked"].to_list(), "id": asked["id"].to_list(), "ppr": [float(x[at[i]]) if i in at else 0.0 for i in asked["id"]]})

        # new columns: what is wanted may come from the seeds themselves
        wanted = wanted.select(F.col("qid").alias("asked"), F.col("id").alias("id"))
        return self.seeds.groupBy("qid").cogroup(wanted.groupBy("asked")).applyInPandas(run, f"qid {kind}, id string, ppr double")

    def everywhere(self, questions: DataFrame) -> DataFrame:
        ids, graph, kind = self.ids, self.carried(), self.seeds.schema["qid"].dataType.simpleString()
        at = {x: i for i, x in enumerate(ids)}

        def run(start: pd.DataFrame) -> pd.DataFrame:
            x = graph.solved(start, at)
            if x is None:
                return pd.DataFrame({"qid": [], "id": [], "ppr": []}, dtype=object)
            return pd.DataFrame({"qid": start["qid"].iloc[0], "id": ids, "ppr": x})

        seeds = self.seeds.join(questions.select("qid").distinct(), "qid", "left_semi")
        return seeds.groupBy("qid").applyInPandas(run, f"qid {kind}, id string, ppr double")

    def carried(self) -> SmallRanks:
        """The graph without what only the driver has."""
        graph = object.__new__(SmallRanks)
        graph.src, graph.dst, graph.how = self.src, self.dst, self.how
        return graph


class LargeRanks(Ranks):
    """Sparse rows near the seeds and one even part, a table of each for every step at which questions settle."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float, max_iter: int, tol: float):
        self.parts: list[tuple[DataFrame, DataFrame, DataFrame]] = []  # (qid, id, x), (id, u), (qid, lo, hi)
        n = nodes.count()
        edges = cut(edges.join(edges.groupBy("src").agg((1 / F.count("*")).alias("share")), "src"))
        dangling = cut(nodes.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
        seeds = seeds.join(nodes, "id", "left_semi").select("qid", "id", "weight")
        seeds = cut(seeds.join(seeds.groupBy("qid").agg(F.sum("weight").alias("total")), "qid").select("qid", "id", (F.col("weight") / F.col("total")).alias("p")))
        u, s, open_ = cut(nodes.withColumn("u", F.lit(1 / n))), seeds.select("qid", "id", F.lit(0.0).alias("s")), cut(seeds.select("qid").distinct())
        lost = dangling.count() / n  # of the even part: gone after the first step, as dangling nodes get nothing
        for _ in range(max_iter):
            u_next = cut(nodes.join(spread(u, edges, [], "u"), "id", "left").select("id", (alpha * F.coalesce("got", F.lit(0.0))).alias("u")))
            s = s.join(open_, "qid", "left_semi")
            lost_s = s.join(dangling, "id").groupBy("qid").agg(F.sum("s").alias("lost"))
            jump = (1 - alpha) + alpha * (lost + F.coalesce("lost", F.lit(0.0)))
            into = seeds.join(open_, "qid", "left_semi").join(lost_s, "qid", "left").select("qid", "id", (F.col("p") * jump).alias("v"))
            moved = spread(s, edges, ["qid"], "s").select("qid", "id", (alpha * F.col("got")).alias("v"))
            s_next = cut(into.unionByName(moved).groupBy("qid", "id").agg(F.sum("v").alias("s")))
            evens = cut(u_next.join(u.withColumnRenamed("u", "u_old"), "id"))
            even = evens.agg(F.sum(F.abs(F.col("u") - F.col("u_old")))).first()[0]
            both = s_next.join(s.withColumnRenamed("s", "s_old"), ["qid", "id"], "left").join(evens, "id")
            moved_by = F.abs(F.col("s") + F.col("u") - F.coalesce("s_old", F.lit(0.0)) - F.col("u_old")) - F.abs(F.col("u") - F.col("u_old"))
            change = both.groupBy("qid").agg((F.sum(moved_by) + even).alias("change"))
            settled = cut(change.where(F.col("change") < n * tol).select("qid"))
            if not settled.isEmpty():
                x = cut(s_next.join(settled, "qid", "left_semi").join(u_next, "id").select("qid", "id", (F.col("s") + F.col("u")).alias("x")))
                self.parts.append((x, u_next, cut(ends(x, u_next))))
                open_ = cut(open_.join(settled, "qid", "left_anti"))
                if open_.isEmpty():
                    break
            u, s, lost = u_next, s_next, 0.0

    def of(self, wanted: DataFrame) -> DataFrame:
        out, wanted = NoRanks().of(wanted), wanted.select("qid", "id").distinct()
        for x, u, bounds in self.parts:
            got = wanted.join(bounds, "qid").join(x, ["qid", "id"], "left").join(u, "id", "left")
            value = F.coalesce("x", "u")
            ppr = F.when(F.col("hi") > F.col("lo"), (value - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(value)
            out = out.unionByName(got.select("qid", "id", F.coalesce(ppr, F.lit(0.0)).alias("ppr")))
        return out

    def everywhere(self, questions: DataFrame) -> DataFrame:
        out, questions = NoRanks().everywhere(questions), questions.select("qid").distinct()
        for x, u, bounds in self.parts:
            bounds = cut(bounds.join(questions, "qid", "left_semi"))
            rows = everywhere(u, x.select("qid", "id", "x"), bounds).join(F.broadcast(bounds), "qid")
            ppr = F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("x"))
            out = out.unionByName(rows.select("qid", "id", ppr.alias("ppr")))
        return out


def ends(x: DataFrame, u: DataFrame) -> DataFrame:
    """(qid, lo, hi) over all nodes: those with a row in `x`, and the best of those that only have their even part.

    Of nodes in the order of their even part, the first one without a row bounds the rest; it is among the first
    m + 1 where a question has at most m rows.
    """
    own = x.groupBy("qid").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("m"))
    m = own.agg(F.max("m")).first()[0]
    for name, order in (("lo", F.asc("u")), ("hi", F.desc("u"))):
        first = u.orderBy(order, "id").limit(m + 1).withColumn("r", F.row_number().over(W.orderBy(order, "id")))
        first = cut(first.select("id", F.col("u").alias("rest"), "r"))
        held = x.join(first, "id").withColumn("k", F.row_number().over(W.partitionBy("qid").orderBy("r")))
        gap = held.where("r = k").groupBy("qid").agg((F.max("r") + 1).alias("r"))
        at = own.select("qid").join(gap, "qid", "left").select("qid", F.coalesce("r", F.lit(1)).alias("r"))
        rest = at.join(first.select("r", "rest"), "r", "left").select("qid", "rest")
        pick = F.least if name == "lo" else F.greatest  # both skip the null where no node is left
        own = own.join(rest, "qid").withColumn(name, pick(name, "rest")).drop("rest")
    return own.select("qid", "lo", "hi")


def ranks(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, max_iter: int = 30, tol: float = 1e-4, small: tuple[int, int] = (SMALL_NODES, SMALL_EDGES)) -> Ranks:
    """Ranks of the questions that have seeds and settle. `nodes`: (id); `edges`: (src, dst) both ways; `seeds`: (qid, id, weight)."""
    nodes = nodes.select("id").distinct()
    edges = edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    edges = cut(edges.select("src", "dst"))
    n, m = nodes.count(), edges.count()
    if not n or not m:
        return NoRanks()
    kind = SmallRanks if n <= small[0] and m <= small[1] else LargeRanks
    return kind(nodes, edges, seeds, alpha, max_iter, tol)


def rank_steps(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, steps: int, alpha: float = 0.85, places: int | None = None) -> DataFrame:
    """(qid, id, x) after `steps` steps from an even start, over a graph whose nodes without edges pass nothing on.

    `nodes`: (id); `edges`: (src, dst) both ways; `seeds`: (qid, id, weight). A node has a row if it has an edge or is a
    seed of that question. The even part is walked once for all questions, what comes from seeds as sparse rows. With
    `places` x is rounded, the even part once for all questions.
    """
    edges = cut(edges.join(edges.groupBy("src").agg((1 / F.count("*")).alias("share")), "src"))
    times = cut(seeds.groupBy("qid").agg(F.count("*").alias("times")))  # a question that comes twice walks twice
    into = cut(seeds.join(times, "qid").groupBy("qid", "id").agg(F.sum((1 - alpha) * F.col("weight") / F.col("times")).alias("v")))
    n = nodes.count()
    u, s = nodes.groupBy("id").agg((F.count("*") / n).alias("u")), into.select("qid", "id", F.lit(0.0).alias("s"))
    for _ in range(steps):
        u = cut(spread(u, edges, [], "u").select("id", (alpha * F.col("got")).alias("u")))
        moved = spread(s, edges, ["qid"], "s").select("qid", "id", (alpha * F.col("got")).alias("v"))
        s = cut(moved.unionByName(into).groupBy("qid", "id").agg(F.sum("v").alias("s")))
    own = cut(s.join(u, "id", "left").select("qid", "id", (F.col("s") + F.coalesce("u", F.lit(0.0))).alias("x"), F.col("u").isNull().alias("alone")))
    shown = lambda x: x if places is None else F.round(x, places)
    once = times.where("times > 1").isEmpty()
    if once:
        u, own = u.withColumn("u", shown(F.col("u"))), own.withColumn("x", shown(F.col("x")))
    every = everywhere(u, own.where("NOT alone"), times).unionByName(own.where("alone").select("qid", "id", "x"))
    return every if once else every.join(F.broadcast(times), "qid").select("qid", "id", shown(F.col("x") * F.col("times")).alias("x"))
