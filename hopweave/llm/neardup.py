"""SimHash near-duplicate groups with BK-trees per shard.

Fingerprints: 64 bits, by majority over the XXH64 values (seed 42) of the 4-word shingles of the lower-cased
text, repeats included. Documents with equal fingerprints form a class at once. The bits are cut into radius + spare
blocks, and each choice of `spare` blocks is a table that deals the distinct fingerprints into shards by those blocks'
bits; two within the radius agree in at least `spare` blocks, so they meet in some shard. `spare` follows from the
number of fingerprints, so that an even shard holds few of them and no fingerprint is copied more often than there are
tables (at most 70). In a shard a BK-tree (children keyed by their Hamming distance to the parent) is built, and a
search follows only the edges d - radius .. d + radius. Shard and queries are the same rows, so the tree stays in the
task that builds it; sending all trees to all tasks would send the whole corpus. A shard answers with a spanning forest
of its links, never with all pairs: at most one row for each fingerprint. The forests are merged by distributed
components.

A shard of more than SHARD fingerprints is dealt further into parts; every two parts meet in a task of their
own, so a block value that a third of all fingerprints share is still searched whole, in tasks of bounded size.

Defined results: texts that are null or have no word get fingerprint zero and link like any other; rows with
equal ids are nodes of one id; classes of null ids link like any other, but a null id is never a component's smallest
while another id is in it; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, cut, meet, small_batches, table

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints that one tree holds at most.
SHARD = 1024
LANE = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, n: int = SHINGLE) -> list[int]:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII space
    if not w:
        return []
    if len(w) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    # shingles are slices of one buffer
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(w) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes lie one after another, sizes[i] of them each."""
    out = np.zeros(len(sizes), np.uint64)
    if not len(hashes):
        return out
    full = np.flatnonzero(sizes)
    begins = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    # eight 8-bit counters in a word hold 255 votes, so documents are summed in runs of 255
    runs = (sizes[full] + 254) // 255
    owner = np.repeat(np.arange(len(full)), runs)
    first = np.cumsum(runs) - runs
    at = begins[owner] + 255 * (np.arange(len(owner)) - first[owner])
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANE, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (counts[:, byte] * 2 > sizes[full]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(texts: pd.Series) -> np.ndarray:
    found = [shingle_hashes(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return majority(np.fromiter((h for x in found for h in x), np.uint64, int(sizes.sum())), sizes)


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "fp": fingerprints(b["text"]).view(np.int64)})

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(made, "key long, fp long").withColumnRenamed("key", key)


def bk_tree(fps: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, edge, at): a forest over fps in their order; roots[i] is the index of the first of i's tree.

    All open points go down a level together: of those that come to a node by the same distance, the first
    becomes the child and the others go on from it.
    """
    n = len(fps)
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    open_ = np.flatnonzero(roots != np.arange(n))
    at = roots[open_]
    while len(open_):
        key = at * 65 + np.bitwise_count(fps[open_] ^ fps[at])
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        child = open_[first]
        parent[child], edge[child] = at[first], key[first] % 65
        at = child[place]
        stay = at != open_
        open_, at = open_[stay], at[stay]
    # children of a node lie together in `order`, by rising edge
    key = np.where(parent >= 0, parent * 65 + edge, -1)
    return parent, edge, np.argsort(key, kind="stable")


def links(fps: np.ndarray, roots: np.ndarray, radius: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (later, earlier) of indices in one tree within the radius, in blocks of queries."""
    n = len(fps)
    parent, edge, order = bk_tree(fps, roots)
    keys = np.where(parent >= 0, parent * 65 + edge, -1)[order]
    sizes = np.diff(np.append(np.flatnonzero(np.r_[True, roots[1:] != roots[:-1]]), n))
    step = max(1, most // int(sizes.max(initial=1)))
    for begin in range(0, n, step):
        query = np.arange(begin, min(begin + step, n))
        node = roots[query]
        query, node = query[node != query], node[node != query]
        while len(query):
            d = np.bitwise_count(fps[query] ^ fps[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield query[near], node[near]
            lo = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), side="right")
            many = hi - lo
            query = np.repeat(query, many)
            node = order[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
            earlier = node < query  # a subtree holds only later points than its top
            query, node = query[earlier], node[earlier]


def forest(fps: np.ndarray, roots: np.ndarray, ids: np.ndarray, radius: int) -> pd.DataFrame:
    """(a, b): every id that has a link, with the smallest id that it reaches inside its tree."""
    label = np.arange(len(fps))
    pairs = [np.stack(p) for p in links(fps, roots, radius)]
    if not pairs:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    u, v = np.concatenate(pairs, axis=1)
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    label, by_rank = rank.copy(), np.sort(ids)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        # labels are ranks; a rank's own better label reaches its holders
        hop = np.empty_like(new)
        hop[rank] = new
        np.minimum.at(hop, label, new)
        new = np.minimum(new, hop[new])
        if (new == label).all():
            break
        label = new
    changed = by_rank[label] != ids
    return pd.DataFrame({"a": ids[changed], "b": by_rank[label][changed]})


def block_tables(radius: int, n: int, shard: int) -> list[list[tuple[int, int]]]:
    """The tables of `n` fingerprints: the bit ranges (from, until) whose values deal a table's rows into shards.

    The fewest blocks whose values are enough for even shards of half of `shard`.
    """
    for spare in (1, 2, 3, 4):
        m = radius + spare
        cuts = [(64 * i // m, 64 * (i + 1) // m) for i in range(m)]
        if spare == 4 or n <= shard // 2 << sum(b - a for a, b in cuts[:spare]):
            break
    return [list(chosen) for chosen in itertools.combinations(cuts, spare)]


def shard_links(classes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): spanning forests of the links between the distinct fingerprints of `classes` (fp, id), which is read twice."""
    tables = block_tables(radius, classes.count(), shard)

    def bucket(i: int, ranges: list[tuple[int, int]]) -> Column:
        out = F.lit(i).cast("long")
        for a, b in ranges:
            out = F.call_function("shiftleft", out, F.lit(b - a)).bitwiseOR(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        return out

    dealt = classes.select("fp", "id", F.explode(F.array(*(bucket(i, t) for i, t in enumerate(tables)))).alias("bucket"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = cut(sizes.select(F.col("bucket").alias("of"), F.ceil(F.col("n") * 2 / shard).cast("int").alias("parts"), "n"))
    dealt = meet(dealt, "bucket", parts, "of", classes.count() * len(tables))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # part p meets itself and each other one: tasks (p, q) with p <= q, of which own is one
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("own")).alias("p"), F.greatest(q, F.col("own")).alias("q")))
    whole = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
    dealt = dealt.withColumn("m", F.when(F.col("n") <= shard, whole).otherwise(met))
    tasks = dealt.select("fp", "id", "bucket", F.explode("m").alias("m")).select("fp", "id", "bucket", "m.p", "m.q")
    keys = ["bucket", "p", "q"]
    tasks = tasks.repartition(*keys).sortWithinPartitions(*keys, "fp")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def run(b: pd.DataFrame) -> pd.DataFrame:
            new = (b[keys].to_numpy()[1:] != b[keys].to_numpy()[:-1]).any(axis=1)
            first = np.flatnonzero(np.r_[True, new])
            roots = np.repeat(first, np.diff(np.append(first, len(b))))
            return forest(b["fp"].to_numpy().view(np.uint64), roots, b["id"].to_numpy(), radius)

        for b in batches:
            held.append(b)
            rows += len(b)
            if rows < 20_000:
                continue
            b = pd.concat(held, ignore_index=True)
            k = b[keys].to_numpy()
            whole_until = len(b) - int((k[::-1] != k[-1]).any(axis=1).argmax()) if (k != k[-1]).any() else 0
            if whole_until:
                yield run(b.iloc[:whole_until])
            held, rows = [b.iloc[whole_until:]], len(b) - whole_until
        if rows:
            yield run(pd.concat(held, ignore_index=True))

    return tasks.mapInPandas(search, "a long, b long")


def components(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component) of the distinct fingerprints of `classes` (fp, ...): the smallest fingerprint reachable."""
    parts = connected_components(shard_links(cut(classes.select("fp", F.col("fp").alias("id"))), radius))
    return classes.select("fp").join(parts, classes.fp == parts.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (the smallest key reachable, null where all are) of every row."""
    prints = cut(with_fingerprints(docs, key, text))
    classes = cut(prints.groupBy("fp").agg(F.min(key).alias("id")))
    parts = cut(classes.join(components(classes, radius), "fp"))
    least = parts.groupBy("component").agg(F.min("id").alias("component_id"))
    named = cut(meet(parts.drop("id"), "component", least.withColumnRenamed("component", "of"), "of", parts.count()).select(F.col("fp").alias("class"), "component_id"))
    return meet(prints, "fp", named, "class", prints.count()).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of `docs` of each group: that with the smallest key, null ones last; of rows with one key that with the smallest hash.

    Groups are named by their fingerprints and rows by their key and two hashes of all columns, so null and repeated
    keys lose no group. Only rows that are equal in everything have one name; of them one stays.
    """
    small_batches(docs.sparkSession)
    every = [F.col(f"`{c}`") for c in docs.columns]
    name = [F.col(key).isNull().alias("none_"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key_"), F.xxhash64(*every).alias("h_"), F.xxhash64(F.lit(7), *every).alias("g_")]
    names = ["none_", "key_", "h_", "g_"]

    @F.pandas_udf("long")
    def print_(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(texts).view(np.int64))

    prints = cut(docs.select(*name, print_(text).alias("fp")))
    classes = cut(prints.groupBy("fp").agg(F.min(F.struct(*names)).alias("first")))
    first = cut(classes.join(components(classes.select("fp"), radius), "fp").groupBy("component").agg(F.min("first").alias("first")).select("first.*"))
    return docs.select(F.struct("*").alias("doc_"), *name).join(first, names, "left_semi").dropDuplicates(names).select("doc_.*")


def op8(spark, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))
