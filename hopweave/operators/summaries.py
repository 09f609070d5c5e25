"""Summary trees: chunks of a title in clusters, a summary for each cluster, and one over several of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hopweave.config import Config
from hopweave.functions.text import block, flat, left, strip, summarize
from hopweave.sources.lineage import cut

DEFAULT = Config()
#: Chunks of a title that one task clusters; longer titles are clustered by the same rule in sums over all tasks.
MOST_CHUNKS, ITERATIONS, SEED = 10_000, 25, 13


def cluster_count(n, config: Config = DEFAULT):
    """Column: between one and `max_clusters`, about one for every `cluster_size` chunks."""
    return F.greatest(F.lit(1), F.least(F.floor(n / config.cluster_size), F.lit(config.max_clusters))).cast("int")


def start(n: int) -> int:
    """How far behind a title's first position its first centre is looked for."""
    return int(np.random.default_rng(SEED).integers(n))


def k_means(x: np.ndarray, k: int, first: int) -> np.ndarray:
    """Labels by Lloyd's rounds from spread-out rows, row `first` and those farthest from the ones before."""
    centres = [x[first]]
    for _ in range(k - 1):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[far.argmax()])
    c = np.array(centres)
    labels = np.zeros(len(x), int)
    for _ in range(ITERATIONS):
        new = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[new == i].mean(axis=0) if (new == i).any() else c[i] for i in range(k)])
        if (new == labels).all():
            break
        labels = new
    return labels


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)


def by_title(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(title, places in the batch, vectors) of rows (title, v, ...)."""
    titles = b["title"].to_pandas()
    for title, at in titles.groupby(titles, sort=False).indices.items():
        yield title, at, b["v"].take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)


def farthest(live: DataFrame, centres: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of each title the row that is farthest from its nearest centre, the first of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[float, int, np.ndarray]] = {}
        for b in batches:
            for title, at, x in by_title(b):
                if title in centres:
                    d, pos = np.min([((x - c) ** 2).sum(axis=1) for c in centres[title]], axis=0), b["pos"].to_numpy()[at]
                    i = np.lexsort((pos, -d))[0]
                    best[title] = max(best.get(title, (-1.0, 0, x[i])), (d[i], -pos[i], x[i]), key=lambda t: t[:2])
        if best:
            yield pa.RecordBatch.from_pydict({"title": list(best), "d": [float(t[0]) for t in best.values()], "before": [int(t[1]) for t in best.values()], "v": [t[2].tolist() for t in best.values()]})

    rows = live.select("title", "pos", "v").mapInArrow(run, "title string, d double, before long, v array<double>").collect()
    return {r.title: np.array(r.v) for r in sorted(rows, key=lambda r: (r.d, r.before))}


def moved_sums(live: DataFrame, centres: dict[str, np.ndarray], before: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
    """(sums and counts of each centre's rows, rows that were at another one before) of each title in `centres`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            for title, _, x in by_title(b):
                if title in centres:
                    c = centres[title]
                    new, old = closest(x, c), closest(x, before[title]) if title in before else 0
                    sums, counts, moved = held.get(title, (np.zeros(c.shape), np.zeros(len(c), np.int64), 0))
                    sums = sums + np.array([x[new == i].sum(axis=0) for i in range(len(c))])
                    held[title] = sums, counts + np.bincount(new, minlength=len(c)), moved + int((new != old).sum())
        if held:
            yield pa.RecordBatch.from_pydict({"title": list(held), "sums": [t[0].ravel().tolist() for t in held.values()], "counts": [t[1].tolist() for t in held.values()], "moved": [t[2] for t in held.values()]})

    out: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}
    for r in live.select("title", "v").mapInArrow(run, "title string, sums array<double>, counts array<long>, moved long").collect():
        sums, counts, moved = out.get(r.title, (0.0, 0, 0))
        out[r.title] = sums + np.array(r.sums).reshape(len(r.counts), -1), counts + np.array(r.counts), moved + r.moved
    return out


def large_k_means(rows: DataFrame, most: int) -> DataFrame:
    """(title, chunk_id, pos, cluster) of (title, chunk_id, pos, v, k, target): `k_means` for titles that no task holds.

    A round is one pass over all rows, of which each task returns its sums; at most `most` centres a title go to the
    tasks. A title whose rows stay where they are takes no further part.
    """
    size = F.coalesce(F.size("v"), F.lit(-1))
    kinds = rows.groupBy("title").agg((F.max(F.col("v").isNull()) | (F.min(size) != F.max(size)) | (F.max(size) < 1)).alias("one"))
    rows = cut(rows.join(F.broadcast(kinds), "title").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "chunk_id"))
    plain = rows.where("one").select("title", "chunk_id", "pos", F.lit(0).alias("cluster"))
    live = rows.where("NOT one").select("title", "chunk_id", "pos", "v", "k", "target")
    first = live.groupBy("title").agg(F.first("k").alias("k"), F.max_by("v", F.when(F.col("pos") <= F.col("target"), F.struct("pos", "chunk_id"))).alias("v")).collect()
    if not first:
        return plain
    sizes, centres = {r.title: r.k for r in first}, {r.title: np.array([r.v]) for r in first}
    for _ in range(most - 1):
        far = farthest(live, {t: c for t, c in centres.items() if len(c) < sizes[t]})
        centres |= {t: np.vstack([centres[t], v]) for t, v in far.items()}
    open_, before = dict(centres), {}
    for _ in range(ITERATIONS):
        found = moved_sums(live, open_, before)
        before |= open_  # labels are those of the last round's own centres, as in k_means
        means = {t: np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], open_[t]) for t, (s, n, _) in found.items()}
        open_ = {t: means[t] for t, (_, _, moved) in found.items() if moved}
        if not open_:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = np.zeros(b.num_rows, np.int32)
            for title, at, x in by_title(b):
                labels[at] = closest(x, before[title])
            yield pa.RecordBatch.from_arrays([b["title"], b["chunk_id"], b["pos"], pa.array(labels)], ["title", "chunk_id", "pos", "cluster"])

    return live.select("title", "chunk_id", "pos", "v").mapInArrow(run, "title string, chunk_id string, pos long, cluster int").unionByName(plain)


def clusters(chunks: DataFrame, config: Config = DEFAULT, embedding: str = "embedding") -> DataFrame:
    """(title, chunk_id, pos, cluster) of (title, chunk_id, pos, embedding); clusters are below `max_clusters`."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("pos", kind="stable")
        k = int(b["k"].iloc[0])
        one = b["v"].isna().any() or len({len(v) for v in b["v"]}) > 1
        pos = b["pos"].to_numpy()
        labels = np.zeros(len(b), int) if k == 1 or one else k_means(np.stack(b["v"].to_numpy()), k, int(np.searchsorted(pos, pos[0] + start(len(b)), side="right")) - 1)
        return pd.DataFrame({"title": b["title"].to_list(), "chunk_id": b["chunk_id"].to_list(), "pos": b["pos"].to_list(), "cluster": labels})

    @F.pandas_udf("long")
    def starts(n: pd.Series) -> pd.Series:
        return n.map(start)

    sizes = chunks.groupBy("title").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rows = chunks.select("title", "chunk_id", "pos", F.col(embedding).cast("array<double>").alias("v")).join(sizes, "title")
    rows = rows.withColumn("k", cluster_count(F.col("n"), config))
    # a title with one cluster needs no model
    several = rows.where("k > 1")
    small = several.where(F.col("n") <= MOST_CHUNKS).groupBy("title").applyInPandas(run, "title string, chunk_id string, pos long, cluster int")
    out = rows.where("k = 1").select("title", "chunk_id", "pos", F.lit(0).alias("cluster")).unionByName(small)
    large = sizes.where(F.col("n") > MOST_CHUNKS)
    if config.max_clusters < 2 or large.isEmpty():
        return out
    large = cut(large.select("title", (F.col("first") + starts("n")).alias("target")))
    wide = several.where(F.col("n") > MOST_CHUNKS).join(F.broadcast(large), "title").select("title", "chunk_id", "pos", "v", "k", "target")
    return out.unionByName(large_k_means(wide, config.max_clusters))


def cluster_texts(chunks: DataFrame, clustered: DataFrame) -> DataFrame:
    """(title, cluster, n_chunks, text): the texts of a cluster in order, blanks between."""
    rows = chunks.select("chunk_id", "text").join(clustered, "chunk_id")
    return rows.groupBy("title", "cluster").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t")).select("title", "cluster", "n_chunks", F.array_join("t.text", " ").alias("text"))


def generated(rows: DataFrame, summarizer, config: Config = DEFAULT) -> DataFrame:
    """`rows` (text, hint, ...) with summary: long texts by the model, which gets their beginning, others by rule.

    A null reply is an error: the text's own beginning stands in. With `summary_echo` short texts are their own
    summaries. Empty texts have empty ones.
    """
    text, hint = F.col("text"), F.col("hint")
    clean = strip(flat(text))
    body, short = (clean, F.when(text == "", "").otherwise(block(hint, clean))) if config.summary_echo else (text, summarize(text, hint))
    long_ = F.coalesce(F.length(text) >= config.summary_least, F.lit(False))
    told = summarizer.summarize(rows.where(long_).withColumn("head_", left(text, config.summary_chars)), "head_", "hint", "reply_")
    failed = F.concat(left(body, config.summary_error_chars), F.lit("..."))
    told = told.withColumn("summary", block(hint, F.coalesce("reply_", failed))).drop("head_", "reply_")
    return told.unionByName(rows.where(~long_).withColumn("summary", F.coalesce(short, F.lit(""))))


def summary_tree(chunks: DataFrame, clustered: DataFrame, summarizer=None, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """((id, text, level, title), (source, target, type)): first-level summaries, and a second level over more than one."""
    title, cluster = F.col("title"), F.col("cluster").cast("string")

    def written(rows: DataFrame) -> DataFrame:
        if summarizer is None:
            return rows.withColumn("text", summarize(F.col("text"), F.col("hint"))).drop("hint")
        return cut(generated(rows, summarizer, config).withColumn("text", F.col("summary")).drop("summary", "hint"))

    l1_id = F.concat(F.lit("summary_l1_"), title, F.lit("_"), cluster)
    first = written(cluster_texts(chunks, clustered).select(l1_id.alias("id"), "text", title.alias("hint"), F.lit(1).alias("level"), "title", "cluster"))
    l2_id = F.concat(F.lit("summary_l2_"), title)
    over = first.groupBy("title").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("cluster", "text", "id"))).alias("c")).where("n > 1")
    second = written(over.select(l2_id.alias("id"), F.array_join("c.text", "\n").alias("text"), F.concat(F.lit("Overall summary for "), title).alias("hint"), F.lit(2).alias("level"), "title"))
    nodes = first.drop("cluster").unionByName(second)
    to_chunks = clustered.select(l1_id.alias("source"), F.col("chunk_id").alias("target"), F.lit("CONTAINS_CHUNK").alias("type"))
    to_first = over.select(l2_id.alias("source"), F.explode("c.id").alias("target"), F.lit("CONTAINS_SUMMARY").alias("type"))
    return nodes, to_chunks.unionByName(to_first)
