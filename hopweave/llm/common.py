"""Shared helpers of the training-data operators: reading, batches, lineage cuts, words, components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from hopweave.sources.lineage import cut, shared_folder

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, so that a batch of very long texts fits in a Python worker.

    The bound is the same for all operators and is only ever lowered, so plans of one session don't disturb each other.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def words(text):
    """Column: the array of words; empty for null and blank texts."""
    trimmed = F.expr(f"trim(BOTH '{SPACE_SQL}' FROM {text})") if isinstance(text, str) else text
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


SPACE_SQL = r" \t\n\u000b\f\r"


def n_words(text):
    """Column: the number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table written to the shared folder, for rows that take much less room in compressed columns than in a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Copies that one task makes of a row.
COPIES = 65_536


def copies_of(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Each row `count` times, numbered from 1 on in column `name`; `count` is dropped. `rows` is read twice: cut it first.

    Runs of over COPIES copies are dealt over the tasks before they are made, so a row that is repeated billions of
    times is no single task's work.
    """
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / COPIES)))
    few = rows.where(F.col(count).between(1, COPIES)).withColumn("run_", F.lit(0).cast("long"))
    many = rows.where(F.col(count) > COPIES).withColumn("run_", runs).repartition(F.col("run_"), F.col(count))
    first = F.col("run_") * COPIES
    own = F.explode(F.sequence(first + 1, F.least(first + COPIES, F.col(count))))
    return few.unionByName(many).withColumn(name, own).drop("run_", count)


def numbered(rows: DataFrame, names: list[str], place: str, name: str) -> DataFrame:
    """`rows` with a number from 1 on, in column `name`, among the rows that are equal in `names`.

    `place` is a monotonically increasing id. Rows are numbered inside their partition of the input and shifted by
    those of the partitions before, so a name that a third of all rows have is no single task's work.
    """
    rows = rows.withColumn("from_", F.call_function("shiftright", F.col(place), F.lit(33)))
    inside = F.row_number().over(W.partitionBy(*names, "from_").orderBy(place))
    before = F.coalesce(F.sum("n_").over(W.partitionBy(*names).orderBy("from_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy(*names, "from_").agg(F.count("*").alias("n_")).withColumn("before_", before)
    counts = counts.where("before_ > 0").withColumnsRenamed({c: f"{c}__" for c in [*names, "from_"]})
    same = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in [*names, "from_"]]
    out = rows.withColumn("inside_", inside).join(counts, same, "left")
    return out.withColumn(name, F.col("inside_") + F.coalesce("before_", F.lit(0))).drop("from_", "inside_", "n_", "before_", *(f"{c}__" for c in [*names, "from_"]))


#: Keys that `meet` broadcasts at most.
HEAVY = 2_048


def meet(rows: DataFrame, column: str, named: DataFrame, key: str, n: int) -> DataFrame:
    """`rows`, `n` in number, inner-joined with `named` (one row for a key) on column = key; the keys of both are longs.

    Keys that over n / HEAVY rows carry are fewer than HEAVY: their rows of `named` are broadcast, so they make no large
    task; the others are even enough for a join by shuffle.
    """
    heavy = rows.groupBy(F.col(column).alias("heavy_")).agg(F.count("*").alias("n_")).where(F.col("n_") > n // HEAVY).select("heavy_")
    of = lambda df, c, how: df.join(F.broadcast(heavy), F.col(c) == F.col("heavy_"), how)
    few = of(rows, column, "left_anti").join(named, F.col(column) == F.col(key))
    many = rows.join(F.broadcast(of(named, key, "left_semi")), F.col(column) == F.col(key))
    return few.unionByName(many)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of `edges` reaches.

    Each round hooks every node onto the smallest label among its neighbours, hands a label's own better label to all
    nodes that carry it, and then follows labels once more (pointer jumping), so the rounds grow with the logarithm of
    the longest chain; labels only fall, so it ends. Only min-aggregations (combined on the map side) and joins that
    broadcast their hubs are used; no group is gathered, and nothing but counts comes to the driver.
    """
    both = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    both = cut(both.union(both.select("v", "u")).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    n_edges, n_nodes = both.count(), labels.count()
    while True:
        near = meet(both, "v", labels, "node", n_edges).groupBy("u").agg(F.min("label").alias("near"))
        hooked = cut(labels.join(near, labels.node == near.u).select("node", "label", F.least("label", "near").alias("to")))
        up = hooked.groupBy("label").agg(F.min("to").alias("up")).select(F.col("label").alias("from"), "up")
        stepped = cut(meet(hooked, "label", up, "from", n_nodes).select("node", F.col("label").alias("old"), F.least("to", "up").alias("to")))
        jump = stepped.select(F.col("node").alias("at"), F.col("to").alias("beyond"))
        following = cut(meet(stepped, "to", jump, "at", n_nodes).select("node", "old", F.least("to", "beyond").alias("label")))
        labels = following.select("node", "label")
        if following.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
