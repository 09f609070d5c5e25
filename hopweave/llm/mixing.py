"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the mean number of copies of each of its documents: a whole part that all
get and a fraction that is rounded. Rounding pairs two fractional documents and moves words between them at
random, so that the words of both together and each one's expected copies stay the same, until one of them is
integral. The other goes on to the next pair. A group leaves at most one fractional document; those residuals
meet in a reduction tree of fixed fan-in, and the last one of a source is drawn by its own probability.
So a source's taken words differ from its target by less than the words of one document.

Everything runs in the JVM: a group is an array of about GROUP structs and its pairs are one aggregate over it.
A document leaves the tree where it becomes integral and carries its columns along, so nothing is joined back.
Random numbers are hashes of the document and the tree's level, and a group's documents are put in order first:
reruns agree, whatever the partitions.

Defined results: null sources form one source, last in order; null, empty and blank texts have size 0 and take 0
words; repeated rows are drawn one by one; a source that holds a third of all rows is rounded by as many groups as
its rows need; there may be any number of sources; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hopweave.functions.arrays import let
from hopweave.operators.ids import dense_index

from .common import copies_of, cut, n_words, table

WEIGHTS, MOST_REPEATS = (5, 2, 1), 3.0
#: Documents a group rounds, and residuals that a node of the tree combines.
GROUP, FAN_IN = 512, 64
#: Catalogues of up to this many sources are broadcast; longer ones are joined by their key.
BROADCAST_SOURCES = 100_000
SLACK = 1e-9


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_rows, source_size, target) of every source of `sized` (source, rows, size); the null source is last.

    Shares of the whole size by weight, none over `most` times its source; the excess is shared anew by weight until
    none is above. The catalogue stays distributed; each round brings three sums to the driver.
    """
    of = sized.groupBy("source").agg(F.sum("rows").alias("source_rows"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    # the first seven bytes as a number deal a long catalogue into ranges
    begin = F.conv(F.rpad(F.hex(F.substring(F.col("source").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    of = cut(of.withColumn("first_", F.coalesce(begin, F.lit(1 << 60))))
    ranked = dense_index(of, ["first_", "source"], "spot")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("spot") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight).drop("first_", "spot"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    left, open_weight, held = float(total), ranked.agg(F.sum("weight")).first()[0] or 0.0, 0
    while open_weight:
        share = F.lit(left) * F.col("weight") / F.lit(open_weight)
        over = share > most * F.col("source_size")
        got = ranked.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most * F.col("source_size"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if got["n"] == held:
            break
        # a source over its share stays so, as shares only grow
        held, left, open_weight = got["n"], total - got["capped"], got["open"] or 0.0
    share = F.lit(left) * F.col("weight") / F.lit(open_weight) if open_weight else F.lit(float("inf"))
    return ranked.select("source", "source_rows", "source_size", F.least(share, most * F.col("source_size")).alias("target"))


ITEM = "struct<size:long,key:long,text_hash:long,other_hash:long,nth:long,p:double,draw:double>"
DONE = "struct<item:" + ITEM + ",up:boolean>"


def snapped(p: Column) -> Column:
    return F.when(p <= SLACK, F.lit(0.0)).when(p >= 1 - SLACK, F.lit(1.0)).otherwise(p)


def paired(held: Column, item: Column) -> Column:
    """(p of the held document, p of the item) after words moved between them; at least one of the two is integral."""
    a, b = held["p"], item["p"]
    m, n = held["size"].cast("double"), item["size"].cast("double")
    ways = F.struct(F.least((1 - a) * m, b * n).alias("up"), F.least(a * m, (1 - b) * n).alias("down"))
    moved = let(ways, lambda w: F.when(item["draw"] * (w["up"] + w["down"]) < w["down"], w["up"]).otherwise(-w["down"]))
    return let(moved, lambda words: F.struct(snapped(a + words / m).alias("a"), snapped(b - words / n).alias("b")))


def pivots(items: Column) -> Column:
    """struct(held, done): an array of items (ITEM) rounded one pair after another; `held` is the fractional rest, or null."""

    def out(item: Column, p: Column) -> Column:
        return F.struct(item.alias("item"), (p > 0.5).alias("up")).cast(DONE)

    def with_p(item: Column, p: Column) -> Column:
        return item.withField("p", p)

    def step(acc: Column, item: Column) -> Column:
        held, done = acc["held"], acc["done"]

        def after(ps: Column) -> Column:
            whole_a, whole_b = (ps["a"] == 0) | (ps["a"] == 1), (ps["b"] == 0) | (ps["b"] == 1)
            rest = F.when(~whole_b, with_p(item, ps["b"])).when(~whole_a, with_p(held, ps["a"])).cast(ITEM)
            gone = F.when(whole_a & whole_b, F.array(out(held, ps["a"]), out(item, ps["b"]))).when(whole_a, F.array(out(held, ps["a"]))).otherwise(F.array(out(item, ps["b"])))
            return F.struct(rest.alias("held"), F.concat(done, gone).alias("done"))

        first = F.struct(item.cast(ITEM).alias("held"), done.alias("done"))
        return F.when(held.isNull(), first).otherwise(let(paired(held, item), after))

    none = F.struct(F.lit(None).cast(ITEM).alias("held"), F.array().cast(f"array<{DONE}>").alias("done"))
    return F.aggregate(items, none, step)


#: What a source's documents have in common.
SHARED = ["source", "source_size", "target", "whole"]
#: The name of a document, and its place among the rows that are equal in all of these.
NAME = ["key", "text_hash", "other_hash", "nth"]


def round_groups(rows: DataFrame, level: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """(rounded rows with `up`, each group's rest with its `node`) of rows (SHARED, node, NAME, size, p with 0 < p < 1)."""
    unit = lambda *more: F.shiftrightunsigned(F.xxhash64("source", *NAME, F.lit(level), *more), 11) / float(1 << 53)
    item = F.struct("size", *NAME, "p", unit().alias("draw")).cast(ITEM)
    groups = rows.groupBy(*SHARED, "node").agg(F.sort_array(F.collect_list(item)).alias("items"))
    groups = cut(groups.select(*SHARED, "node", pivots(F.col("items")).alias("r")).select(*SHARED, "node", "r.held", "r.done"))
    done = groups.select(*SHARED, F.explode("done").alias("d")).select(*SHARED, "d.item.*", "d.up").drop("p", "draw")
    rest = groups.where("held IS NOT NULL").select(*SHARED, "node", "held.*").drop("draw")
    if last:
        return done.unionByName(rest.withColumn("up", unit(F.lit(1)) < F.col("p")).drop("p", "node")), rest.limit(0)
    return done, rest


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(key, source, text_hash, other_hash, nth, size, source_size, target, copies) for each row of `docs`; `nth` tells repeated rows apart."""
    sized = docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), *text_hashes(text))
    # equal rows are told apart by a number; only how many there are matters, so any order of them will do
    sized = cut(sized.groupBy("key", "source", "size", "text_hash", "other_hash").agg(F.count("*").alias("rows")))
    goal = cut(source_targets(sized, weights, most)).withColumnRenamed("source", "of")
    known = goal.agg(F.count("*").alias("n"), F.max("source_rows").alias("most")).first()
    rows = sized.join(F.broadcast(goal) if known["n"] <= BROADCAST_SOURCES else goal, sized.source.eqNullSafe(goal.of)).drop("of")
    rows = copies_of(rows, "rows", "nth")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + SLACK)).withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    fractional = (F.col("size") > 0) & (F.col("p") > SLACK)
    out = rows.where(~fractional).select(*SHARED, *NAME, "size", F.lit(False).alias("up"))
    # each source has as many groups as its rows need, so groups are of even size
    node = F.pmod(F.xxhash64("source", *NAME), F.ceil(F.col("source_rows") / GROUP))
    open_ = rows.where(fractional).select(*SHARED, *NAME, "size", "p", node.alias("node"))
    levels, leaves = 1, 1
    while leaves * GROUP < (known["most"] or 0):
        leaves, levels = leaves * FAN_IN, levels + 1
    for level in range(levels):
        done, rest = round_groups(open_, level, level == levels - 1)
        out = out.unionByName(done)
        open_ = rest.withColumn("node", F.floor(F.col("node") / FAN_IN))
    copies = (F.col("whole") + F.col("up").cast("int")).cast("long")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "text_hash", "other_hash", "nth", "size", "source_size", "target", copies.alias("copies"))


def text_hashes(text: str) -> list[Column]:
    """Two hashes that name a text."""
    return [F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit(1), text).alias("other_hash")]


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; those without words stay once, as they take no words.

    Rows equal in key, source and text are one document here: its copies carry the other columns of any of them.
    """
    name = lambda k, s: [F.coalesce(k, F.lit(0)).alias("key_"), k.isNull().alias("no_key_"), F.coalesce(s, F.lit("")).alias("source_"), s.isNull().alias("no_source_")]
    names = ["key_", "no_key_", "source_", "no_source_", "text_hash", "other_hash"]
    plan = mix(docs, key, text, source, weights, most)
    total = F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies")))
    plan = plan.select(*name(F.col(key), F.col(source)), "text_hash", "other_hash", "size", "copies").groupBy(*names).agg(total.alias("total_")).where("total_ > 0")
    # copies are made of the narrow plan; each document's row is met by all of its copies
    copies = copies_of(cut(plan), "total_", "nth_").drop("nth_")
    rows = docs.select(*name(F.col(key).cast("long"), F.col(source).cast("string")), *text_hashes(text), F.struct("*").alias("doc_"))
    return rows.groupBy(*names).agg(F.any_value("doc_").alias("doc_")).join(copies, names).select("doc_.*")


def op7(spark, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
