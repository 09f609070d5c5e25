"""Linking the entities of questions to those of the graph, by either name holding the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hopweave.sources.lineage import cut

from .mentions import first_mentions
from .setops import small, top

#: Entities that are broadcast to strings of more than LONG characters; more of them are joined in blocks of so many.
MOST_ENTITIES, LONG = 50_000, 128


def pieces(c: Column, lengths: list[int] | None = None) -> Column:
    """The different substrings of a string, of the given lengths or of all."""
    n = F.length(c)
    of_length = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(c, i, k))
    fitting = F.sequence(F.lit(0), n) if lengths is None else F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= n)
    return F.array_distinct(F.flatten(F.transform(fitting, of_length)))


def compared(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, name) of which one holds the other, each against each; the entities are broadcast in blocks of checked size."""
    n = wanted.count()
    blocks = max(1, -(-n // MOST_ENTITIES))
    out = None
    for b in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("entity"), F.lit(blocks)) == b) if blocks > 1 else wanted
        hit = F.contains(F.col("name"), F.col("entity")) | F.contains(F.col("entity"), F.col("name"))
        one = names.join(F.broadcast(part), hit).select("entity", "name")
        out = one if out is None else out.union(one)
    return out


def linked_names(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, name): each entity (once) with the graph's names (each once) that hold it or that it holds.

    A string holds another if one of its substrings equals it, so the substrings of a name that are as long as an entity, and
    all substrings of an entity, are joined by equality. Only strings of more than LONG characters, which have too
    many, are compared each with each.
    """
    wanted = cut(entities.select("entity").where("entity IS NOT NULL AND entity <> ''").distinct())
    names = cut(names.select("name"))
    short, rest = wanted.where(F.length("entity") <= LONG), wanted.where(F.length("entity") > LONG)
    plain, long_ = names.where(F.length("name") <= LONG), names.where(F.length("name") > LONG)
    lengths = short.agg(F.sort_array(F.collect_set(F.length("entity")))).first()[0]
    if lengths:
        holding = plain.select("name", F.explode(pieces(F.col("name"), lengths)).alias("entity")).join(small(short), "entity").select("entity", "name")
        held = small(cut(short.select("entity", F.explode(pieces(F.col("entity"))).alias("name")).where("name <> entity")))
        out = holding.union(plain.join(held, "name").select("entity", "name"))
    else:
        out = plain.select(F.lit("").alias("entity"), "name").limit(0)
    if not long_.isEmpty():
        out = out.union(compared(wanted, long_))
    return out if rest.isEmpty() else out.union(compared(rest, plain))


def linked_chunks(entities: DataFrame, mentioned: DataFrame, cap: int, distinct: bool = True) -> DataFrame:
    """(entity, id, n): the first `cap` chunks by id whose names match an entity.

    `n` is how many of the first `cap` (name, chunk) rows a chunk has, where `distinct` is off.
    """
    names = mentioned.select("name").distinct()
    hits = linked_names(entities, names).join(first_mentions(mentioned, cap), "name").withColumnRenamed("chunk_id", "id")
    if distinct:
        found = hits.select("entity", "id").distinct()
        return top(found, ["entity"], [F.asc("id")], cap).select("entity", "id", F.lit(1).cast("long").alias("n"))
    found = top(hits, ["entity"], [F.asc("id"), F.asc("name")], cap)
    return found.groupBy("entity", "id").agg(F.count("*").alias("n"))


def rank_seeds(questions: DataFrame, mentioned: DataFrame, most_entities: int = 5, cap: int = 10) -> DataFrame:
    """(qid, id, weight): where a question's page rank starts; the weights of a question add up to one.

    `questions`: (qid, entities). The first entities in order count; each adds one for every matching row.
    """
    wanted = questions.select("qid", F.explode(F.slice(F.array_sort("entities"), 1, most_entities)).alias("entity"))
    found = wanted.join(linked_chunks(wanted, mentioned, cap, distinct=False), "entity").groupBy("qid", "id").agg(F.sum("n").alias("n"))
    total = found.groupBy("qid").agg(F.sum("n").alias("total"))
    return found.join(total, "qid").select("qid", "id", (F.col("n") / F.col("total")).alias("weight"))
