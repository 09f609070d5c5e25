"""Entities of chunks: mentions, inverted index, relations, and the edges between chunks that share an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hopweave.config import BRIDGE_LABELS, ENTITY_STOPWORDS, Config
from hopweave.functions.text import keeps_entity, normalize_entity
from hopweave.sources.lineage import cut

from .setops import small, top

DEFAULT = Config()


def mentions(extracted: DataFrame, for_query: bool = False, config: Config = DEFAULT) -> DataFrame:
    """(chunk_id, pos, name, type) of (chunk_id, pos, entities): names normalized and filtered; of one name the last type stays."""
    one = extracted.select("chunk_id", "pos", F.posexplode("entities").alias("ord", "e"))
    one = one.select("chunk_id", "pos", "ord", normalize_entity(F.col("e.name")).alias("name"), F.col("e.type").alias("type"))
    one = one.where((F.col("name") != "") & keeps_entity(F.col("name"), for_query, config.min_entity_length, ENTITY_STOPWORDS))
    return one.groupBy("chunk_id", "pos", "name").agg(F.max_by("type", "ord").alias("type"))


def entity_nodes(mentioned: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(name, type): the type that was written last; ends of relations that no chunk mentions have none."""
    nodes = mentioned.groupBy("name").agg(F.max_by("type", F.struct("pos", "chunk_id")).alias("type"))
    if relations is None:
        return nodes
    ends = relations.select(F.col("source").alias("name")).union(relations.select("target")).distinct()
    return nodes.unionByName(ends.join(nodes, "name", "left_anti").withColumn("type", F.lit(None).cast("string")))


def relation_edges(extracted: DataFrame) -> DataFrame:
    """(source, target, type, source_chunk) of (chunk_id, rels), each once."""
    one = extracted.select("chunk_id", F.explode("rels").alias("r"))
    return one.select("r.source", "r.target", "r.type", F.col("chunk_id").alias("source_chunk")).distinct()


def occurrences(mentioned: DataFrame, config: Config = DEFAULT, labels: tuple[str, ...] | None = BRIDGE_LABELS) -> DataFrame:
    """(name, chunk_id), each once, of the names and types that may bridge."""
    keep = F.length("name") >= config.bridge_min_name
    if labels is not None:
        keep &= F.col("type").isin(*labels)
    return mentioned.where(keep).select(F.lower("name").alias("name"), "chunk_id").distinct()


def inverted_index(occurring: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """(name, n_chunks, chunks) of the names in `least` to `most` chunks, chunks in order of their ids.

    Counts come first and leave out the frequent names, so no array is longer than `most`.
    """
    n = occurring.groupBy("name").agg(F.count("*").alias("n_chunks")).where(F.col("n_chunks").between(least, most))
    return occurring.join(n, "name").groupBy("name").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list("chunk_id")).alias("chunks"))


def band_stats(occurring: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row: how many names there are, are too rare or too frequent, are used, and are connected fully or by a sample."""
    n = F.col("n")
    used = n.between(config.bridge_min_chunks, config.bridge_max_chunks)
    return occurring.groupBy("name").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("total"), F.count_if(n < config.bridge_min_chunks).alias("filtered_low"), F.count_if(n > config.bridge_max_chunks).alias("filtered_high"),
        F.count_if(used).alias("used"), F.count_if(used & (n <= config.bridge_full_connect)).alias("full_connect"), F.count_if(used & (n > config.bridge_full_connect)).alias("sampled"),
    )


def all_pairs(chunks: Column) -> Column:
    """Pairs in order of a sorted array that the caller bounds."""
    return F.flatten(F.transform(chunks, lambda a, i: F.transform(F.slice(chunks, i + 2, F.size(chunks)), lambda b: F.struct(a.alias("src"), b.alias("dst")))))


def sampled_pairs(name: Column, chunks: Column, k: int, most: int) -> Column:
    """Each chunk in order draws `k` others, by a hash of name and pair; the first `most` different pairs stay."""

    def draws(a: Column) -> Column:
        others = F.filter(chunks, lambda b: b != a)
        ranked = F.array_sort(F.transform(others, lambda b: F.struct(F.md5(F.concat_ws("|", name, a, b)).alias("h"), b.alias("b"))))
        return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(F.least(a, x["b"]).alias("src"), F.greatest(a, x["b"]).alias("dst")))

    return F.slice(F.array_distinct(F.flatten(F.transform(chunks, draws))), 1, most)


def bridge_edges(occurring: DataFrame, config: Config = DEFAULT, full: bool = True, sampled: bool = True) -> DataFrame:
    """(src, dst, score): chunks that share an entity of the frequency band, once for a pair, src < dst as strings.

    The band bounds every array, so pairs are made inside a row and nothing is joined with itself.
    """
    index = inverted_index(occurring, config.bridge_min_chunks, config.bridge_max_chunks)
    few = F.col("n_chunks") <= config.bridge_full_connect
    none = F.array().cast("array<struct<src:string,dst:string>>")
    some = sampled_pairs(F.col("name"), F.col("chunks"), config.bridge_sample_neighbours, config.bridge_max_edges)
    pairs = F.when(few, all_pairs(F.col("chunks")) if full else none).otherwise(some if sampled else none)
    return index.select(F.explode(pairs).alias("p")).select("p.*").distinct().withColumn("score", F.lit(1.0))


def first_mentions(mentioned: DataFrame, most: int) -> DataFrame:
    """(name, chunk_id): each name's first `most` chunks by id; a name of any frequency is cut on the map side."""
    return top(mentioned.select("name", "chunk_id"), ["name"], [F.asc("chunk_id")], most).drop("rank")


def leads(relations: DataFrame, first: DataFrame, most: int) -> DataFrame:
    """(name, chunk_id): of each name the first `most` chunks by id with an entity that a relation leads to from it.

    `first`: (name, chunk_id), each name's first `most` chunks. No other chunk of a target can be among the first of its
    source, so there are at most `most` rows for a relation and then for a name, however many targets a name has.
    """
    ends = relations.select("source", F.col("target").alias("name")).distinct()
    far = ends.join(first, "name").select(F.col("source").alias("name"), "chunk_id").distinct()
    return first_mentions(far, most)


def reached(frontier: DataFrame, names: DataFrame, first: DataFrame, key: str = "qid") -> DataFrame:
    """(key, chunk_id, id): the chunks of `first` (name, chunk_id) under an entity of a frontier chunk, itself left out."""
    mine = names.select("chunk_id", "name").join(small(cut(frontier.select(key, "chunk_id"))), "chunk_id")
    return mine.join(first.withColumnRenamed("chunk_id", "id"), "name").where("id <> chunk_id").select(key, "chunk_id", "id").distinct()


def co_mentions(frontier: DataFrame, mentioned: DataFrame, cap: int, relations: DataFrame | None = None, key: str = "qid") -> DataFrame:
    """(key, chunk_id, id): the first `cap` other chunks by id that share an entity with a frontier chunk.

    With `relations`, those with the entity that a relation leads to from the frontier chunk's entity. Of a name only its
    first cap + 1 chunks can be among them (one may be the chunk itself), so frequent names bring no more rows than that.
    """
    first = first_mentions(mentioned, cap + 1)
    if relations is not None:
        first = leads(relations, first, cap + 1)
    pairs = reached(frontier, mentioned, first, key)
    return top(pairs, [key, "chunk_id"], [F.asc("id")], cap).drop("rank")
