"""Shards by extendible hashing.

A document's 60 hash bits name a path in a binary directory. A bucket of more bytes than the limit is split on its
next bit, and only such buckets are; the others keep their shorter prefix, so the directory's depth differs from
place to place. Splitting is decided on counts alone: a histogram over fine prefixes, summed on the map side, gives
the bytes of every shorter prefix. Only where a fine bucket is still too large do its documents go on to a round
with more bits.

Defined results: null texts have 0 bytes; a document larger than the limit gets a shard of its own (its bucket is
split until nothing else is in it); a bucket of rows that share all 60 bits, such as rows of one id, is split on by
the same rule: on 60 bits of a hash of the text, and where these are shared too, of a hash of the row's number among
the rows equal in id and text. So shards depend on the rows alone, not on their order or partitions; only which of
several equal rows has which number is left to the input's order. An empty table gives no shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import copies_of, cut, numbered, table

HASH_BITS, FINE_BITS = 60, 6
LIMIT = 1_000_000


def hash_bits(key: str):
    """60 bits of the MD5 of the key's decimal form ('null' for none), as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def prefix(depth):
    """The first `depth` bits of column h, as a number."""
    return F.call_function("shiftright", F.col("h"), F.lit(HASH_BITS) - depth)


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """(base, depth, prefix, bytes, docs): the leaves of the directory below each base, over `sized` (base, h, bytes)."""
    total = sized.agg(F.sum("bytes"), F.count("*")).first()
    start, leaves, open_ = 0, None, sized
    least = max(0, ((total[0] or 0) // max(1, limit)).bit_length())
    while True:
        fine = min(HASH_BITS, start + (least if start == 0 else 0) + FINE_BITS)
        counts = open_.groupBy("base", prefix(F.lit(fine)).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        counts = cut(counts)
        depths = F.explode(F.sequence(F.lit(start), F.lit(fine)))
        nodes = counts.select("base", "fine", "bytes", "docs", depths.alias("depth")).withColumn("prefix", F.call_function("shiftright", F.col("fine"), F.lit(fine) - F.col("depth")))
        nodes = nodes.groupBy("base", "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        fits = (F.col("bytes") <= limit) | (F.col("docs") == 1)
        nodes = cut(nodes.withColumn("fits", fits | (F.col("depth") == HASH_BITS)))
        # a leaf fits and its parent doesn't
        parent = nodes.where("NOT fits").select("base", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        found = nodes.where("fits").withColumn("above", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        tops = found.where(F.col("depth") == start)
        below = found.where(F.col("depth") > start).join(parent, ["base", "depth", "above"], "left_semi")
        new = tops.unionByName(below).select("base", "depth", "prefix", "bytes", "docs")
        leaves = new if leaves is None else leaves.unionByName(new)
        rest = nodes.where((F.col("depth") == fine) & ~F.col("fits")).select("base", F.col("prefix").alias("fine_"))
        if fine == HASH_BITS or rest.isEmpty():
            return cut(leaves)
        open_ = cut(open_.withColumn("fine_", prefix(F.lit(fine))).join(rest, ["base", "fine_"], "left_semi").drop("fine_"))
        start = fine + 1


def placed(sized: DataFrame, limit: int, *more: str) -> DataFrame:
    """(key, bytes, text_hash, nth, shard, depth, shard_bytes, shard_docs) of every row of `sized` (key, h, bytes, text_hash, nth)."""
    out, level = None, 0
    sized = sized.withColumn("base", F.lit(""))
    while True:
        leaves = directory(sized.select("base", "h", "bytes"), limit)
        depths = [r.depth for r in leaves.select("depth").distinct().collect()]  # at most HASH_BITS + 1
        # each document tries the depths that leaves have; exactly one of its prefixes is a leaf
        tries = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix(F.lit(d)).alias("prefix")) for d in sorted(depths)))) if depths else F.explode(F.array(F.struct(F.lit(0).alias("depth"), F.col("h").alias("prefix"))))
        rows = sized.select("base", "key", "bytes", "text_hash", "nth", *more, tries.alias("t")).select("base", "key", "bytes", "text_hash", "nth", *more, "t.*")
        leaves = leaves.select("base", "depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
        rows = rows.join(leaves, ["base", "depth", "prefix"])
        bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("right(lpad(conv(prefix, 10, 2), 60, '0'), depth)"))
        rows = rows.withColumn("shard", F.concat("base", bits)).withColumn("depth", F.col("depth") + HASH_BITS * level)
        full = (F.col("depth") == HASH_BITS * (level + 1)) & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
        done = rows.where(~full).select("key", "bytes", "text_hash", "nth", *more, "shard", "depth", "shard_bytes", "shard_docs")
        out = done if out is None else out.unionByName(done)
        if leaves.where((F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)).isEmpty():
            return out
        level += 1
        h = F.col("text_hash") if level == 1 else F.xxhash64("text_hash", "nth", F.lit(level))
        sized = cut(rows.where(full).select(F.concat("shard", F.lit(".")).alias("base"), "key", "bytes", "text_hash", "nth", *more, F.shiftrightunsigned(h, 64 - HASH_BITS).alias("h")))


def sizes(docs: DataFrame, key: str, text: str, *more) -> DataFrame:
    """(key, h, bytes, text_hash, ...) of every row of `docs`."""
    n = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("key"), hash_bits(key).alias("h"), n.alias("bytes"), F.xxhash64(text).alias("text_hash"), *more)


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes, shard_docs) for each row of `docs`.

    `shard` is the bucket's bit string, with a ``.`` after every 60 bits where these don't suffice; its bytes and
    rows are its own.
    """
    # equal rows are numbered, whichever of them is which
    rows = sizes(docs, key, text).groupBy("key", "h", "bytes", "text_hash").agg(F.count("*").alias("n"))
    rows = placed(copies_of(cut(rows), "n", "nth"), limit)
    return rows.select(F.col("key").alias(key), F.col("bytes").alias("n_bytes"), "shard", "depth", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Write `docs` with a folder for each shard; a shard is one task's rows and so one file.

    The rows are stored once with their places, so that each goes into its own shard and no other. A column `shard` of
    the input gives way.
    """
    rows = cut(docs.drop("shard").select(F.monotonically_increasing_id().alias("place_"), F.col(key).alias("key_"), F.col(text).alias("text_"), F.struct("*").alias("doc_")))
    named = numbered(sizes(rows, "key_", "text_", "place_"), ["key", "text_hash"], "place_", "nth")
    plan = placed(cut(named), limit, "place_").select("place_", "shard")
    rows.join(plan, "place_").select("doc_.*", "shard").repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)


def op1(spark, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0) AS n_bytes FROM documents
), l AS (SELECT unnest(range(0, 33)) AS depth
), n AS (SELECT doc_id, n_bytes, depth, h >> (60 - depth) AS prefix FROM d, l
), s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM n GROUP BY ALL
), f AS (
  SELECT doc_id, n_bytes, depth, prefix, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k
  FROM n JOIN s USING (depth, prefix) WHERE shard_bytes <= 1000000 OR shard_docs = 1
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 60, '0'), depth::INT) END AS shard, depth::INT AS depth, shard_bytes, shard_docs FROM f WHERE k = 1
"""
