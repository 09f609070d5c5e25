"""SimHash document fingerprints and block-table search (DataFrame functions only).

Terms are runs of five words (the whole text where it is shorter), weighted by how often they occur.
Each term's 128 hash bits vote with that weight on 128 signed counters; a fingerprint bit is 1 where the
sum is positive. Votes are counted in packed lanes: four 16-bit counters to a long, over at most 16,384
terms at a time (the top lane of 32,768 would overflow a long), so a document of any length is summed up in bounded
state and on the map side.

The order of the documents is found on narrow rows (id, text hash, place): one global sort, whose ranges may split even
the rows of one id, and the ends of its partitions joined to each other. Each text is then dealt once by its place, and
of the document that is next to another only the beginning that the other takes. `describe` also searches: documents of
a stated query set meet all fingerprints in the block tables.

Defined results: null and empty texts have the all-zero fingerprint; equal texts have equal fingerprints; rows with
equal ids are ordered by a hash of their text; null ids come first; extra columns are ignored. The input is read twice
and must be the same each time, as a table or a checkpoint is.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, meet, table, words

WORDS = 5
BITS = 128
LANES, CHUNK = 16, 16_384
LANE_MASK = 0x0001_0001_0001_0001
#: The search of `describe`: its Hamming radius, and every so manieth id as a query.
RADIUS, ASKED = 3, 50


def terms(text: str, n: int = WORDS) -> Column:
    """Array of structs of n words, in the order of the text; one short struct for a shorter text."""
    w, size = F.col(text), F.size(text)
    count = F.greatest(size - (n - 1), F.lit(0))
    runs = F.arrays_zip(*(F.slice(w, k, count).alias(f"w{k}") for k in range(1, n + 1)))
    short = F.array(F.struct(*(F.get(w, F.lit(k - 1)).alias(f"w{k}") for k in range(1, n + 1))))
    kind = "array<struct<" + ",".join(f"w{k}:string" for k in range(1, n + 1)) + ">>"
    return F.when(size >= n, runs.cast(kind)).when(size > 0, short.cast(kind))


def votes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, fingerprint (32 hex digits) of every row; `keys` name a row."""
    n = WORDS
    t = df.select(*keys, words(text).alias("w")).select(*keys, F.posexplode_outer(terms("w")).alias("pos", "t"))
    parts = [F.col(f"t.w{k}") for k in range(1, n + 1)]
    h = t.where("t IS NOT NULL").select(*keys, (F.col("pos") / CHUNK).cast("int").alias("chunk"), F.xxhash64(*parts).alias("h"))
    # the second half of the bits is a hash of the first; both are needed in one row to count a term once
    h = h.withColumn("g", F.xxhash64(F.col("h"), F.lit(7)))
    lane = lambda c, k: F.sum(F.shiftrightunsigned(c, k).bitwiseAND(F.lit(LANE_MASK)))
    sums = h.groupBy(*keys, "chunk").agg(F.count("*").alias("n"), *(lane(F.col(c), k).alias(f"{c}{k}") for c in "hg" for k in range(LANES)))
    # bit 16 * q + k of a half is lane q of its sum k
    unpack = lambda c, k, q: F.shiftrightunsigned(f"{c}{k}", 16 * q).bitwiseAND(F.lit(0xFFFF))
    wide = sums.select(*keys, "n", F.array(*(unpack(c, k, q) for c in "hg" for q in range(4) for k in range(LANES))).alias("v"))
    one = wide.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("v").alias("vs"))
    total = F.aggregate(F.slice("vs", 2, F.size("vs")), F.element_at("vs", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    half = lambda at: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda acc, b: acc.bitwiseOR(F.when(F.get("v", b + at) * 2 > F.col("n"), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
    )
    return one.select(*keys, "n", total.alias("v")).select(*keys, hex16(half(0)).alias("hi"), hex16(half(64)).alias("lo")).select(*keys, F.concat("hi", "lo").alias("fingerprint"))


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def halves(fp: Column) -> list[Column]:
    """The two longs of a fingerprint string."""
    return [F.conv(F.substring(fp, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(2)]


def likeness(a: Column, b: Column) -> Column:
    """1 - Hamming distance / bits."""
    # hex digits of the XOR of 8 digits at a time stay within a long
    part = lambda c, i: F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long")
    return 1 - sum((F.bit_count(part(a, i).bitwiseXOR(part(b, i))) for i in range(BITS // 32)), F.lit(0)) / F.lit(float(BITS))


def successors(placed: DataFrame) -> DataFrame:
    """(place, next_place, n_chars) of `placed` (place, key, text): the row before each in ascending order; the first one gets the last."""
    order = ["key", "h", "place"]
    narrow = placed.select("place", "key", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n_chars"))
    # a partition of the sort holds a range, and its number says which
    ranged = cut(narrow.orderBy(F.asc_nulls_first("key"), "h", "place").withColumn("part", F.spark_partition_id()))
    inside = F.lag("place").over(W.partitionBy("part").orderBy(F.asc_nulls_first("key"), "h", "place"))
    last = F.max_by("place", F.struct(*order)).alias("last")
    # one row for a partition: the last row of the one before, and of the last one for the first
    ends = ranged.groupBy("part").agg(last).withColumn("before", F.lag("last").over(W.orderBy("part")))
    ends = ends.select("part", F.coalesce("before", F.lit(ranged.agg(last).first()["last"])).cast("long").alias("border"))
    return ranged.withColumn("inside", inside).join(F.broadcast(ends), "part").select("place", F.coalesce("inside", "border").alias("next_place"), "n_chars")


def edited_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((place, key, next_key, n_chars, text, edited), (place, next_place)): each text, and it with its last third replaced by the next one's beginning."""
    placed = docs.select(F.monotonically_increasing_id().alias("place"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    links = cut(successors(placed))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    wanted = links.select(F.col("next_place").alias("place"), F.col("place").alias("to_place"), third.alias("m"))
    # both joins read the same columns of `placed`, so its texts are shuffled once and read twice
    sent = placed.join(wanted, "place").select(F.col("to_place").alias("place"), F.substring("text", F.lit(1), F.col("m")).alias("begin"), "m", F.col("key").alias("next_key"))
    rows = placed.join(sent, "place")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("m")), "begin")
    return rows.select("place", "key", "next_key", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited")), links.select("place", "next_place")


def fingerprint_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = votes(rows, ["row", "key"], "text")
    empty = rows.where(F.size(words("text")) == 0).select("key", F.lit("0" * 32).alias("fingerprint"))
    return known.select("key", "fingerprint").union(empty).select(F.col("key").alias(key), "fingerprint")


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, next_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows, links = edited_rows(docs, key, text)
    row = ["place", "key", "next_key", "n_chars", "edited_sha256"]
    made = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    # a text without words gets a term of its own here, and the zero fingerprint below, so that its row isn't lost
    texts = made.select(*row, F.explode(both).alias("b"))
    blank = F.trim(F.translate("b.t", "\t\n\x0b\f\r", "     ")) == ""
    texts = texts.select(*row, F.col("b.kind").alias("kind"), blank.alias("blank"), F.when(blank, "-").otherwise(F.col("b.t")).alias("t"))
    found = votes(texts, [*row, "kind", "blank"], "t")
    zero = F.when(F.col("blank"), F.lit("0" * 32)).otherwise(F.col("fingerprint"))
    pairs = found.groupBy(*row).agg(F.max(F.when(F.col("kind") == 0, zero)).alias("fingerprint"), F.max(F.when(F.col("kind") == 1, zero)).alias("edited_fingerprint"))
    pairs = cut(pairs)
    after = links.join(pairs.select(F.col("place").alias("next_place"), F.col("fingerprint").alias("next_fingerprint")), "next_place")
    return pairs.join(after, "place").select(
        F.col("key").alias(key), F.col("next_key").alias("next_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def with_neighbours(described: DataFrame, radius: int = RADIUS, asked: int = ASKED, key: str = "doc_id") -> DataFrame:
    """`described` (key, fingerprint, ...) with n_near: how many other documents a query's fingerprint is near to, null for rows that are none.

    Queries are the rows whose id is divisible by `asked`. Fingerprints meet once each, and documents count by them, so
    copies of one text cost nothing.
    """
    is_asked = F.coalesce(F.col(key) % asked == 0, F.lit(False))
    held = described.groupBy(F.col("fingerprint").alias("found_fingerprint")).agg(F.count("*").alias("n"))
    met = near_fingerprints(described.where(is_asked), described, radius)
    total = met.join(held, "found_fingerprint").groupBy(F.col("query_fingerprint").alias("of")).agg((F.sum("n") - 1).alias("n_near"))
    queries = described.where(is_asked)
    return meet(queries, "fingerprint", total, "of", queries.count()).drop("of").unionByName(described.where(~is_asked).withColumn("n_near", F.lit(None).cast("long")))


def near_fingerprints(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, spare: int = 1) -> DataFrame:
    """(query_fingerprint, found_fingerprint, distance): all different fingerprints within `radius` bits of each query's.

    The bits are cut into radius + spare blocks; at least `spare` blocks of a pair within the radius agree. Each
    table is the fingerprints permuted so that one choice of `spare` blocks comes first, joined on that prefix. More
    spare blocks make longer prefixes and more tables, for corpora whose prefixes grow too full.
    """
    blocks = radius + spare
    step = BITS / blocks
    cuts = [(round(i * step), round((i + 1) * step)) for i in range(blocks)]
    bits = lambda fp: F.concat(*(F.lpad(F.conv(F.substring(fp, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(BITS // 32)))
    tables = list(itertools.combinations(range(blocks), spare))
    part = lambda b, t: F.concat(*(F.substring(b, cuts[j][0] + 1, cuts[j][1] - cuts[j][0]) for j in t))
    prefixes = lambda b: F.array(*(F.xxhash64(F.lit(i), part(b, t)) for i, t in enumerate(tables)))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("fingerprint").alias(name)).distinct().withColumn("bits", bits(F.col(name))).select(name, F.explode(prefixes(F.col("bits"))).alias("prefix"))

    # a prefix is a hash of the table and its bits; what meets by chance is too far apart
    met = keyed(queries, "query_fingerprint").join(keyed(corpus, "found_fingerprint"), "prefix")
    near = met.withColumn("distance", F.round((1 - likeness(F.col("query_fingerprint"), F.col("found_fingerprint"))) * BITS).cast("int"))
    return near.where(F.col("distance") <= radius).select("query_fingerprint", "found_fingerprint", "distance").distinct()


def search(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, spare: int = 1, key: str = "doc_id") -> DataFrame:
    """(query, query_fingerprint, found_fingerprint, distance) of each row of `queries`; join back on the fingerprint for documents."""
    near = near_fingerprints(queries, corpus, radius, spare)
    return queries.select(F.col(key).alias("query"), F.col("fingerprint").alias("query_fingerprint")).join(near, "query_fingerprint").select("query", "query_fingerprint", "found_fingerprint", "distance")


def op4(spark, sf_dir: str) -> DataFrame:
    return with_neighbours(cut(describe(table(spark, sf_dir, "documents"))))
