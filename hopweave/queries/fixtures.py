"""The driver tables in the shapes that the operators take, and the same shapes as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.config import ENTITY_STOPWORDS
from hopweave.functions.text import capital_tokens
from hopweave.operators.ids import number_chunks
from hopweave.operators.mentions import mentions
from hopweave.sources.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, text)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, chunk_id, prev_id, title, text) of documents."""
    return number_chunks(documents(spark, sf_dir), ["doc_id"]).drop("doc_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, title, text, pos, chunk_id, prev_id) of conversations."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("title"), "text")
    return number_chunks(rows, ["conv_id", "turn"])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, prediction, gold): each turn with the next one."""
    rows = table(spark, sf_dir, "conversations")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return rows.select("conv_id", "turn", F.col("text").alias("prediction")).join(after, ["conv_id", "turn"])


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, pos, words): the capitalized words of each chunk, taken from its text once for all that is made of them."""
    return cut(chunks(spark, sf_dir).select("chunk_id", "pos", capital_tokens(F.col("text")).alias("words")))


def mentioned(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """(chunk_id, pos, name, type): names of seven letters, or a multiple, are dates, the others concepts."""
    kind = lambda w: F.when(F.length(w) % 7 == 0, "Date").otherwise("Concept")
    words = tokens(spark, sf_dir) if words is None else words
    return mentions(words.select("chunk_id", "pos", F.transform("words", lambda w: F.struct(w.alias("name"), kind(w).alias("type"))).alias("entities")))


def relations(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """(source, target, type, source_chunk): a chunk's first capitalized word and its second, where they differ."""
    words = tokens(spark, sf_dir) if words is None else words
    rows = words.select(F.lower(F.get("words", F.lit(0))).alias("source"), F.lower(F.get("words", F.lit(1))).alias("target"), F.lit("FOLLOWED_BY").alias("type"), F.col("chunk_id").alias("source_chunk"))
    return rows.where("source <> target")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, embedding): rows of label 0 are summaries."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, "summary").otherwise("chunk").alias("type"), "embedding")


STOP = ", ".join(f"'{w}'" for w in ENTITY_STOPWORDS)
SPLIT = "regexp_split_to_array(text, '[^A-Za-zÀ-ÿ]+')"
CAPITAL = f"list_filter({SPLIT}, lambda w: regexp_full_match(w, '[A-Z][a-z]{{3,}}'))"

CHUNKS = "c AS (SELECT doc_id, 'doc_' || doc_id AS title, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, 'chunk_' || (row_number() OVER (ORDER BY doc_id) - 1) AS chunk_id FROM documents)"
MENTIONS = f"""{CHUNKS}, m AS (
  SELECT DISTINCT chunk_id, pos, lower(w) AS name, CASE WHEN length(w) % 7 = 0 THEN 'Date' ELSE 'Concept' END AS type
  FROM (SELECT chunk_id, pos, unnest({CAPITAL}) AS w FROM c) WHERE lower(w) NOT IN ({STOP}))"""
RELATIONS = f"r AS (SELECT lower(({CAPITAL})[1]) AS source, lower(({CAPITAL})[2]) AS target, chunk_id AS source_chunk FROM c WHERE lower(({CAPITAL})[1]) <> lower(({CAPITAL})[2]))"
TURNS = "t AS (SELECT conv_id, turn, 'conv_' || conv_id AS title, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, 'chunk_' || (row_number() OVER (ORDER BY conv_id, turn) - 1) AS chunk_id FROM conversations)"
PAIRS = "p AS (SELECT a.conv_id, a.turn, a.text AS prediction, b.text AS gold FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
VECTORS = "v AS (SELECT vec_id AS id, CASE WHEN label = 0 THEN 'summary' ELSE 'chunk' END AS type, embedding::DOUBLE[] AS e FROM embeddings)"
SIMILAR = "round(list_cosine_similarity(a.e, b.e), 9)"


def answer_tokens(c: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({c}), '[-–—]', ' ', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"list_filter(regexp_split_to_array({plain}, '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def normalized(c: str) -> str:
    article = f"regexp_replace(lower({c}), '^(the|a|an)\\s+', '')"
    return strip(f"regexp_replace({article}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', '', 'g')")


#: Scores of lists p and g of tokens, as columns same, em, f1, prec and recall of a table with both.
SCORES = """s AS (
  SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS same,
    array_to_string(p, ' ') AS ps, array_to_string(g, ' ') AS gs FROM tok
), f AS (
  SELECT *, (ps = gs)::INT::DOUBLE AS em,
    CASE WHEN same = 0 OR ((ps IN ('yes', 'no', 'noanswer') OR gs IN ('yes', 'no', 'noanswer')) AND ps <> gs) THEN 0.0 ELSE same / len(p) END AS prec,
    CASE WHEN same = 0 OR ((ps IN ('yes', 'no', 'noanswer') OR gs IN ('yes', 'no', 'noanswer')) AND ps <> gs) THEN 0.0 ELSE same / len(g) END AS recall FROM s
), scored AS (SELECT *, CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0.0 END AS f1 FROM f)"""
