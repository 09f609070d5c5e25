"""Documents, question samples, predictions and their sinks: JSON in, JSON and Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.operators.edges import upsert

DOCUMENT = "title string, text string"
#: `context` and `supporting_facts` are arrays of two unlike elements, so they come as strings first.
SAMPLE = "_id string, question string, answer string, context array<array<string>>, supporting_facts array<array<string>>"
PREDICTION = "answer map<string,string>, sp map<string,array<array<string>>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(pos, title, text) of a JSON array of documents; a missing title is Document_<place>, a missing text an error."""
    rows = spark.read.schema(f"{DOCUMENT}, broken_ string").option("multiLine", True).option("columnNameOfCorruptRecord", "broken_").option("mode", "PERMISSIVE").json(path)
    rows = rows.withColumn("pos", F.monotonically_increasing_id())  # a multi-line file is one task, so places are dense
    ok = F.col("broken_").isNull() & F.col("text").isNotNull()
    text = F.when(ok, F.col("text")).otherwise(F.raise_error(F.lit("documents must be a JSON array of objects with a text")))
    return rows.select("pos", F.coalesce("title", F.concat(F.lit("Document_"), F.col("pos").cast("string"))).alias("title"), text.alias("text"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample_pos, sample_id, question, answer, context, supporting_facts) of a JSON array of question samples."""
    rows = spark.read.schema(SAMPLE).option("multiLine", True).json(path)
    return with_structs(rows.withColumn("sample_pos", F.monotonically_increasing_id()).withColumnRenamed("_id", "sample_id"))


def with_structs(rows: DataFrame) -> DataFrame:
    """The two-element arrays as structs (title, sentences) and (title, sent_id)."""
    context = F.transform("context", lambda c: F.struct(c[0].alias("title"), F.from_json(c[1], "array<string>").alias("sentences")))
    facts = F.transform("supporting_facts", lambda f: F.struct(f[0].alias("title"), f[1].cast("int").alias("sent_id")))
    return rows.withColumn("context", context).withColumn("supporting_facts", facts)


def contexts(rows: DataFrame) -> DataFrame:
    """(sample_pos, sample_id, ctx_pos, title, text): each context of each sample, its sentences joined by blanks."""
    one = rows.select("sample_pos", "sample_id", F.posexplode("context").alias("ctx_pos", "c"))
    return one.select("sample_pos", "sample_id", "ctx_pos", "c.title", F.array_join("c.sentences", " ").alias("text"))


def predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((sample_id, prediction), (sample_id, sp)) of one prediction file."""
    rows = spark.read.schema(PREDICTION).option("multiLine", True).json(path)
    fact = lambda x: F.struct(x[0].alias("title"), x[1].cast("int").alias("sent_id"))
    answers = rows.select(F.explode("answer").alias("sample_id", "prediction"))
    support = rows.select(F.explode("sp").alias("sample_id", "sp")).select("sample_id", F.transform("sp", fact).alias("sp"))
    return answers, support


def filters(mapping: DataFrame) -> DataFrame:
    """(qid, chunk_id): the chunks that a sample's question may use."""
    return mapping.select(F.col("sample_id").alias("qid"), "chunk_id").distinct()


def write_mappings(docs: DataFrame, mapping: DataFrame, path: str) -> None:
    """The title of each chunk, and the chunks of each sample, as tables that an evaluation reads again."""
    docs.select("title", "chunk_id").write.mode("overwrite").parquet(f"{path}/title_to_chunk")
    mapping.write.mode("overwrite").parquet(f"{path}/sample_chunks")


def read_mappings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((title, chunk_id), (sample_id, ctx_pos, chunk_id))."""
    return spark.read.parquet(f"{path}/title_to_chunk"), spark.read.parquet(f"{path}/sample_chunks")


def write_results(records: DataFrame, path: str) -> None:
    """One JSON line for each record; what was there goes."""
    records.write.mode("overwrite").json(path)


def merge_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, title, text): a cache with new rows, which win."""
    return upsert(old, new, ["chunk_id"])
