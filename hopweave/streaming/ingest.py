"""Continuous ingest: a file stream of documents, each micro-batch merged into the saved graph."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hopweave.config import Config
from hopweave.models import Models
from hopweave.plans.build import build, extend
from hopweave.plans.graph import KnowledgeGraph

DOCUMENT = "title string, text string"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest whole version under `path`, or None."""
    try:
        row = spark.read.json(f"{path}/versions").orderBy(F.desc("batch")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return row["folder"] if row else None


def merge_batch(docs: DataFrame, batch: int, path: str, models: Models | None = None, config: Config | None = None, batch_only: bool = True) -> None:
    """Write the graph with `docs` as a new version; a batch that comes again after a failure finds its titles there.

    A version counts once its line is in `versions`, so a reader never sees half of one.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("pos", F.monotonically_increasing_id()).persist()
    try:
        if docs.isEmpty():
            return
        folder = f"{path}/graph-{batch}-{uuid.uuid4().hex[:8]}"
        old = current(spark, path)
        graph = build(docs, ("pos",), models, config) if old is None else extend(KnowledgeGraph.load(spark, old), docs, ("pos",), models, config, batch_only)
        graph.save(folder)
        line = json.dumps({"batch": batch, "folder": folder})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{path}/versions")
    finally:
        docs.unpersist()


def ingest(spark: SparkSession, source: str, path: str, models: Models | None = None, config: Config | None = None, once: bool = True, batch_only: bool = True) -> StreamingQuery:
    """Stream JSON lines of documents from the folder `source` into the graph under `path`.

    With `once` what is there is taken and the query ends; else it goes on every minute.
    """
    stream = spark.readStream.schema(DOCUMENT).json(source)
    writer = stream.writeStream.foreachBatch(lambda df, i: merge_batch(df, i, path, models, config, batch_only)).option("checkpointLocation", f"{path}/stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
