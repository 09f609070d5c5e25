"""The engine: build, extend, search, answer and evaluate."""

from __future__ import annotations

import logging
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.config import Config
from hopweave.functions.answers import evidence_block, post_process, prompt
from hopweave.models import Models
from hopweave.operators.ids import unique_documents
from hopweave.sources import documents as docs_io
from hopweave.sources.lineage import cut

from . import evaluation
from .build import build, extend
from .graph import KnowledgeGraph
from .search import search

log = logging.getLogger("hopweave")
UNKNOWN = "I don't know."


class Engine:
    """A graph and the models that work on it. `online` engines only search."""

    def __init__(self, spark: SparkSession, models: Models | None = None, config: Config | None = None, online: bool = False):
        self.spark, self.models, self.config, self.online = spark, models or Models(), config or Config.from_env(), online
        self.graph: KnowledgeGraph | None = None

    def build(self, docs: DataFrame, order: tuple[str, ...] = ("pos",)) -> KnowledgeGraph:
        """Ingest documents (title, text, order columns); a graph that is there is extended."""
        if self.online:
            raise RuntimeError("an online engine takes no documents")
        began = time.time()
        self.graph = build(docs, order, self.models, self.config) if self.graph is None else extend(self.graph, docs, order, self.models, self.config)
        log.info("graph built in %.1f s", time.time() - began)
        return self.graph

    def reset(self) -> None:
        self.graph = None

    def save(self, path: str) -> None:
        self.graph.save(path)

    def load(self, path: str) -> Engine:
        self.graph = KnowledgeGraph.load(self.spark, path)
        return self

    def search(self, questions: DataFrame, doc_filter: DataFrame | None = None, beam_width: int | None = None, max_steps: int | None = None) -> DataFrame:
        """(qid, question, nodes, best_path, best_path_titles) of all questions (qid, question) at once."""
        changes = {k: v for k, v in (("beam_width", beam_width), ("max_steps", max_steps)) if v is not None}
        return search(self.graph, questions, doc_filter, self.models, replace(self.config, **changes))

    def answer(self, found: DataFrame) -> DataFrame:
        """`found` with its prediction; questions without evidence get a fixed reply and no model call."""
        found = cut(found)
        asked = found.where(F.size("nodes") > 0).withColumn("evidence", F.col("nodes"))
        asked = asked.withColumn("prompt", prompt(F.col("question"), evidence_block(F.col("nodes")), F.col("best_path")))
        told = self.models.answers.answer(asked, "raw").withColumn("prediction", post_process(F.col("raw"), F.col("question"))).select(*found.columns, "prediction")
        return told.unionByName(found.where(F.size("nodes") == 0).withColumn("prediction", F.lit(UNKNOWN)))

    def query(self, questions: DataFrame, doc_filter: DataFrame | None = None, **how) -> DataFrame:
        """Search and answer."""
        return self.answer(self.search(questions, doc_filter, **how))

    def evaluate(self, samples: DataFrame, doc_filter: DataFrame | None = None) -> DataFrame:
        """Records of all samples (sample_id, question, answer, supporting_facts); a question's time is the batch's share."""
        began = time.time()
        results = cut(self.query(samples.select(F.col("sample_id").alias("qid"), "question"), doc_filter))
        each = (time.time() - began) / max(1, results.count())
        return evaluation.records(results.withColumn("duration", F.lit(each)), samples, self.models.judge)

    def build_from_samples(self, samples: DataFrame) -> DataFrame:
        """Build from the contexts of question samples; returns the filter (qid, chunk_id) that their contexts make."""
        unique, mapping = unique_documents(docs_io.contexts(samples))
        # chunk ids follow the order of first appearance in both
        self.build(unique.select("title", "text", "pos"))
        return docs_io.filters(mapping)
