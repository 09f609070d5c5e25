"""Best-first search for many questions at once.

All questions advance together. The state is a frontier (qid, ord, ...), the visited chunks and the selected
evidence; a round pops the best row of each question, expands it, scores what is new and merges it into the
frontier. Every round is one fixed plan keyed by question, and its state is cut before the next one. A question takes
at most `max_steps` pops; pops of visited chunks use one up as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hopweave.config import Config
from hopweave.functions.scores import keeps, trust
from hopweave.functions.text import block, context_query, hybrid_query, path_step, start_step
from hopweave.models import Models
from hopweave.operators import vectors as vector_ops
from hopweave.operators.linking import rank_seeds
from hopweave.operators.mentions import mentions
from hopweave.operators.neighbours import PRECEDENCE, Neighbourhood, expand
from hopweave.operators.pagerank import Ranks, co_mention_edges, ranks, walk_edges
from hopweave.operators.setops import doc_titles, shared, top, within_filter
from hopweave.sources.lineage import cut

from .graph import KnowledgeGraph

EVIDENCE = "struct<id:string,title:string,doc_title:string,text:string,score:double,depth:int,path:array<string>>"
STATE = ["qid", "ord", "id", "title", "source", "doc_title", "text", "path", "context", "depth", "path_titles", "score"]


def with_entities(questions: DataFrame, models: Models, config: Config) -> DataFrame:
    """(qid, question, entities): given entities in order, or those that the extractor finds in the question."""
    if "entities" in questions.columns:
        return questions.select("qid", "question", F.array_sort(F.array_distinct(F.coalesce("entities", F.array().cast("array<string>")))).alias("entities"))
    found = models.entities.extract(questions.select("qid", "question"), "question")
    names = mentions(found.select(F.col("qid").alias("chunk_id"), F.lit(0).alias("pos"), "entities"), True, config)
    names = names.groupBy(F.col("chunk_id").alias("qid")).agg(F.array_sort(F.collect_set("name")).alias("entities"))
    return questions.select("qid", "question").join(names, "qid", "left").select("qid", "question", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def with_mode(questions: DataFrame, doc_filter: DataFrame | None, config: Config) -> DataFrame:
    """Questions with n_filter (null: no filter) and mode: A for a small filter, B for a large one, C for none.

    `doc_filter`: (qid, chunk_id); a question whose only row has no chunk has an empty filter.
    """
    if doc_filter is None:
        sized = questions.withColumn("n_filter", F.lit(None).cast("long"))
    else:
        sized = questions.join(doc_filter.groupBy("qid").agg(F.countDistinct("chunk_id").alias("n_filter")), "qid", "left")
    mode = F.when(F.col("n_filter").isNull(), "C").when(F.col("n_filter") <= config.small_space, "A").otherwise("B")
    return sized.withColumn("mode", mode)


def small_space(questions: DataFrame, doc_filter: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks (qid, id, text, doc_title) of the filters of questions in mode A; chunks without text are left out."""
    ids = doc_filter.join(questions.where("mode = 'A'").select("qid"), "qid", "left_semi").select("qid", F.col("chunk_id").alias("id")).distinct()
    return ids.join(chunks.select(F.col("chunk_id").alias("id"), "text", F.col("title").alias("doc_title")), "id").where("text <> ''").select("qid", "id", "text", "doc_title")


def opened_summaries(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, at, id) of vector hits (qid, rank, id, type): chunks as they are, summaries by their children.

    A summary that came in as a better hit's child isn't opened again.
    """
    place = lambda child: F.struct(F.lit(1).alias("part"), "rank", child.alias("child")).alias("at")
    summaries = hits.where("type = 'summary'")
    above = summaries.select("qid", F.col("rank").alias("above"), F.col("id").alias("source")).join(edges, "source").select("qid", F.col("target").alias("id"), "above")
    opened = summaries.join(above.groupBy("qid", "id").agg(F.min("above").alias("above")), ["qid", "id"], "left").where("above IS NULL OR above > rank")
    below = opened.select("qid", "rank", F.col("id").alias("source")).join(edges, "source")
    return hits.where("type = 'chunk'").select("qid", place(F.lit("")), "id").unionByName(below.select("qid", place(F.col("target")), F.col("target").alias("id")))


def merged_seeds(drilled: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, at, id, source): drilled chunks, which may repeat, and then found ones, once each, that aren't among them."""
    new = found.groupBy("qid", "id").agg(F.min("at").alias("at")).join(drilled.select("qid", "id"), ["qid", "id"], "left_anti")
    return drilled.withColumn("source", F.lit("SummaryDrill")).select("qid", "at", "id", "source").unionByName(new.withColumn("source", F.lit("Doc")).select("qid", "at", "id", "source"))


def with_few(kept: DataFrame, neighbours: DataFrame, least: int) -> DataFrame:
    """The rows of `kept` (qid, ...) whose question has fewer than `least` neighbours (qid, ...)."""
    counts = neighbours.groupBy("qid").agg(F.count("*").alias("n_"))
    return kept.join(counts, "qid", "left").where(F.coalesce("n_", F.lit(0)) < least).drop("n_")


def first_candidates(jumps: DataFrame, near: DataFrame, beam: int) -> DataFrame:
    """(qid, id, source, at, new): vector hits (qid, rank, id), then neighbours (qid, id, label, precedence), cut unscored to 3 x beam."""
    rows = jumps.select("qid", "id", F.lit("VectorJump").alias("source"), F.struct(F.lit(-1).alias("precedence"), F.col("rank").alias("place"), F.lit("").alias("name")).alias("at"))
    rows = rows.unionByName(near.select("qid", "id", F.col("label").alias("source"), F.struct(F.col("precedence"), F.lit(0).alias("place"), F.col("id").alias("name")).alias("at")))
    return top(rows, ["qid"], [F.asc("at")], 3 * beam, "new")


def raw_documents(lost: DataFrame, doc_filter: DataFrame, chunks: DataFrame, reranker, beam: int) -> DataFrame:
    """(qid, step, id, title, text, rerank): the best chunks of the filters of questions (qid, question) by rerank score alone."""
    ids = doc_filter.join(lost.select("qid", F.col("question").alias("query")), "qid").select("qid", "query", F.col("chunk_id").alias("id")).distinct()
    rows = ids.join(chunks.select(F.col("chunk_id").alias("id"), "title", "text"), "id")
    return top(reranker.score(rows), ["qid"], [F.desc("rerank"), F.asc("id")], beam, "step").select("qid", "step", "id", "title", "text", "rerank")


@dataclass
class Search:
    graph: KnowledgeGraph
    questions: DataFrame  # qid, question, entities, n_filter, mode, embedding
    doc_filter: DataFrame | None
    models: Models
    config: Config
    page_ranks: Ranks
    near: Neighbourhood
    entities: DataFrame  # qid, entity

    @classmethod
    def of(cls, graph: KnowledgeGraph, questions: DataFrame, doc_filter: DataFrame | None, models: Models, config: Config) -> Search:
        asked = with_mode(with_entities(questions, models, config), doc_filter, config)
        asked = cut(models.embedder.embed(asked, "question"))
        entities = asked.select("qid", F.explode("entities").alias("entity")).where("entity <> ''")
        near = Neighbourhood.of(graph, config, entities.select("entity").distinct(), config.max_steps)
        edges = walk_edges(graph.next, graph.related, co_mention_edges(graph.mentions, config.ppr_co_mentions))
        seeds = cut(rank_seeds(asked, graph.mentions, config.ppr_entities, config.ppr_seeds))
        walked = ranks(graph.chunks.select(F.col("chunk_id").alias("id")), edges, seeds, config.ppr_alpha, config.ppr_max_iter, config.ppr_tol)
        return cls(graph, asked, doc_filter, models, config, walked, near, entities)

    def allowed(self, rows: DataFrame, large: bool = False) -> DataFrame:
        """Rows (qid, id, ...) that their question's filter, if it has one, lets pass; of `large` filters only what a cut table `rows` has is dealt out."""
        if self.doc_filter is None:
            return rows
        free = self.questions.where("coalesce(n_filter, 0) = 0").select("qid")
        doc_filter = self.doc_filter.where("chunk_id IS NOT NULL")
        if large:
            doc_filter = shared(doc_filter, rows.withColumnRenamed("id", "chunk_id"), ["qid", "chunk_id"])
        return rows.join(free, "qid", "left_semi").unionByName(within_filter(rows, doc_filter))

    def scored(self, rows: DataFrame) -> DataFrame:
        """Rows (qid, id, text, depth, source, query, ...) with their score; a pair that comes twice is ranked once."""
        pairs = rows.select("qid", "id", "query", "text").dropDuplicates(["qid", "id"])
        reranked = self.models.reranker.score(pairs).select("qid", "id", "rerank")
        with_rank = rows.join(reranked, ["qid", "id"]).join(self.page_ranks.of(rows), ["qid", "id"], "left").join(self.questions.select("qid", "entities"), "qid")
        return with_rank.withColumn("score", trust(F.col("rerank"), F.col("ppr"), F.col("text"), F.col("entities"), F.col("depth"), F.col("source"))).drop("rerank", "ppr", "entities")

    # ---- where a search starts

    def small_space(self) -> DataFrame:
        """All chunks of a small filter."""
        rows = small_space(self.questions, self.doc_filter, self.graph.chunks)
        return rows.select("qid", F.struct(F.lit(0).alias("part"), F.lit(0).alias("rank"), F.col("id").alias("child")).alias("at"), "id", "text", F.col("doc_title").alias("title"), F.lit("Doc").alias("source"), "doc_title")

    def drilled(self, mode: str, k: int) -> DataFrame:
        """(qid, at, id): chunks below the best summaries."""
        found = vector_ops.summary_guided(self.questions.where(F.col("mode") == mode), self.graph.vectors, self.graph.summary_edges, k)
        return found.select("qid", F.struct(F.lit(0).alias("part"), "rank", F.lit("").alias("child")).alias("at"), "id")

    def by_vector(self, mode: str, k: int) -> DataFrame:
        """(qid, rank, id, type)."""
        found = vector_ops.search(self.questions.where(F.col("mode") == mode), self.graph.vectors, k)
        return found.join(self.graph.vectors.select("id", "type"), "id")

    def seeds(self, mode: str) -> DataFrame:
        """Where modes B and C start: drilled chunks, which may repeat, and then vector hits that aren't among them."""
        beam = self.config.beam_width
        drilled = cut(self.drilled(mode, beam * (2 if mode == "B" else 1)))
        hits = cut(self.by_vector(mode, beam * (3 if mode == "B" else 2)))
        if mode == "B":
            found = hits.select("qid", F.struct(F.lit(1).alias("part"), "rank", F.lit("").alias("child")).alias("at"), "id")
        else:
            found = opened_summaries(hits, self.graph.summary_edges)
        both = merged_seeds(drilled, found)
        if mode == "B":
            both = self.allowed(cut(both), large=True)
        rows = doc_titles(both.join(self.graph.vectors.select("id", "text"), "id"), self.graph.chunks)
        title = F.when(F.col("source") == "SummaryDrill", "SummaryDrill").otherwise(F.col("doc_title"))
        return rows.select("qid", "at", "id", "text", title.alias("title"), "source", "doc_title")

    def start(self) -> DataFrame:
        rows = self.seeds("C")
        if self.doc_filter is not None:
            rows = rows.unionByName(self.seeds("B")).unionByName(self.small_space())
        rows = rows.join(self.questions.select("qid", F.col("question").alias("query"), "mode"), "qid").withColumn("depth", F.lit(0))
        scored = self.scored(rows)
        most = F.when(F.col("mode") == "A", self.config.small_space).otherwise(self.config.beam_width)
        frontier = top(scored, ["qid"], [F.desc("score"), F.asc("at")], most, "ord")
        titles = F.when(F.col("doc_title") != "", F.array("doc_title")).otherwise(F.array().cast("array<string>"))
        return frontier.select(
            "qid", "ord", "id", "title", "source", "doc_title", "text", F.array(start_step(F.col("title"))).alias("path"),
            block(F.col("title"), F.col("text")).alias("context"), "depth", titles.alias("path_titles"), "score",
        )

    # ---- a round

    def supplements(self, kept: DataFrame, neighbours: DataFrame, visited: DataFrame) -> DataFrame:
        """(qid, id, label, precedence) from a vector search with the context, for questions with few neighbours."""
        few = with_few(kept, neighbours, self.config.hybrid_below)
        asked = few.join(self.questions.select("qid", "question"), "qid").select("qid", hybrid_query(F.col("question"), F.col("context")).alias("query"))
        found = vector_ops.hybrid(self.models.embedder.embed(asked, "query"), self.graph.vectors, visited, self.config.hybrid_k)
        return found.select("qid", "id", F.lit("Doc").alias("label"), (F.lit(len(PRECEDENCE)) + F.col("rank")).alias("precedence"))

    def candidates(self, kept: DataFrame, visited: DataFrame) -> DataFrame:
        """New rows of the frontier, unscored, the first 3 x beam of each question: vector hits and then neighbours."""
        beam = self.config.beam_width
        near = cut(expand(kept.select("qid", F.col("id").alias("chunk_id")), visited, self.near, self.entities))
        more = self.supplements(kept, near, visited).join(near.select("qid", "id"), ["qid", "id"], "left_anti")
        near = cut(near.unionByName(more))
        asked = kept.join(near.select("qid").distinct(), "qid", "left_semi").join(self.questions.select("qid", "question"), "qid")
        asked = cut(self.models.embedder.embed(asked.withColumn("query", context_query(F.col("question"), F.col("context"))), "query"))
        jumps = vector_ops.search(asked, self.graph.vectors, beam).join(visited.select("qid", "id"), ["qid", "id"], "left_anti")
        allowed = lambda df: self.allowed(df) if self.doc_filter is not None else df
        rows = first_candidates(allowed(jumps), allowed(near), beam)
        meta = self.graph.vectors.select("id", "text", F.col("title").alias("meta_title"))
        cached = self.graph.chunks.select(F.col("chunk_id").alias("id"), F.col("title").alias("cached_title"))
        rows = rows.join(meta, "id").join(cached, "id", "left")
        jump = F.col("source") == "VectorJump"
        doc_title = F.coalesce(F.when(F.col("cached_title") != "", F.col("cached_title")), F.when(jump, F.col("meta_title")), F.lit(""))
        title = F.when(F.col("source") == "Doc", F.col("meta_title")).otherwise(F.col("source"))
        shown = F.when(jump, F.col("meta_title")).otherwise(title)
        step = path_step(shown, jump)
        come = asked.select("qid", "query", "path", "context", "path_titles", (F.col("depth") + 1).alias("depth"))
        rows = rows.select("qid", "id", "new", "source", "text", doc_title.alias("doc_title"), title.alias("title"), shown.alias("shown"), step.alias("step")).join(come, "qid")
        titles = F.when(F.col("doc_title") != "", F.concat("path_titles", F.array("doc_title"))).otherwise(F.col("path_titles"))
        return rows.withColumn("path", F.concat("path", F.array("step"))).withColumn("context", F.concat_ws("\n", "context", block(F.col("shown"), F.col("text")))).withColumn("path_titles", titles)

    def round(self, frontier: DataFrame, visited: DataFrame, selected: DataFrame, step: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        first = frontier.groupBy("qid").agg(F.min("ord").alias("ord"))
        popped = frontier.join(first, ["qid", "ord"])
        rest = frontier.join(first, ["qid", "ord"], "left_anti")
        fresh = cut(popped.join(visited.select("qid", "id"), ["qid", "id"], "left_anti"))
        visited = cut(visited.unionByName(fresh.select("qid", "id")))
        known = selected.groupBy("qid").agg(F.count("*").alias("n_selected"))
        small = self.questions.select("qid", (F.col("mode") == "A").alias("small"))
        tested = fresh.join(small, "qid").join(known, "qid", "left")
        keep = keeps(F.col("score"), F.col("small"), F.col("n_selected"), self.config.trust_threshold, self.config.min_keep)
        kept = cut(tested.where(keep).select(*STATE))
        selected = cut(selected.unionByName(kept.withColumn("step", F.lit(step))))
        new = cut(self.scored(self.candidates(kept, visited)))
        rows = rest.withColumn("part", F.lit(0)).select(*STATE, "part").unionByName(new.withColumn("ord", F.col("new")).withColumn("part", F.lit(1)).select(*STATE, "part"))
        grown = new.select("qid").distinct().withColumn("grown", F.lit(True))
        rows = rows.join(grown, "qid", "left")
        # questions without new rows keep their frontier as it is
        by_score = F.when(F.col("grown"), F.col("score"))
        ranked = top(rows, ["qid"], [F.desc(by_score), F.asc("part"), F.asc("ord")], F.when(F.col("grown"), 2 * self.config.beam_width).otherwise(1 << 30), "place")
        return cut(ranked.withColumn("ord", F.col("place")).select(*STATE)), visited, selected

    def fallback(self, started: DataFrame, selected: DataFrame) -> DataFrame:
        """Evidence for questions that started, found nothing and have a small filter: its best chunks by rerank score."""
        lost = self.questions.where("n_filter > 0 AND mode = 'A'").join(started, "qid", "left_semi").join(selected.select("qid"), "qid", "left_anti")
        best = raw_documents(lost, self.doc_filter, self.graph.chunks, self.models.reranker, self.config.beam_width)
        return best.select("qid", "step", "id", "title", F.lit("").alias("doc_title"), "text", F.col("rerank").alias("score"), F.lit(0).alias("depth"), F.array(F.lit("Fallback (Raw Doc)")).alias("path"), F.array().cast("array<string>").alias("path_titles"))

    def run(self) -> DataFrame:
        frontier = cut(self.start())
        started = cut(frontier.select("qid").distinct())
        visited = frontier.select("qid", "id").limit(0)
        selected = frontier.withColumn("step", F.lit(0)).limit(0)
        for step in range(1, self.config.max_steps + 1):
            if frontier.isEmpty():
                break
            frontier, visited, selected = self.round(frontier, visited, selected, step)
        columns = ["qid", "step", "id", "title", "doc_title", "text", "score", "depth", "path", "path_titles"]
        found = selected.select(*columns)
        if self.doc_filter is not None:
            found = found.unionByName(self.fallback(started, selected))
        return evidence(self.questions, found)


def evidence(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, question, nodes, best_path, best_path_titles): evidence by falling score, then by step."""
    node = F.struct((-F.col("score")).alias("by"), "step", F.struct("id", "title", "doc_title", "text", "score", "depth", "path").alias("node"), "path_titles")
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(node)).alias("n"))  # at most max_steps or beam_width rows
    rows = questions.select("qid", "question").join(lists, "qid", "left")
    nodes = F.coalesce(F.transform("n", lambda x: x["node"]), F.array().cast(f"array<{EVIDENCE}>"))
    path = F.coalesce(F.array_join(F.get("n", F.lit(0))["node"]["path"], " -> "), F.lit(""))
    titles = F.coalesce(F.get("n", F.lit(0))["path_titles"], F.array().cast("array<string>"))
    return rows.select("qid", "question", nodes.alias("nodes"), path.alias("best_path"), titles.alias("best_path_titles"))


def search(graph: KnowledgeGraph, questions: DataFrame, doc_filter: DataFrame | None = None, models: Models | None = None, config: Config | None = None) -> DataFrame:
    """(qid, question, nodes, best_path, best_path_titles) of each question (qid, question and perhaps entities)."""
    return Search.of(graph, questions, doc_filter, models or Models(), config or Config()).run()
