"""The steps of a search, one at a time, on tables where each has something to decide."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.config import Config
from hopweave.functions import answers, scores, text
from hopweave.models import CapitalizedWords, FirstSentence, HashedWords, Models, SameWords, SharedWords, Successive
from hopweave.operators import pagerank, vectors
from hopweave.operators.edges import next_edges
from hopweave.operators.ids import chunk_id
from hopweave.plans import search
from hopweave.plans.build import extracted
from hopweave.sources.lineage import cut

from . import fixtures as fx
from .fixtures import CAPITAL, CHUNKS, MENTIONS, PAIRS, SIMILAR, VECTORS, answer_tokens, strip
from .retrieval import asked
from .texts import BOTH, SAME, STARTS

BEAM = 4


# ---- models and their texts


class NoEmbedder:
    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        return df


class ByQuestion:
    """An embedder that knows the vector of every question and gives it for any text of that question."""

    def __init__(self, known: DataFrame):
        self.known = known.select("qid", F.col("embedding").alias("known_"))

    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        return df.join(self.known, "qid").withColumnRenamed("known_", out)


def relation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the first 3,000 characters, and relations only where there are two of them."""
    rows = extracted(fx.chunks(spark, sf_dir), Models(embedder=NoEmbedder(), entities=CapitalizedWords(), relations=Successive()), Config())
    return rows.select("chunk_id", F.size("entities").cast("long").alias("n_entities"), F.size("rels").cast("long").alias("n_rels"), F.array_join(F.transform("rels", lambda r: F.concat_ws(">", r["source"], r["type"], r["target"])), ",").alias("rels"))


def question_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different names of each question in order; stop words and short names count here."""
    items = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return search.with_entities(items, Models(), Config()).select("qid", F.array_join("entities", ",").alias("entities"))


def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of each turn's vector that aren't zero."""
    rows = HashedWords().embed(fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return rows.select("conv_id", "turn", F.posexplode("embedding").alias("d", "v")).where("v <> 0").withColumn("v", F.col("v").cast("double"))


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against the next ones, each pair scored once."""
    rows = fx.pairs(spark, sf_dir).select("conv_id", "turn", F.col("prediction").alias("query"), F.col("gold").alias("text"))
    return SharedWords().score(rows.union(rows).dropDuplicates(["conv_id", "turn"])).select("conv_id", "turn", F.round("rerank", 6).alias("rerank"))


def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge's reply to short answers, and the verdict that is read from replies of several forms."""
    said = F.substring_index("prediction", " ", 3)
    rows = fx.pairs(spark, sf_dir).select("conv_id", "turn", said.alias("prediction"), F.when(F.col("turn") % 2 == 0, F.concat(said, F.lit(" indeed"))).otherwise(F.substring_index("gold", " ", 3)).alias("ground_truth"))
    told = SameWords().judge(rows)
    form = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("  Well, "), F.upper("verdict"), F.lit("."))).otherwise(F.col("verdict"))
    return told.select("conv_id", "turn", "verdict", answers.judged(form).alias("semantic"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the answer model is asked about each document, its built-in reply, and the answer read from it."""
    docs = fx.documents(spark, sf_dir)
    question = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Is it "), "title", F.lit("?"))).otherwise(F.concat(F.lit("Which is "), "title", F.lit("?")))
    node = lambda t, x: F.struct(t.alias("title"), x.alias("text"))
    nodes = F.when(F.col("doc_id") % 3 == 0, F.array(node(F.col("title"), F.col("text")), node(F.lit("other"), F.lit("More.")))).otherwise(F.array(node(F.col("title"), F.col("text"))))
    rows = docs.withColumn("question", question).withColumn("evidence", nodes)
    rows = rows.withColumn("prompt", answers.prompt(F.col("question"), answers.evidence_block(F.col("evidence")), text.start_step(F.col("title"))))
    told = FirstSentence().answer(rows)
    return told.select("doc_id", F.md5("prompt").alias("prompt"), "raw", answers.post_process(F.col("raw"), F.col("question")).alias("answer"))


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut texts of a search, and the strings of its paths, for each document."""
    q, t = F.col("title"), F.col("text")
    of = {
        "head": text.left(t, 3000), "relation_head": text.left(t, 512), "context_query": text.context_query(q, t), "hybrid_query": text.hybrid_query(q, t), "cache_key": text.cache_key(t, q),
        "path": F.array_join(F.array(text.start_step(q), text.path_step(q, F.lit(False)), text.path_step(q, F.col("doc_id") % 2 == 0)), " -> "), "context": F.concat_ws("\n", text.block(q, t), text.block(q, t)),
    }
    return fx.documents(spark, sf_dir).select("doc_id", *(F.md5(c).alias(name) for name, c in of.items()))


def trust_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as popped chunks: kept by their score, or in a small space as long as fewer than three are."""
    docs, c = fx.table(spark, sf_dir, "documents"), Config()
    score, small, n = (F.col("n_chars") % 100) / 5000, F.col("doc_id") % 2 == 0, F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 7 - 1)
    return docs.select("doc_id", scores.keeps(score, small, n, c.trust_threshold, c.min_keep).alias("kept"))


# ---- where a search starts


def vector_graph(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """Vectors as chunks and summaries; a summary holds the three vectors after it, which may be summaries again."""
    rows = fx.vectors(spark, sf_dir)
    name = lambda c: F.concat(F.col("type"), F.lit("_"), c.cast("string")).alias("id")
    named = cut(rows.select(name(F.col("id")), "type", F.col("id").alias("n"), F.concat(F.lit("title_"), F.col("id").cast("string")).alias("title"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), "embedding"))
    over = named.where("type = 'summary'").select(F.col("id").alias("source"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + 3)).alias("n"))
    edges = cut(over.join(named.select("n", F.col("id").alias("target")), "n").select("source", "target"))
    chunks = named.where("type = 'chunk'").select(F.col("id").alias("chunk_id"), "title", "text")
    return SimpleNamespace(vectors=named.drop("n"), summary_edges=edges, chunks=chunks, numbers=named.select("id", "n"))


def started(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """The seeds of every fiftieth vector; in mode B with a filter of two thirds of all vectors."""
    graph = vector_graph(spark, sf_dir)
    questions = asked(spark, sf_dir).withColumn("mode", F.lit(mode)).withColumn("n_filter", F.lit(1000 if mode == "B" else None).cast("long"))
    doc_filter = questions.select("qid").join(graph.numbers, (F.col("qid") + F.col("n")) % 3 > 0).select("qid", F.col("id").alias("chunk_id")) if mode == "B" else None
    one = search.Search(graph, questions, doc_filter, Models(), Config(beam_width=BEAM), pagerank.NoRanks(), None, None)
    rows = one.seeds(mode)
    return rows.select("qid", "id", "source", "title", "doc_title").distinct()


def seeds_large_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return started(spark, sf_dir, "B")


def seeds_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return started(spark, sf_dir, "C")


def own_filter(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """((qid, question, mode), (qid, chunk_id)): each benchmark item may use 12 chunks."""
    n = fx.table(spark, sf_dir, "documents").count()
    questions = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.lit("A").alias("mode"))
    own = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: chunk_id((F.col("qid") * 31 + i * 17) % n))
    return questions, questions.select("qid", F.explode(own).alias("chunk_id"))


def seeds_small_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, doc_filter = own_filter(spark, sf_dir)
    return search.small_space(questions, doc_filter, fx.chunks(spark, sf_dir)).select("qid", "id", F.md5("text").alias("text"), "doc_title")


def merged_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as seeds: drilled ones repeat, found ones come once and only if they weren't drilled."""
    rows = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), "turn")
    at = lambda part, rank: F.struct(F.lit(part).alias("part"), rank.cast("int").alias("rank"), F.lit("").alias("child")).alias("at")
    name = F.concat(F.lit("t"), (F.col("turn") % 4).cast("string")).alias("id")
    merged = search.merged_seeds(rows.where("turn % 3 = 0").select("qid", at(0, F.col("turn")), name), rows.where("turn % 3 > 0").select("qid", at(1, F.col("turn")), name))
    return merged.select("qid", "id", "source", F.col("at.rank").alias("rank"))


# ---- a round and its end


def visits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, all vectors, visited pairs): a stated set of questions over all vectors."""
    every, q = fx.vectors(spark, sf_dir), asked(spark, sf_dir)
    return q, every, q.select("qid").join(every.select("id"), (F.col("qid") + F.col("id")) % 3 == 0)


def vector_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to each question's context that it hasn't visited."""
    q, every, visited = visits(spark, sf_dir)
    return vectors.unvisited(vectors.search(q, every, BEAM), visited).select("qid", "id", "rank")


def hybrid_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with fewer than three neighbours get chunks by vector; question k has k / 50 modulo 5 neighbours."""
    q, every, visited = visits(spark, sf_dir)
    kept = q.select("qid", F.lit("[title] text").alias("context"), F.lit("what").alias("question"))
    near = kept.select("qid", F.explode(F.sequence(F.lit(0), (F.col("qid") / 50).cast("int") % 5)).alias("k")).where("k > 0")
    graph = SimpleNamespace(vectors=every)
    one = search.Search(graph, kept.select("qid", "question"), None, Models(embedder=ByQuestion(q)), Config(), pagerank.NoRanks(), None, None)
    return one.supplements(kept.drop("question"), near, visited).select("qid", "id", "label")


def candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as questions, documents as candidates: the first 3 x beam, vector hits before neighbours."""
    docs = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), F.concat(F.lit("d"), "doc_id").alias("id"), "doc_id")
    jumps = docs.where("doc_id % 9 = 0").select("qid", "id", F.col("doc_id").alias("rank").cast("int"))
    near = docs.where("doc_id % 9 > 0").select("qid", "id", F.concat(F.lit("L"), F.col("doc_id") % 4).alias("label"), (F.col("doc_id") % 4).cast("int").alias("precedence"))
    return search.first_candidates(jumps, near, BEAM).select("qid", "id", "source", F.col("new").alias("place"))


def evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eight documents as a question's evidence: by falling score, then by step, with the best one's path."""
    docs = fx.documents(spark, sf_dir).join(fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    title = F.col("title")
    found = docs.select(
        F.floor(F.col("doc_id") / 8).alias("qid"), (F.col("doc_id") % 8).cast("int").alias("step"), title.alias("id"), "title", title.alias("doc_title"), F.lit("").alias("text"),
        ((F.col("n_chars") % 3) / 10).alias("score"), F.lit(0).alias("depth"), F.array(text.start_step(title), text.path_step(title, F.lit(True))).alias("path"), F.array("title").alias("path_titles"),
    )
    questions = found.select("qid").distinct().union(spark.range(-3, 0).toDF("qid")).withColumn("question", F.lit("?"))
    out = search.evidence(questions, found)
    return out.select("qid", F.array_join(F.transform("nodes", lambda n: n["id"]), ",").alias("ids"), "best_path", F.array_join("best_path_titles", ",").alias("titles"))


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each question's filter by rerank score alone."""
    questions, doc_filter = own_filter(spark, sf_dir)
    rows = search.raw_documents(questions, doc_filter, fx.chunks(spark, sf_dir), SharedWords(), BEAM)
    return rows.select("qid", "step", "id", "title", F.round("rerank", 6).alias("rerank"))


def walk_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the page rank walk: the order of chunks, likeness at any score, and the first 500 co-mentions."""
    from .graphs import related

    near = related(spark, sf_dir).select(chunk_id(F.col("src")).alias("src"), chunk_id(F.col("dst")).alias("dst"))
    chunks, m = fx.chunks(spark, sf_dir), cut(fx.mentioned(spark, sf_dir))
    return pagerank.walk_edges(next_edges(chunks), near, pagerank.co_mention_edges(m, 500))


HEAD_ENTITIES = f"list_concat({CAPITAL.replace('text,', 'left(text, 3000),')}, list_filter(regexp_extract_all(' ' || regexp_replace(left(text, 3000), '([0-9]+)', ' \\1 ', 'g') || ' ', '[0-9]+'), lambda y: length(y) = 4))"
GATED = f"""
WITH {CHUNKS}, e AS (SELECT chunk_id, {HEAD_ENTITIES} AS e FROM c
), r AS (SELECT chunk_id, e, CASE WHEN len(e) < 2 THEN [] ELSE list_filter(list_transform(range(1, len(e)), lambda i: CASE WHEN lower(e[i]) <> lower(e[i + 1]) THEN lower(e[i]) || '>FOLLOWED_BY>' || lower(e[i + 1]) END), lambda x: x IS NOT NULL) END AS rels FROM e)
SELECT chunk_id, len(e) AS n_entities, len(rels) AS n_rels, array_to_string(rels, ',') AS rels FROM r
"""
SHARED = f"10 * (CASE WHEN len(q) = 0 THEN 0 ELSE len(list_filter(q, lambda w: list_contains(t, w))) / len(q) END) - 5"
CLOSED = f"(regexp_matches({{q}}, '^({STARTS}) ') OR (contains({{q}}, 'same') AND regexp_matches({{q}}, '{SAME}')) OR (contains({{q}}, 'both') AND regexp_matches({{q}}, '{BOTH}')))"
ASKED = """
WITH d AS (
  SELECT doc_id, 'doc_' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'Is it doc_' || doc_id || '?' ELSE 'Which is doc_' || doc_id || '?' END AS q,
    '[doc_' || doc_id || '] ' || text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '[other] More.' ELSE '' END AS ev FROM documents
), p AS (
  SELECT *, doc_id % 2 = 0 AS closed, CASE WHEN doc_id % 2 = 0
    THEN 'Answer the yes/no question from the context alone. Reason in one or two sentences, then write a last line' || chr(10) || 'Answer: yes' || chr(10) || 'or' || chr(10) || 'Answer: no' || chr(10) || chr(10) || 'Context:' || chr(10) || ev || chr(10) || chr(10) || 'Question: ' || q || chr(10)
    ELSE 'Answer the question from the context alone, in one line of the form' || chr(10) || 'Answer: <at most five words>' || chr(10) || chr(10) || 'Path of reasoning:' || chr(10) || 'Start -> ''' || title || '''' || chr(10) || chr(10) || 'Context:' || chr(10) || ev || chr(10) || chr(10) || 'Question: ' || q || chr(10) || 'Answer:' END AS prompt FROM d
)
SELECT doc_id, md5(prompt) AS prompt, 'Answer: ' || CASE WHEN NOT closed THEN title WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END AS raw, CASE WHEN NOT closed THEN title WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END AS answer FROM p
"""
TEXTS = f"""
WITH d AS (SELECT doc_id, 'doc_' || doc_id AS q, text AS t FROM documents)
SELECT doc_id, md5(left(t, 3000)) AS head, md5(left(t, 512)) AS relation_head, md5(q || ' [Context: ' || replace(right(t, 1000), chr(10), ' ') || ']') AS context_query,
  md5(q || ' ' || {strip("replace(left(t, 500), chr(10), ' ')")}) AS hybrid_query, md5(left(t, 100) || '|||' || left(q, 100)) AS cache_key,
  md5('Start -> ''' || q || ''' -> -> ''' || q || ''' -> ' || CASE WHEN doc_id % 2 = 0 THEN '-> [VectorJump] ''' ELSE '-> ''' END || q || '''') AS path, md5('[' || q || '] ' || t || chr(10) || '[' || q || '] ' || t) AS context FROM d
"""
NAMED = f"""{VECTORS}, q AS (SELECT id AS qid, e FROM v WHERE id % 50 = 0
), d AS (SELECT a.qid, b.id AS n, b.type || '_' || b.id AS id, b.type, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM q a, v b
), w AS (SELECT s.id AS n, s.type || '_' || s.id AS source, c.type || '_' || c.id AS target, c.type AS kind FROM v s JOIN v c ON s.type = 'summary' AND c.id BETWEEN s.id + 1 AND s.id + 3
), hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM d
), best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM d WHERE type = 'summary'
), below AS (
  SELECT qid, rank, id AS summary, '' AS via, target AS id FROM best JOIN w ON source = id WHERE kind = 'chunk' AND rank <= {{k}}
  UNION ALL SELECT qid, rank, b.id, x.target, y.target FROM best b JOIN w x ON x.source = b.id AND x.kind = 'summary' JOIN w y ON y.source = x.target AND y.kind = 'chunk' WHERE rank <= {{k}}
), drilled AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, via, id) AS k FROM below) WHERE k <= {{k}})"""
SHOWN = "CASE WHEN source = 'SummaryDrill' THEN source WHEN id LIKE 'chunk%' THEN 'title_' || split_part(id, '_', 2) ELSE '' END AS title, CASE WHEN id LIKE 'chunk%' THEN 'title_' || split_part(id, '_', 2) ELSE '' END AS doc_title"
SEEDS_B = f"""
WITH {NAMED.format(k=2 * BEAM)}, s AS (
  SELECT qid, id, 'SummaryDrill' AS source FROM drilled UNION SELECT qid, id, 'Doc' FROM hits h WHERE rank <= {3 * BEAM} AND NOT EXISTS (SELECT 1 FROM drilled x WHERE x.qid = h.qid AND x.id = h.id))
SELECT DISTINCT qid, id, source, {SHOWN} FROM s WHERE (qid + split_part(id, '_', 2)::BIGINT) % 3 > 0
"""
SEEDS_C = f"""
WITH {NAMED.format(k=BEAM)}, top AS (SELECT * FROM hits WHERE rank <= {2 * BEAM}
), opened AS (SELECT t.qid, t.id FROM top t WHERE type = 'summary' AND NOT EXISTS (SELECT 1 FROM top u JOIN w ON w.source = u.id WHERE u.type = 'summary' AND u.qid = t.qid AND u.rank < t.rank AND w.target = t.id)
), f AS (SELECT qid, id FROM top WHERE type = 'chunk' UNION SELECT qid, target FROM opened JOIN w ON source = id
), s AS (SELECT qid, id, 'SummaryDrill' AS source FROM drilled UNION SELECT qid, id, 'Doc' FROM f WHERE NOT EXISTS (SELECT 1 FROM drilled x WHERE x.qid = f.qid AND x.id = f.id))
SELECT DISTINCT qid, id, source, {SHOWN} FROM s
"""
OWN = f"""{CHUNKS}, n AS (SELECT count(*) AS n FROM documents
), f AS (SELECT DISTINCT item_id AS qid, b.text AS question, 'chunk_' || ((item_id * 31 + i * 17) % n) AS id FROM benchmark b, n, range(0, 12) r(i))"""
VISITED = f"{VECTORS}, d AS (SELECT a.id AS qid, b.id AS id, b.type, {SIMILAR} AS score FROM v a JOIN v b ON true WHERE a.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS spot FROM d)"
WALK = f"""
WITH {MENTIONS}, {VECTORS}, k AS (SELECT a.id AS src, b.id AS dst, {SIMILAR} AS score FROM v a JOIN v b ON a.id <> b.id
), rel AS (SELECT 'chunk_' || src AS src, 'chunk_' || dst AS dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM k) WHERE r <= 3 AND score >= 0.2 AND src < dst
), co AS (SELECT DISTINCT x.chunk_id AS src, y.chunk_id AS dst FROM m x JOIN m y ON x.name = y.name AND x.chunk_id < y.chunk_id ORDER BY 1, 2 LIMIT 500
), one AS (SELECT src, dst FROM rel UNION SELECT src, dst FROM co UNION SELECT a.chunk_id, b.chunk_id FROM c a JOIN c b ON b.pos = a.pos + 1)
SELECT src, dst FROM one UNION SELECT dst, src FROM one
"""

QUERIES = {
    "relation_gate": (relation_gate, GATED),
    "question_entities": (
        question_entities,
        f"WITH e AS (SELECT item_id AS qid, list_transform({HEAD_ENTITIES}, lambda w: lower(w)) AS e FROM benchmark) SELECT qid, array_to_string(list_sort(list_distinct(e)), ',') AS entities FROM e",
    ),
    "embedded_texts": (
        embedded_texts,
        r"""WITH w AS (SELECT conv_id, turn, ('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))), 1, 8))::BIGINT AS h FROM conversations
        ), c AS (SELECT conv_id, turn, (h % 64)::INT AS d, sum(CASE WHEN h >> 31 = 1 THEN 1 ELSE -1 END)::DOUBLE AS n FROM w GROUP BY ALL
        ), z AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL
        ), e AS (SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM z WHERE norm > 0))
        SELECT conv_id, turn, d, (n / norm)::FLOAT::DOUBLE AS v FROM c JOIN z USING (conv_id, turn) WHERE n <> 0 UNION ALL SELECT conv_id, turn, i::INT, 0.125 FROM e, range(0, 64) r(i)""",
    ),
    "rerank": (rerank, f"WITH {PAIRS}, x AS (SELECT conv_id, turn, list_distinct({answer_tokens('prediction')}) AS q, {answer_tokens('gold')} AS t FROM p) SELECT conv_id, turn, round({SHARED}, 6) AS rerank FROM x"),
    "judged_answers": (
        judged_answers,
        f"""WITH {PAIRS}, s AS (SELECT conv_id, turn, array_to_string(string_split(prediction, ' ')[1:3], ' ') AS a, CASE WHEN turn % 2 = 0 THEN array_to_string(string_split(prediction, ' ')[1:3], ' ') || ' indeed' ELSE array_to_string(string_split(gold, ' ')[1:3], ' ') END AS b FROM p
        ), t AS (SELECT conv_id, turn, {answer_tokens('a')} AS p, {answer_tokens('b')} AS g FROM s
        ), y AS (SELECT conv_id, turn, len(p) > 0 AND len(g) > 0 AND (len(list_filter(p, lambda w: NOT list_contains(g, w))) = 0 OR len(list_filter(g, lambda w: NOT list_contains(p, w))) = 0) AS yes FROM t)
        SELECT conv_id, turn, CASE WHEN yes THEN 'yes' ELSE 'no' END AS verdict, CASE WHEN yes THEN 'Consistent' ELSE 'Different' END AS semantic FROM y""",
    ),
    "prompts": (prompts, ASKED),
    "search_texts": (search_texts, TEXTS),
    "trust_gate": (trust_gate, "SELECT doc_id, (n_chars % 100) / 5000 >= 0.01 OR (doc_id % 2 = 0 AND CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 - 1 ELSE 0 END < 3) AS kept FROM documents"),
    "seeds_small_filter": (seeds_small_filter, f"WITH {OWN} SELECT qid, id, md5(text) AS text, title AS doc_title FROM f JOIN c ON chunk_id = id WHERE text <> ''"),
    "seeds_large_filter": (seeds_large_filter, SEEDS_B),
    "seeds_open": (seeds_open, SEEDS_C),
    "merged_seeds": (
        merged_seeds,
        """WITH t AS (SELECT conv_id AS qid, turn, 't' || (turn % 4) AS id FROM conversations)
        SELECT qid, id, 'SummaryDrill' AS source, turn::INT AS rank FROM t WHERE turn % 3 = 0
        UNION ALL SELECT qid, id, 'Doc', min(turn)::INT FROM t WHERE turn % 3 > 0 AND NOT EXISTS (SELECT 1 FROM t x WHERE x.qid = t.qid AND x.id = t.id AND x.turn % 3 = 0) GROUP BY qid, id""",
    ),
    "vector_jump": (vector_jump, f"WITH {VISITED} SELECT qid, id, spot::INT AS rank FROM r WHERE spot <= {BEAM} AND (qid + id) % 3 <> 0"),
    "hybrid_supplement": (
        hybrid_supplement,
        f"WITH {VISITED}, o AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY spot) AS k FROM r WHERE spot <= 10 AND type <> 'summary' AND (qid + id) % 3 <> 0) SELECT qid, id, 'Doc' AS label FROM o WHERE k <= 5 AND (qid // 50) % 5 < 3",
    ),
    "candidate_cap": (
        candidate_cap,
        f"""WITH x AS (SELECT source AS qid, 'd' || doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'VectorJump' ELSE 'L' || (doc_id % 4) END AS source, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE doc_id % 4 END AS a, CASE WHEN doc_id % 9 = 0 THEN doc_id ELSE 0 END AS b, doc_id FROM documents
        ), n AS (SELECT qid, id, source, row_number() OVER (PARTITION BY qid ORDER BY a, b, CASE WHEN a < 0 THEN '' ELSE id END) AS place FROM x) SELECT qid, id, source, place::INT AS place FROM n WHERE place <= {3 * BEAM}""",
    ),
    "evidence_order": (
        evidence_order,
        """WITH f AS (SELECT doc_id // 8 AS qid, doc_id % 8 AS step, 'doc_' || doc_id AS id, (n_chars % 3) / 10 AS score FROM documents
        ), g AS (SELECT qid, string_agg(id, ',' ORDER BY score DESC, step) AS ids, first(id ORDER BY score DESC, step) AS best FROM f GROUP BY qid)
        SELECT qid, ids, 'Start -> ''' || best || ''' -> -> [VectorJump] ''' || best || '''' AS best_path, best AS titles FROM g UNION ALL SELECT i, '', '', '' FROM range(-3, 0) r(i)""",
    ),
    "fallback": (
        fallback,
        f"""WITH {OWN}, x AS (SELECT qid, id, title, list_distinct({answer_tokens('question')}) AS q, {answer_tokens('c.text')} AS t FROM f JOIN c ON chunk_id = id
        ), s AS (SELECT qid, id, title, {SHARED} AS rerank FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, id) AS step FROM s) SELECT qid, step::INT AS step, id, title, round(rerank, 6) AS rerank FROM r WHERE step <= {BEAM}""",
    ),
    "walk_graph": (walk_graph, WALK),
}
