"""Text functions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hopweave.functions import answers, text
from hopweave.functions.answers import BOTH_WORDS, SAME_WORDS, YES_NO_STARTS

from .fixtures import CAPITAL, PAIRS, SCORES, answer_tokens, documents, normalized, pairs, strip, table


def normalize_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.normalize_entity(F.col("text")).alias("name"))


def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_answer(F.col("text")).alias("answer"))


def answer_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("conv_id", "turn", answers.answer_scores(F.col("prediction"), F.col("gold")).alias("s"))
    return rows.select("conv_id", "turn", *(F.round(f"s.{m}", 6).alias(m) for m in ("em", "f1", "prec", "recall")))


def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the first one of its length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    first = docs.groupBy("n_chars").agg(F.min_by("text", "doc_id").alias("gold"))
    return docs.join(first, "n_chars").select("doc_id", (text.normalize_answer(F.col("text")) == text.normalize_answer(F.col("gold"))).alias("em"))


def yes_no_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", answers.is_yes_no(F.col("text")).alias("yes_no"))


def replies(docs: DataFrame) -> DataFrame:
    """Model replies of several kinds made of texts."""
    head, tail = text.left(F.col("text"), 40), F.translate(text.right(F.col("text"), 30), "\n", " ")
    kind = F.col("doc_id") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit("Reasoning: "), head, F.lit('\n Final Answer: "'), tail, F.lit('."')))
        .when(kind == 1, F.concat(head, F.lit("\n\n  The answer is "), tail, F.lit("!  ")))
        .when(kind == 2, F.concat(F.lit("Answer: first\nANSWER: **"), tail, F.lit("**\nAnswer:")))
        .when(kind == 3, F.concat(F.lit("答案："), tail, F.lit("\n"))).otherwise(F.concat(F.lit("It is unknown. "), head))
    )
    question = F.when(F.col("doc_id") % 2 == 0, "Is it so?").otherwise("Which one?")
    return docs.select("doc_id", raw.alias("raw"), question.alias("question"))


def post_process_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(documents(spark, sf_dir)).select("doc_id", answers.post_process(F.col("raw"), F.col("question")).alias("answer"))


def summary_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.summarize(F.col("text"), F.col("title")).alias("summary"))


def parse_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged triples of each three capitalized words; every fifth piece lacks a mark, special marks stand between."""
    words = documents(spark, sf_dir).select("doc_id", text.capital_tokens(F.col("text")).alias("w")).where("size(w) >= 3")
    w = F.col("w")
    piece = lambda i: F.when(i % 5 == 4, F.concat(F.lit("<triplet> "), F.get(w, i), F.lit(" <subj> "), F.get(w, i + 1))).otherwise(
        F.concat(F.lit("<triplet> The "), F.get(w, i), F.lit(" <subj> is "), F.get(w, i + 1), F.lit(" <obj> "), F.get(w, i + 2), F.lit("</s> "))
    )
    tagged = F.concat(F.lit("<s>"), F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 3, F.lit(1)), piece), " "), F.lit("<pad>"))
    rows = words.select("doc_id", tagged.alias("tagged"))
    return rows.select("doc_id", F.posexplode(text.parse_triples(F.col("tagged"))).alias("n", "t")).select("doc_id", "t.source", "t.target", "t.type").distinct()


RAW = """CASE doc_id % 5
    WHEN 0 THEN 'Reasoning: ' || left(text, 40) || chr(10) || ' Final Answer: "' || translate(right(text, 30), chr(10), ' ') || '."'
    WHEN 1 THEN left(text, 40) || chr(10) || chr(10) || '  The answer is ' || translate(right(text, 30), chr(10), ' ') || '!  '
    WHEN 2 THEN 'Answer: first' || chr(10) || 'ANSWER: **' || translate(right(text, 30), chr(10), ' ') || '**' || chr(10) || 'Answer:'
    WHEN 3 THEN '答案：' || translate(right(text, 30), chr(10), ' ') || chr(10) ELSE 'It is unknown. ' || left(text, 40) END"""

POST = f"""
WITH a AS (SELECT doc_id, doc_id % 2 = 0 AS closed, list_filter(list_transform(string_split({RAW}, chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS lines FROM documents
), b AS (
  SELECT doc_id, closed, lines, list_filter(list_transform(lines, lambda x: CASE
    WHEN {strip("regexp_extract(x, '(?is)^.*answer:(.*)$', 1)")} <> '' THEN {strip("regexp_extract(x, '(?is)^.*answer:(.*)$', 1)")}
    ELSE {strip("regexp_extract(x, '(?is)^.*答案：(.*)$', 1)")} END), lambda x: x <> '') AS marked FROM a
), e AS (SELECT doc_id, closed, coalesce(marked[-1], lines[-1], '') AS x FROM b
), g AS (
  SELECT doc_id, closed, {strip("regexp_replace(regexp_replace(x, '^[\"''*`]+|[\"''*`.!]+$', '', 'g'), '(?i)^(the answer is |it is |that is )', '')")} AS x FROM e
)
SELECT doc_id, CASE WHEN NOT closed THEN x WHEN lower(x) LIKE 'yes%' THEN 'yes' WHEN lower(x) LIKE 'no%' THEN 'no' WHEN contains(lower(x), 'yes') THEN 'yes' WHEN contains(lower(x), 'no') THEN 'no' ELSE x END AS answer FROM g
"""


def summary_sql(body: str, hint: str) -> str:
    """A SQL expression for the summary of column `body`."""
    clean = strip(f"replace({body}, chr(10), ' ')")
    out = f"left({clean}, 300)"
    for mark in reversed("。.！!？?"):
        said = f"array_to_string(list_transform(list_filter(list_transform(string_split({clean}, '{mark}')[1:3], lambda p: {strip('p')}), lambda p: p <> ''), lambda p: p || '{mark}'), '')"
        out = f"CASE WHEN contains({clean}, '{mark}') THEN CASE WHEN {said} <> '' THEN {said} ELSE left({clean}, 300) END ELSE {out} END"
    return f"CASE WHEN coalesce({body}, '') = '' THEN '' ELSE '[' || {hint} || '] ' || {out} END"


TRIPLES = f"""
WITH a AS (SELECT doc_id, {CAPITAL} AS w FROM documents
), b AS (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM a WHERE len(w) >= 3
), t AS (SELECT doc_id, lower(w[i + 1]) AS source, lower(w[i + 3]) AS target, 'IS_' || upper(w[i + 2]) AS type FROM b WHERE i % 5 <> 4)
SELECT DISTINCT doc_id, source, target, type FROM t WHERE source <> target
"""

STARTS, SAME, BOTH = ("|".join(x) for x in (YES_NO_STARTS, SAME_WORDS, BOTH_WORDS))

QUERIES = {
    "normalize_entity": (normalize_entity, f"SELECT doc_id, {normalized('text')} AS name FROM documents"),
    "normalize_answer": (normalize_answer, f"SELECT conv_id, turn, array_to_string({answer_tokens('text')}, ' ') AS answer FROM conversations"),
    "answer_f1": (
        answer_f1,
        f"WITH {PAIRS}, tok AS (SELECT conv_id, turn, {answer_tokens('prediction')} AS p, {answer_tokens('gold')} AS g FROM p), {SCORES} SELECT conv_id, turn, round(em, 6) AS em, round(f1, 6) AS f1, round(prec, 6) AS prec, round(recall, 6) AS recall FROM scored",
    ),
    "exact_match": (
        exact_match,
        f"SELECT doc_id, array_to_string({answer_tokens('text')}, ' ') = array_to_string({answer_tokens('gold')}, ' ') AS em FROM documents JOIN (SELECT n_chars, arg_min(text, doc_id) AS gold FROM documents GROUP BY n_chars) USING (n_chars)",
    ),
    "yes_no_classifier": (
        yes_no_classifier,
        f"""WITH q AS (SELECT doc_id, {strip('lower(text)')} AS q FROM documents)
        SELECT doc_id, regexp_matches(q, '^({STARTS}) ') OR (contains(q, 'same') AND regexp_matches(q, '{SAME}')) OR (contains(q, 'both') AND regexp_matches(q, '{BOTH}')) AS yes_no FROM q""",
    ),
    "post_process_answer": (post_process_answer, POST),
    "summary_heuristic": (summary_heuristic, f"SELECT doc_id, {summary_sql('text', chr(39) + 'doc_' + chr(39) + ' || doc_id')} AS summary FROM documents"),
    "parse_triples": (parse_triples, TRIPLES),
}
