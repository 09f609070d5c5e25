"""Questions, answers and their measures over columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import let, overlap
from .text import answer_tokens, normalize_answer, strip

# Fixed values that results depend on.
YES_NO_STARTS = ("are", "is", "was", "were", "do", "does", "did", "can", "could", "would", "will", "has", "have", "had")
SAME_WORDS = ("nationality", "country", "type", "category", "genre", "year", "time")
BOTH_WORDS = ("are", "were", "born", "died", "from")
CLOSED_ANSWERS = ("yes", "no", "noanswer")
NO_ANSWER = "i don't know"


def holds_any(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def is_yes_no(question: Column) -> Column:
    """By its first word, or by ``same`` or ``both`` with one of some words anywhere."""
    q = strip(F.lower(question))
    same = F.contains(q, F.lit("same")) & holds_any(q, SAME_WORDS)
    both = F.contains(q, F.lit("both")) & holds_any(q, BOTH_WORDS)
    return q.rlike("^(" + "|".join(YES_NO_STARTS) + ") ") | same | both


def post_process(raw: Column, question: Column) -> Column:
    """The short answer in a model's reply: after the last marker, else the last line, cleaned; yes or no for such questions."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), strip), lambda x: x != "")
    after = lambda x, marker: strip(F.regexp_extract(x, f"(?isU)^.*{marker}(.*)$", 1))
    marked = F.transform(lines, lambda x: F.when(after(x, "answer:") != "", after(x, "answer:")).otherwise(after(x, "答案：")))
    found = F.filter(marked, lambda x: x != "")
    answer = F.coalesce(F.get(found, F.size(found) - 1), F.get(lines, F.size(lines) - 1), F.lit(""))
    answer = F.regexp_replace(answer, r"""^["'*`]+|["'*`.!]+$""", "")
    answer = strip(F.regexp_replace(answer, "(?i)^(the answer is |it is |that is )", ""))
    low = F.lower(answer)
    closed = F.when(low.startswith("yes"), "yes").when(low.startswith("no"), "no").when(F.contains(low, F.lit("yes")), "yes").when(F.contains(low, F.lit("no")), "no")
    return F.when(F.coalesce(is_yes_no(question), F.lit(False)), F.coalesce(closed, answer)).otherwise(answer)


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def answer_scores(prediction: Column, gold: Column) -> Column:
    """struct<em,f1,prec,recall>; zeros where one side is yes, no or noanswer and the other differs.

    Tokens are taken from each text once and counted in linear time, so long texts may be compared too.
    """

    def scores(t: Column) -> Column:
        return let(F.struct(overlap(t["p"], t["g"]).alias("same"), F.size(t["p"]).alias("np"), F.size(t["g"]).alias("ng"), F.array_join(t["p"], " ").alias("a"), F.array_join(t["g"], " ").alias("b")), of)

    def of(n: Column) -> Column:
        closed = (n["a"].isin(*CLOSED_ANSWERS) | n["b"].isin(*CLOSED_ANSWERS)) & (n["a"] != n["b"])
        prec, recall = F.try_divide(n["same"], n["np"]), F.try_divide(n["same"], n["ng"])
        value = lambda x: F.when(~closed & (n["same"] > 0), x).otherwise(0.0).cast("double")
        return F.struct((n["a"] == n["b"]).cast("double").alias("em"), value(harmonic(prec, recall)).alias("f1"), value(prec).alias("prec"), value(recall).alias("recall"))

    return let(F.struct(answer_tokens(prediction).alias("p"), answer_tokens(gold).alias("g")), scores)


def set_scores(prediction: Column, gold: Column) -> Column:
    """struct<em,f1,prec,recall> of two sets; an empty side gives 0."""
    p, g = F.array_distinct(prediction), F.array_distinct(gold)
    same = F.size(F.array_intersect(p, g))
    prec, recall = (F.coalesce(F.try_divide(same, F.size(x)), F.lit(0.0)) for x in (p, g))
    em = ((same == F.size(p)) & (same == F.size(g))).cast("double")
    return F.struct(em.alias("em"), harmonic(prec, recall).alias("f1"), prec.alias("prec"), recall.alias("recall"))


def joint_scores(answer: Column, support: Column) -> Column:
    prec, recall = answer["prec"] * support["prec"], answer["recall"] * support["recall"]
    return F.struct((answer["em"] * support["em"]).alias("em"), harmonic(prec, recall).alias("f1"), prec.alias("prec"), recall.alias("recall"))


def hits(support: Column, retrieved: Column, path: Column) -> Column:
    """struct<hit_titles,retrieval_hit,bridge_hit,path_hit> from three arrays of titles."""
    s = F.array_distinct(support)
    found, on_path = F.array_sort(F.array_intersect(s, retrieved)), F.array_intersect(s, path)
    needed = F.least(F.lit(2), F.size(s))
    some = F.size(s) > 0
    return F.struct(found.alias("hit_titles"), (some & (F.size(found) >= 1)).alias("retrieval_hit"), (some & (F.size(found) >= needed)).alias("bridge_hit"), (some & (F.size(on_path) >= needed)).alias("path_hit"))


def gives_up(prediction: Column, legacy: bool = False) -> Column:
    """Whether the normalized prediction says that it doesn't know.

    Normalizing drops the apostrophe, so `legacy`, which looks for the phrase with it, is never true.
    """
    phrase = NO_ANSWER if legacy else NO_ANSWER.replace("'", "")
    return F.contains(normalize_answer(prediction), F.lit(phrase))


def asks_judge(prediction: Column, f1: Column, legacy: bool = False) -> Column:
    return (f1 < 0.8) & (strip(prediction) != "") & ~gives_up(prediction, legacy)


def judged(reply: Column) -> Column:
    return F.when(F.contains(F.lower(strip(reply)), F.lit("yes")), "Consistent").otherwise("Different")


def status(prediction: Column, f1: Column, semantic: Column, legacy: bool = False) -> Column:
    return (
        F.when(semantic == "Consistent", "Sem-Match").when(gives_up(prediction, legacy), "IDK")
        .when(f1 >= 0.5, "High F1").when(f1 > 0, "Low F1").otherwise("MISS")
    )


def evidence_block(titles_and_texts: Column) -> Column:
    """``[title] text`` of each struct, blank lines between."""
    return F.array_join(F.transform(titles_and_texts, lambda n: F.concat(F.lit("["), n["title"], F.lit("] "), n["text"])), "\n\n")


def prompt(question: Column, evidence: Column, path: Column) -> Column:
    """What the answer model is asked: yes/no questions allow a short reasoning, others get the path and one line."""
    closed = F.concat(
        F.lit("Answer the yes/no question from the context alone. Reason in one or two sentences, then write a last line\nAnswer: yes\nor\nAnswer: no\n\nContext:\n"),
        evidence, F.lit("\n\nQuestion: "), question, F.lit("\n"),
    )
    short = F.concat(
        F.lit("Answer the question from the context alone, in one line of the form\nAnswer: <at most five words>\n\nPath of reasoning:\n"),
        path, F.lit("\n\nContext:\n"), evidence, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"),
    )
    return F.when(is_yes_no(question), closed).otherwise(short)
