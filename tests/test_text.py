"""Scalar functions against literals and against models in plain Python."""

import re
import string
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hopweave.config import ENTITY_STOPWORDS
from hopweave.functions import answers, scores, text


def run(spark, f, rows, *names):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.orderBy("i").select(f(*(F.col(n) for n in names)).alias("out")).collect()]


def entity_model(s):
    s = re.sub(r"^(the|a|an)\s+", "", (s or "").lower())
    return re.sub(r"[^\w\s]", "", s).strip()


def answer_model(s):
    s = re.sub(r"[-–—]", " ", (s or "").lower())
    s = "".join(c for c in s if c not in string.punctuation)
    return [w for w in s.split() if w not in ("a", "an", "the")]


WORDS = ["The cat", " the cat", "A  an apple", "Élan, café!", "anthem", "", None, "the", "U.S. — 1969-1974", "o'neill\tx", "naïve\n the end", "THE THE THE", "a_b"]


def test_normalize_entity(spark):
    assert run(spark, text.normalize_entity, [(w,) for w in WORDS], "t") == [entity_model(w) for w in WORDS]


def test_normalize_answer(spark):
    assert run(spark, text.normalize_answer, [(w,) for w in WORDS], "t") == [" ".join(answer_model(w)) for w in WORDS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("aeThe -–.!'é\t", max_size=30), min_size=20, max_size=40))
def test_normalizers_on_random_texts(spark, texts):
    assert run(spark, text.normalize_answer, [(w,) for w in texts], "t") == [" ".join(answer_model(w)) for w in texts]
    assert run(spark, text.normalize_entity, [(w,) for w in texts], "t") == [entity_model(w) for w in texts]


def test_entity_filter(spark):
    names = ["x", "ab", "year", "1999", "12", "12345", "person", "ok name"]
    index = run(spark, lambda c: text.keeps_entity(c, False, 2, ENTITY_STOPWORDS), [(n,) for n in names], "n")
    assert index == [False, True, False, True, False, False, False, True]
    assert run(spark, lambda c: text.keeps_entity(c, True), [(n,) for n in names], "n") == [True] * 8


def scores_model(p, g):
    a, b = answer_model(p), answer_model(g)
    same = sum((Counter(a) & Counter(b)).values())
    closed = ("yes", "no", "noanswer")
    x, y = " ".join(a), " ".join(b)
    if (x in closed or y in closed) and x != y or not same:
        return (float(x == y), 0.0, 0.0, 0.0)
    prec, recall = same / len(a), same / len(b)
    return (float(x == y), 2 * prec * recall / (prec + recall), prec, recall)


PAIRS = [("yes", "no"), ("Yes.", "yes"), ("the 1969-74 war", "1969 74"), ("b b c", "b c c"), ("", ""), (None, "x"), ("no one", "no"), ("noanswer", "noanswer")]


def test_answer_scores(spark):
    got = run(spark, answers.answer_scores, PAIRS, "p", "g")
    for r, pair in zip(got, PAIRS, strict=True):
        assert tuple(r) == pytest.approx(scores_model(*pair)), pair


def test_yes_no(spark):
    qs = ["Is it?", " were they of the same height", "What is the same genre?", "Which both died?", "Isn't it", "Who", "do it"]
    assert run(spark, answers.is_yes_no, [(q,) for q in qs], "q") == [True, True, True, True, False, False, True]


def test_post_process(spark):
    cases = [
        ("Reasoning: x\nAnswer: One\nAnswer: **Two.**", "Who?", "Two"), ("no marker here\n\n last line! ", "Who?", "last line"), ("Final Answer: the answer is 1990.", "Who?", "1990"),
        ("Answer: Unknown", "Is it?", "no"), ("Answer: It is Yes, sure", "Is it?", "yes"), ("Answer:\n", "Who?", "Answer:"), ("", "Who?", ""), ("答案：北京", "Who?", "北京"), ("Answer: first\nfinal answer:", "Who?", "first"),
    ]
    assert run(spark, answers.post_process, [c[:2] for c in cases], "raw", "q") == [c[2] for c in cases]


def test_summaries(spark):
    cases = [("One. Two. Three. Four.", "[h] One.Two.Three."), ("", ""), ("no end", "[h] no end"), ("x" * 400, "[h] " + "x" * 300), ("Hm! What? Yes", "[h] Hm!What? Yes!"), ("。", "[h] 。"), ("a\nb. ", "[h] a b.")]
    assert run(spark, lambda t: text.summarize(t, F.lit("h")), [(c[0],) for c in cases], "t") == [c[1] for c in cases]


def test_triples(spark):
    tagged = "<s><triplet> The Eiffel Tower <subj> located in <obj> Paris <triplet> Paris <subj> x <triplet> A <subj> is <obj> a <triplet> B <subj> of <obj> C <obj> D</s><pad>"
    got = run(spark, text.parse_triples, [(tagged,), ("",), (None,)], "t")
    assert [tuple(x) for x in got[0]] == [("eiffel tower", "paris", "LOCATED_IN"), ("b", "c", "OF")]
    assert got[1:] == [[], []]
    swapped = run(spark, lambda c: text.parse_triples(c, ("head", "tail", "relation")), [("<triplet> A b <subj> C <obj> rel of",)], "t")
    assert [tuple(x) for x in swapped[0]] == [("b", "c", "REL_OF")]


def test_hits_and_status(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "z"], ["a", "b"]), ([], ["x"], []), (["a"], ["a"], [])], "s array<string>, r array<string>, p array<string>")
    got = [tuple(x[0]) for x in df.select(answers.hits(F.col("s"), F.col("r"), F.col("p"))).collect()]
    assert got == [(["b"], True, False, True), ([], False, False, False), (["a"], True, True, False)]
    cases = [("I don't know", 0.0, "N/A", "IDK"), ("x", 0.5, "N/A", "High F1"), ("x", 0.1, "N/A", "Low F1"), ("x", 0.0, "N/A", "MISS"), ("x", 0.0, "Consistent", "Sem-Match")]
    rows = spark.createDataFrame([c[:3] for c in cases], "p string, f double, s string")
    assert [r[0] for r in rows.select(answers.status(F.col("p"), F.col("f"), F.col("s"))).collect()] == [c[3] for c in cases]
    assert [r[0] for r in rows.select(answers.status(F.col("p"), F.col("f"), F.col("s"), legacy=True)).collect()][0] == "MISS"


def test_trust_bounds(spark):
    """The least score that a row can have is far above the default threshold."""
    df = spark.createDataFrame([(-1e6, d, p) for d in (0, 1, 2) for p in (0.0, None)], "r double, d int, p double")
    got = [r[0] for r in df.select(scores.trust(F.col("r"), F.col("p"), F.lit("text"), F.array(F.lit("zzz")), F.col("d"), F.lit("Seq"))).collect()]
    assert got == pytest.approx([0.2495, 0.2925, 0.23385, 0.27293, 0.22181, 0.25788], abs=1e-4)
