"""Text functions over columns; all of them run inside the JVM.

Java's ``\\w`` and ``\\s`` know only ASCII, so patterns carry (?U) where other alphabets count.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"(?U)\s+"
TRIPLE_FIELDS = ("head", "relation", "tail")


def strip(c: Column) -> Column:
    """Without white space at both ends; SQL's trim only knows blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_entity(c: Column) -> Column:
    """Lower-cased, without one leading article and without anything but word characters and white space."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)^(the|a|an)\s+", "")
    return strip(F.regexp_replace(plain, r"(?U)[^\w\s]", ""))


def keeps_entity(name: Column, for_query: bool = False, min_length: int = 2, stopwords: tuple[str, ...] = ()) -> Column:
    """Whether a normalized name counts: long enough, and in an index no stop word and no number but a year's four digits."""
    long_enough = F.length(name) >= (1 if for_query else max(1, min_length))
    if for_query:
        return long_enough
    number = name.rlike(r"(?U)^\d+$") & (F.length(name) != 4)
    return long_enough & ~number & (~name.isin(*stopwords) if stopwords else F.lit(True))


def answer_tokens(c: Column) -> Column:
    """The words that answers are compared by: no case, dashes as blanks, no ASCII punctuation, no articles."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[-–—]", " ")
    plain = F.regexp_replace(plain, r"""[!-/:-@\[-`{-~]""", "")
    return F.filter(F.split(plain, SPACE), lambda w: ~w.isin("", "a", "an", "the"))


def normalize_answer(c: Column) -> Column:
    return F.array_join(answer_tokens(c), " ")


def capital_tokens(c: Column) -> Column:
    """The capitalized words of four letters or more, in the order of the text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[^A-Za-zÀ-ÿ]+"), lambda w: w.rlike("^[A-Z][a-z]{3,}$"))


def left(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def right(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def flat(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def context_query(question: Column, context: Column) -> Column:
    """What neighbours are ranked against: the question with the end of its context."""
    return F.concat(question, F.lit(" [Context: "), flat(right(context, 1000)), F.lit("]"))


def hybrid_query(question: Column, context: Column) -> Column:
    """What supplements are searched by: the question with the beginning of its context."""
    return F.concat_ws(" ", question, strip(flat(left(context, 500))))


def cache_key(query: Column, text: Column) -> Column:
    """The name of a reranked pair by the beginnings of both texts, for callers that keep scores between runs.

    The search itself ranks each pair (question, chunk) once, by their ids, so that texts with equal beginnings differ.
    """
    return F.concat(left(query, 100), F.lit("|||"), left(text, 100))


def start_step(title: Column) -> Column:
    return F.concat(F.lit("Start -> '"), title, F.lit("'"))


def path_step(title: Column, jump: Column) -> Column:
    return F.concat(F.when(jump, "-> [VectorJump] '").otherwise("-> '"), title, F.lit("'"))


def block(title: Column, text: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit("] "), text)


def summarize(text: Column, hint: Column) -> Column:
    """``[hint] `` and the first sentences of a text, or its first 300 characters; empty for an empty text.

    Sentences end at the first mark of a fixed list that the text holds; blank ones of the first three are left out.
    """
    clean = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    out = left(clean, 300)

    def first_three(mark: str) -> Column:
        parts = F.transform(F.slice(F.split(clean, f"[{mark}]"), 1, 3), strip)
        return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(p, F.lit(mark))), "")

    for mark in reversed("。.！!？?"):
        said = first_three(mark)
        out = F.when(F.contains(clean, F.lit(mark)), F.when(said != "", said).otherwise(left(clean, 300))).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit("["), hint, F.lit("] "), out))


def parse_triples(c: Column, fields: tuple[str, str, str] = TRIPLE_FIELDS) -> Column:
    """array<struct<source,target,type>> from tagged triples: ``<triplet> 1 <subj> 2 <obj> 3``.

    `fields` names what stands at 1, 2 and 3. Pieces without both marks, with an empty or with equal ends are left
    out; of several marks in a piece only the first of each kind counts.
    """
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "</?s>|<pad>", "")

    def one(piece: Column) -> Column:
        rest = F.get(F.split(piece, "<subj>"), F.lit(1))
        at = dict(zip(fields, (F.get(F.split(piece, "<subj>"), F.lit(0)), F.get(F.split(rest, "<obj>"), F.lit(0)), F.get(F.split(rest, "<obj>"), F.lit(1))), strict=True))
        kind = F.replace(F.upper(strip(at["relation"])), F.lit(" "), F.lit("_"))
        return F.struct(normalize_entity(strip(at["head"])).alias("source"), normalize_entity(strip(at["tail"])).alias("target"), kind.alias("type"), F.contains(rest, F.lit("<obj>")).alias("whole"))

    made = F.filter(F.transform(F.split(text, "<triplet>"), one), lambda t: F.coalesce(t["whole"], F.lit(False)) & (t["source"] != "") & (t["target"] != "") & (t["source"] != t["target"]))
    return F.transform(made, lambda t: F.struct(t["source"].alias("source"), t["target"].alias("target"), t["type"].alias("type")))
