"""Interfaces of the models that the engine calls, each with a deterministic built-in.

A model takes and returns DataFrames, so it decides itself how its work is dealt out. Models of one's own put their
inference into `mapInPandas` and need only the method named here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hopweave.functions.answers import is_yes_no
from hopweave.functions.text import answer_tokens, capital_tokens, left


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        """`df` with an array of floats of length one."""


class EntityExtractor(Protocol):
    def extract(self, df: DataFrame, text: str = "text", out: str = "entities") -> DataFrame:
        """`df` with array<struct<name,type>>."""


class RelationExtractor(Protocol):
    def extract(self, df: DataFrame, text: str = "text", entities: str = "entities", out: str = "triples") -> DataFrame:
        """`df` with tagged triples as one string."""


class Reranker(Protocol):
    def score(self, pairs: DataFrame, query: str = "query", text: str = "text", out: str = "rerank") -> DataFrame:
        """`pairs` with a score of any range."""


class Summarizer(Protocol):
    def summarize(self, df: DataFrame, text: str = "text", hint: str = "hint", out: str = "summary") -> DataFrame:
        """`df` with a reply, null where there was an error."""


class AnswerGenerator(Protocol):
    def answer(self, df: DataFrame, out: str = "raw") -> DataFrame:
        """`df` (question, prompt, evidence) with a reply."""


class Judge(Protocol):
    def judge(self, df: DataFrame, out: str = "verdict") -> DataFrame:
        """`df` (prediction, ground_truth) with a reply that holds yes or not."""


TOKEN = re.compile(r"\w+")


def hashed(text: str | None, dim: int) -> np.ndarray:
    """Signed counts of the hashed words, of length one; an even vector for a text without words."""
    x = np.zeros(dim)
    for w in TOKEN.findall((text or "").lower()):
        h = int.from_bytes(md5(w.encode("utf-8", "surrogatepass")).digest()[:4], "big")
        x[h % dim] += 1 if h >> 31 else -1
    if not x.any():
        x[:] = 1
    return x / np.sqrt((x * x).sum())


@dataclass
class HashedWords:
    """Embedder: a hashed bag of words."""

    dim: int = 64

    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: hashed(t, dim).astype(np.float32))

        return df.withColumn(out, embed(F.col(text)))


@dataclass
class CapitalizedWords:
    """Entity extractor: capitalized words are concepts, numbers of four digits dates; names of `kinds` have their own type."""

    chars: int = 3000
    kinds: dict[str, str] = field(default_factory=dict)

    def extract(self, df: DataFrame, text: str = "text", out: str = "entities") -> DataFrame:
        head = left(F.col(text), self.chars)
        kind: Column = F.lit("Concept")
        table = F.create_map(*(F.lit(x) for kv in self.kinds.items() for x in kv)) if self.kinds else None
        named = lambda w: F.coalesce(table[F.lower(w)], kind) if table is not None else kind
        words = F.transform(capital_tokens(head), lambda w: F.struct(w.alias("name"), named(w).alias("type")))
        years = F.transform(F.regexp_extract_all(F.coalesce(head, F.lit("")), F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])")), lambda y: F.struct(y.alias("name"), F.lit("Date").alias("type")))
        return df.withColumn(out, F.concat(words, years))


@dataclass
class Successive:
    """Relation extractor: each entity is followed by the next one of the text."""

    relation: str = "followed by"

    def extract(self, df: DataFrame, text: str = "text", entities: str = "entities", out: str = "triples") -> DataFrame:
        e = F.transform(F.col(entities), lambda x: x["name"])
        one = lambda a, b: F.concat(F.lit("<triplet> "), a, F.lit(f" <subj> {self.relation} <obj> "), b)
        pairs = F.zip_with(e, F.slice(e, 2, F.greatest(F.size(e), F.lit(1))), one)
        return df.withColumn(out, F.array_join(pairs, " "))  # nulls, after the last one, are left out


@dataclass
class SharedWords:
    """Reranker: ten times the share of the query's different words that the text has, less five."""

    def score(self, pairs: DataFrame, query: str = "query", text: str = "text", out: str = "rerank") -> DataFrame:
        q, t = F.array_distinct(answer_tokens(F.col(query))), answer_tokens(F.col(text))
        share = F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0))
        return pairs.withColumn(out, 10 * share - 5)


@dataclass
class FirstSentence:
    """Answer generator: yes or no by whether there is evidence, else the best evidence's title."""

    def answer(self, df: DataFrame, out: str = "raw") -> DataFrame:
        title = F.coalesce(F.get("evidence", F.lit(0))["title"], F.lit(""))
        reply = F.when(is_yes_no(F.col("question")), F.when(F.size("evidence") > 1, "yes").otherwise("no")).otherwise(title)
        return df.withColumn(out, F.concat(F.lit("Answer: "), reply))


@dataclass
class SameWords:
    """Judge: yes where one answer's words are among the other's."""

    def judge(self, df: DataFrame, out: str = "verdict") -> DataFrame:
        p, g = answer_tokens(F.col("prediction")), answer_tokens(F.col("ground_truth"))
        within = (F.size(F.array_except(p, g)) == 0) | (F.size(F.array_except(g, p)) == 0)
        return df.withColumn(out, F.when(within & (F.size(p) > 0) & (F.size(g) > 0), "yes").otherwise("no"))


@dataclass
class Models:
    embedder: Embedder = field(default_factory=HashedWords)
    entities: EntityExtractor = field(default_factory=CapitalizedWords)
    relations: RelationExtractor = field(default_factory=Successive)
    reranker: Reranker = field(default_factory=SharedWords)
    answers: AnswerGenerator = field(default_factory=FirstSentence)
    judge: Judge | None = None
    #: None takes the heuristic of functions.text.
    summarizer: Summarizer | None = None
