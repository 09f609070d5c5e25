"""Substring dedup by sliding sentence spans.

A text is cut into sentences. Spans are runs of sentences: the shortest that starts at each sentence and the shortest
that ends at each, of two sentences at least and 16 words or more together, and each sentence of 16 words or more by
itself. So every sentence of a repeated passage that is long enough for a span lies in one that is whole inside the
passage, the last ones too. The spans of all documents are hashed (128 bits over their words); of a hash that occurs
more than once all but the first occurrence, by document and place, are repeats. Sentences that a repeat covers are
removed from the text; everything else stays byte for byte.

A row is named by its place in the input, so rows of one id are rows of their own, equal ones too. First occurrences go
by id (null ids last), then by the row's place and by the span's.

Half hashes are counted first, combined on the map side, so that only spans whose half occurs twice are stored; those
meet by 96 bits; they are stored as a compressed table. All joins are adaptive, so a passage that a third of all documents share is no single task.
Defined results: null texts stay null; a text of fewer than 16 words has no span and stays; of rows equal in id and text
one is the first, whichever of them; extra columns stay in `dedup`'s result, but for those named
as its own n_sentences and n_removed. Sentences end at Latin and CJK marks and at
line ends; where a script has no spaces each of its characters counts as a word. The input is read three times and must be
the same each time, as a table or a checkpoint is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, small_batches, stored, table

SENTENCES, WORDS = 2, 16
#: A sentence ends after a mark and white space or at a line's end; CJK marks need no white space.
END = re.compile(r"[.!?…][\"'”’)\]]*\s+|\n\s*")
WIDE_MARK = re.compile("[。！？｡]")
WIDE_END = re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？｡][。！？｡\"'”’)\]」』】）]*\s*|\n\s*")
#: Kana, Han and Thai characters.
UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans that cover the text; white space belongs to the sentence before it."""
    out, at = [], 0
    for m in (WIDE_END if WIDE_MARK.search(text) else END).finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def n_words(words: list[str]) -> int:
    return len(words) + sum(len(UNSPACED.findall(w)) for w in words if not w.isascii())


def spans(text: str, least: int = SENTENCES, words: int = WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, hash) of every span."""
    ws = [text[a:b].split() for a, b in sentences(text)]
    sizes = list(map(n_words if UNSPACED.search(text) else len, ws))
    n = len(ws)
    places = {(i, i + 1) for i in range(n) if sizes[i] >= words}
    j, total = 0, 0
    for i in range(n):
        while j < n and (j - i < least or total < words):
            total += sizes[j]
            j += 1
        if j - i < least or total < words:
            break
        places.add((i, j))
        total -= sizes[i]
    i, total = 0, 0
    for j in range(1, n + 1):
        total += sizes[j - 1]
        while j - i > least and total - sizes[i] >= words:
            total -= sizes[i]
            i += 1
        if j - i >= least and total >= words:
            places.add((i, j))
    joined = [" ".join(w) for w in ws]
    return [(i, j, xxhash.xxh3_128_digest(" ".join(joined[i:j]).encode("utf-8", "surrogatepass"))) for i, j in sorted(places)]


def span_table(rows: DataFrame, least: int, words: int) -> DataFrame:
    """(a, b, key, place, i, j) of `rows` (place, key, text): 64 and 32 bits of the span's hash, and where it is."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [spans(t, least, words) for t in batch["text"]]
            of = np.repeat(np.arange(len(found)), [len(f) for f in found])
            digests = b"".join(d for f in found for _, _, d in f)
            at = np.fromiter((x for f in found for i, j, _ in f for x in (i, j)), np.int32).reshape(-1, 2)
            column = lambda c: batch[c].to_numpy()[of]
            yield pd.DataFrame({"a": np.frombuffer(digests, np.int64)[::2], "b": np.frombuffer(digests, np.int32)[2::4], "key": column("key"), "place": column("place"), "i": at[:, 0], "j": at[:, 1]})

    # null ids come last
    last = F.coalesce("key", F.lit((1 << 63) - 1))
    return rows.where("text IS NOT NULL").select("place", last.alias("key"), "text").mapInPandas(made, "a long, b int, key long, place long, i int, j int")


def repeats(rows: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(place, covered): for each of `rows` (place, key, text) with repeats its covered runs of sentences, as an array of (i, j)."""
    found = span_table(rows, least, words)
    # spans are made twice, which costs less than to store all of them
    twice = cut(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    # stored, so that both joins read two plain shuffles and a frequent span's partition can be split
    found = stored(found.join(twice, "a", "left_semi"))
    first = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("key", "place", "i")).alias("first"))
    first = cut(first.where("n > 1").select("a", "b", F.col("first.place").alias("first_place"), F.col("first.i").alias("first_i")))
    again = found.drop("key").join(first, ["a", "b"]).where("place <> first_place OR i <> first_i")
    # a document's own sentences bound its array
    return again.groupBy("place").agg(F.collect_set(F.struct("i", "j")).alias("covered"))


def without(text: str, covered: list) -> tuple[str, int, int]:
    """(the text without the covered sentences, sentences, how many of them were removed)."""
    parts = sentences(text)
    gone = {k for r in covered for k in range(r["i"], r["j"])}
    return "".join(text[a:b] for k, (a, b) in enumerate(parts) if k not in gone), len(parts), len(gone)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """`docs` with cleaned texts, and n_sentences, n_removed (0 for null texts)."""
    small_batches(docs.sparkSession)
    # rows travel as one struct, so columns of any name are safe
    placed = docs.select(F.monotonically_increasing_id().alias("place"), F.struct("*").alias("doc"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    covered = repeats(placed.select("place", "key", "text"), least, words)
    joined = placed.select("place", "doc").join(covered, "place", "left")

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def clean(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0) if t is None else without(t, () if r is None else r) for t, r in zip(texts, runs, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed"])

    found = ["n_sentences", "n_removed"]
    out = joined.withColumn("cleaned", clean(F.col(f"doc.`{text}`"), "covered"))
    kept = [F.col("cleaned.text").alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns if c not in found]
    return out.select(*kept, *(F.col(f"cleaned.{c}") for c in found))


def op9(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
