"""Best-fit packing of documents into fixed-size sequences under conflicts.

Lengths are words. A document longer than a bin is cut into pieces of the bin's size and a rest. Two pieces
conflict if their documents are in one duplicate cluster (copies, or the caller's own clusters), and a bin takes
a limited number of pieces of one source. Open bins are ordered by their residual and carry the clusters in them and the
sources that are used up there as bitmaps. Pieces go longest first; the search starts at the smallest residual
that holds the piece and goes on to the next larger one until the bitmaps allow a bin. The bitmaps are held by
column (for each cluster and source the bins that carry it), so one AND tests all bins of a residual at once.

Documents are dealt by a hash into groups of about GROUP_WORDS words and GROUP_PIECES pieces at most, which are packed
apart, so a group's bins fit in a task; only the last bins of a group stay underfull. A source or a cluster of any size
is spread over all groups. Packing works on narrow rows; texts are joined to its result.

Defined results: null and empty texts have no piece; null sources form one source; repeated rows are documents of
one cluster, told apart by a number; ties go by id (null first), source, text hash and number. A group's packing depends
on its rows alone and a row's group on the row alone, so neither reruns nor other partitions change a bin. Without a
stated limit a source may have FREEDOM times the pieces of a bin that its share of all pieces needs, and SOURCE_LIMIT
at least: few sources can still fill the bins. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import SPACE_SQL, WORD, copies_of, cut, n_words, small_batches, table

CAPACITY, SOURCE_LIMIT, FREEDOM = 2_048, 4, 4
GROUP_WORDS, GROUP_PIECES = 262_144, 32_768


class Bins:
    """Open bins by what is left in them."""

    def __init__(self, capacity: int, source_limit: int):
        self.capacity, self.source_limit = capacity, source_limit
        self.left: list[int] = []
        self.residuals: list[int] = []  # those that some open bin has, rising
        self.of_residual: dict[int, int] = {}  # bitmaps of bins
        self.of_cluster: dict = {}
        self.used_up: dict = {}  # by source
        self.pieces: dict = {}  # by source and bin

    def put(self, size: int, cluster, source) -> int:
        """The tightest bin that holds the piece and allows its cluster and source; a new one if there is none."""
        barred = self.of_cluster.get(cluster, 0) | self.used_up.get(source, 0)
        for i in range(bisect_left(self.residuals, size), len(self.residuals)):
            if free := self.of_residual[self.residuals[i]] & ~barred:
                bin_ = (free & -free).bit_length() - 1
                self.move(bin_, size)
                break
        else:
            bin_ = len(self.left)
            self.left.append(self.capacity)
            self.move(bin_, size)
        bit = 1 << bin_
        if cluster is not None:
            self.of_cluster[cluster] = self.of_cluster.get(cluster, 0) | bit
        n = self.pieces[source, bin_] = self.pieces.get((source, bin_), 0) + 1
        if n >= self.source_limit:
            self.used_up[source] = self.used_up.get(source, 0) | bit
        return bin_

    def move(self, bin_: int, size: int) -> None:
        old, new, bit = self.left[bin_], self.left[bin_] - size, 1 << bin_
        self.left[bin_] = new
        if self.of_residual.get(old, 0) & bit:
            self.of_residual[old] ^= bit
            if not self.of_residual[old]:
                del self.of_residual[old]
                self.residuals.pop(bisect_left(self.residuals, old))
        if new > 0:
            if new not in self.of_residual:
                insort(self.residuals, new)
            self.of_residual[new] = self.of_residual.get(new, 0) | bit


def pack_group(pieces: list[tuple], capacity: int, source_limit: int) -> list[tuple[int, int]]:
    """(bin, slot) of each piece (size, row, piece, cluster, source), in the order given; ties go by row and piece."""
    bins = Bins(capacity, source_limit)
    # only clusters of several pieces can conflict
    seen, several = set(), set()
    for p in pieces:
        (several if p[3] in seen else seen).add(p[3])
    out: list = [None] * len(pieces)
    slots: dict[int, int] = {}
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], pieces[i][1:3])):
        size, _, _, cluster, source = pieces[i]
        b = bins.put(size, cluster if cluster in several else None, source)
        out[i] = (b, slots.get(b, 0))
        slots[b] = slots.get(b, 0) + 1
    return out


NAME = ["key", "source", "text_hash", "other_hash"]


def name_of(key: str, text: str, source: str) -> list:
    return [F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit(1), text).alias("other_hash")]


def packed(rows: DataFrame, capacity: int, source_limit: int) -> DataFrame:
    """A row for each piece of rows (NAME, nth, cluster, words, group): NAME, nth, piece, start_word, n_words, bin_id, slot, bin_words."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        group = int(b["group"].iat[0])
        b = b.sort_values(["no_key", "key", "source", "text_hash", "other_hash", "nth"], ascending=[False, True, True, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
        pieces, starts, of = [], [], []
        for i, (c, s, n) in enumerate(zip(b["cluster"].tolist(), b["source"], b["words"].tolist(), strict=True)):
            for piece, start in enumerate(range(0, n, capacity)):
                pieces.append((min(capacity, n - start), i, piece, c, s if isinstance(s, str) else None))
                starts.append(start)
                of.append(i)
        places = pack_group(pieces, capacity, source_limit)
        out = b.loc[of, ["no_key", *NAME, "nth"]].assign(piece=[p[2] for p in pieces], start_word=starts, n_words=[p[0] for p in pieces], bin_id=[f"{group}-{x}" for x, _ in places], slot=[x for _, x in places])
        out["bin_words"] = out.groupby("bin_id")["n_words"].transform("sum")
        return out

    # a null id is a flag on the way, as pandas has no long with nulls
    rows = rows.withColumn("no_key", F.col("key").isNull()).withColumn("key", F.coalesce("key", F.lit(0)))
    schema = "no_key boolean, key long, source string, text_hash long, other_hash long, nth long, piece int, start_word long, n_words long, bin_id string, slot int, bin_words long"
    out = rows.groupBy("group").applyInPandas(run, schema)
    return out.withColumn("key", F.when(~F.col("no_key"), F.col("key"))).drop("no_key")


def with_texts(plan: DataFrame, docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """The pieces of `plan` with their texts; each different document's text is joined once to all its pieces."""
    same = [F.coalesce("key", F.lit(0)).alias("k_"), F.col("key").isNull().alias("kn_"), F.coalesce("source", F.lit("")).alias("s_"), F.col("source").isNull().alias("sn_"), "text_hash", "other_hash"]
    on = ["k_", "kn_", "s_", "sn_", "text_hash", "other_hash"]
    piece = ["piece", "start_word", "n_words", "bin_id", "slot", "bin_words"]
    of = plan.groupBy(*NAME, "nth").agg(F.array_sort(F.collect_list(F.struct(*piece))).alias("pieces")).select(*same, "key", "source", "pieces")
    whole = docs.select(*name_of(key, text, source), F.col(text).alias("text")).select(*same, "text").groupBy(*on).agg(F.any_value("text").alias("text"))
    rows = of.join(whole, on).select("key", "source", "pieces", "text")

    @F.pandas_udf("array<string>")
    def cuts(texts: pd.Series, pieces: pd.Series) -> pd.Series:
        out = []
        for t, ps in zip(texts, pieces, strict=True):
            spans = [m.span() for m in WORD.finditer(t)] if t is not None else []
            out.append([t[spans[p["start_word"]][0] : spans[p["start_word"] + p["n_words"] - 1][1]] for p in ps] if spans else None)
        return pd.Series(out)

    # only documents of several pieces leave the JVM
    several = F.size("pieces") > 1
    whole_text = F.array(F.expr(f"trim(BOTH '{SPACE_SQL}' FROM text)"))
    parts = F.coalesce(cuts(F.when(several, F.col("text")), F.when(several, F.transform("pieces", lambda p: F.struct(p["start_word"].alias("start_word"), p["n_words"].alias("n_words"))))), whole_text)
    rows = rows.withColumn("parts", parts).select("key", "source", F.posexplode("pieces").alias("at", "p"), "parts")
    return rows.select("key", "source", "p.*", F.get("parts", F.col("at")).alias("text"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, capacity: int = CAPACITY, source_limit: int | None = None, texts: bool = False) -> DataFrame:
    """A row for each piece: key, source, piece, start_word, n_words, bin_id, slot, bin_words, and with `texts` its text."""
    small_batches(docs.sparkSession)
    own = F.col("text_hash") if cluster is None else F.xxhash64(F.coalesce(F.col(cluster).cast("string"), F.concat_ws(" ", F.lit("own"), F.col(key).cast("string"), F.xxhash64(text).cast("string"))))
    rows = docs.select(*name_of(key, text, source), n_words(F.col(text)).alias("words"), *([] if cluster is None else [own.alias("cluster")])).where("words > 0")
    rows = rows if cluster else rows.withColumn("cluster", own)
    rows = cut(rows.groupBy(*NAME, "cluster", "words").agg(F.count("*").alias("n")))
    pieces = F.ceil(F.col("words") / capacity) * F.col("n")
    of_source = rows.groupBy("source").agg(F.sum(pieces).alias("pieces"), F.sum(F.col("words") * F.col("n")).alias("words"))
    size = of_source.agg(F.max("pieces").alias("most"), F.sum("pieces").alias("pieces"), F.sum("words").alias("words")).first()
    if source_limit is None:
        source_limit = max(SOURCE_LIMIT, -(-FREEDOM * (size["most"] or 0) // max(1, -(-(size["words"] or 0) // capacity))))
    groups = max(1, -(-(size["words"] or 0) // GROUP_WORDS), -(-(size["pieces"] or 0) // GROUP_PIECES))
    rows = copies_of(rows, "n", "nth")
    plan = packed(rows.withColumn("group", F.pmod(F.xxhash64(*NAME, "nth"), F.lit(groups))), capacity, source_limit)
    plan = with_texts(plan, docs, key, text, source) if texts else plan.drop("text_hash", "other_hash", "nth")
    return plan.withColumnRenamed("key", key)


def op5(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
