"""The training-data operators against brute force, on fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from hopweave.llm import ann, common, fingerprints, mixing, neardup, packing, pii, quality, registry, sharding, substrings, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, fp long, group string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def corpus(n=60, seed=1):
    """Rows with copies, near copies, null and empty texts, a long one, a hot source and repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "naïve", "«x»", "a@b.co", "😀"]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    out = [(None, "no id"), (3_000, None), (3_001, ""), (3_002, " \n\t "), (3_003, "one"), (3_004, text(9_000))]
    out += [(i, text(rng.randint(1, 120))) for i in range(n)]
    base = text(90)
    out += [(1_000 + i, base) for i in range(6)] + [(1_100 + i, " ".join([*base.split()[:-1], f"x{i}"])) for i in range(4)]
    out += [(2_000, "same row"), (2_000, "same row"), (2_001, "two texts"), (2_001, "of one id")]
    return [(i, t, "en", None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 5}", len(t) if t else 0, "k", 1, 2, "g", "s") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def rows():
    return corpus()


# ---- 1 sharding


def test_sharding_against_splitting_buckets(docs, rows):
    limit = 4_000
    got = sharding.shards(docs, limit=limit).toPandas()
    assert len(got) == len(rows)
    items = [(None if i is None else i, int(hashlib.md5(str("null" if i is None else i).encode()).hexdigest()[:15], 16), len((t or "").encode())) for i, t, *_ in rows]

    def split(prefix, held):
        total = sum(b for _, _, b in held)
        if total <= limit or len(held) == 1 or len(prefix) == 60:
            return [(i, prefix, total, len(held)) for i, _, _ in held]
        side = lambda bit: split(prefix + bit, [x for x in held if format(x[1], "060b")[len(prefix)] == bit])
        return side("0") + side("1")

    want = Counter((i, p, b, n) for i, p, b, n in split("", items))
    assert Counter((None if pd.isna(r.doc_id) else r.doc_id, r.shard.split(".")[0], r.shard_bytes, r.shard_docs) for r in got.itertuples()) == want


def test_sharding_of_rows_that_share_all_bits(spark):
    df = spark.createDataFrame([(7, "x" * 100)] * 50, "doc_id long, text string")
    got = sharding.shards(df, limit=500).toPandas()
    sizes = got.groupby("shard")["n_bytes"].sum()
    assert len(got) == 50 and sizes.max() <= 500
    assert sharding.shards(df.limit(0)).count() == 0


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "x"), limit=4_000)
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(str(tmp_path / "x"))
    rows = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    assert rows(back) == rows(docs)


def test_shards_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(7, "x" * 100)] * 50 + [(None, "y" * 80)] * 30 + [(i, "z" * 60) for i in range(40)], "doc_id long, text string")
    rows = lambda d: Counter(tuple(r) for r in sharding.shards(d, limit=500).collect())
    assert rows(df) == rows(df.repartition(7))


def test_numbers_of_equal_rows(spark):
    df = spark.range(0, 500, 1, 7).withColumn("k", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5)).withColumn("p", F.monotonically_increasing_id())
    got = common.numbered(df, ["k"], "p", "nth").toPandas()
    for _, g in got.groupby("k", dropna=False):
        assert sorted(g["nth"]) == list(range(1, len(g) + 1))


def test_rows_of_one_id_are_split_by_measured_bytes(spark, tmp_path):
    """Null and repeated ids with long texts: each shard fits or holds one row, says its own size, and is written once."""
    rng = random.Random(31)
    rows = [(None, "n" * rng.randint(1, 900) + str(i)) for i in range(60)] + [(7, "x" * 300)] * 30 + [(7, "y" * 5_000)] * 2 + [(i, "z" * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shards(df, limit=1_000).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("shard"):
        assert len(g) == 1 or g["n_bytes"].sum() <= 1_000
        assert set(g["shard_bytes"]) == {g["n_bytes"].sum()} and set(g["shard_docs"]) == {len(g)}
    sharding.write_shards(df, str(tmp_path / "x"), limit=1_000)
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(str(tmp_path / "x"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)


# ---- 2 quality


def test_quality_on_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    hide = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0
    got = quality.score(docs, labels.where(~hide)).join(labels.where(hide), "doc_id").toPandas()
    assert len(got) > 50 and (got["good"] == (got["quality"] == 1)).mean() > 0.9


def test_quality_defined_results(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    empty = got[got["doc_id"].isin([3_000, 3_001, 3_002])]
    assert (empty["score"] == 0).all() and not empty["good"].any()
    kept = quality.keep_good(docs, labels)
    good = got[got["good"]]
    assert kept.columns == docs.columns and kept.count() == len(good) and kept.where("doc_id IS NULL").count() == good["doc_id"].isna().sum()
    one_class = quality.score(docs, labels.where("quality = 1")).toPandas()
    assert (one_class.set_index("doc_id").loc[[3_003, 3_004], "score"] == 1).all()
    assert quality.score(docs.limit(0), labels).count() == 0


def two_views(spark, n=1_200):
    """Documents whose words and whose source both tell their quality, most of the time; a sixth has labels."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        told, sourced = (good if rng.random() < 0.97 else not good for _ in range(2))
        words = [rng.choice(["river", "stone", "garden", "letter"] if told else ["buy", "cheap", "click", "now"]) if rng.random() < 0.5 else f"w{rng.randint(0, 300)}" for _ in range(rng.randint(8, 20))]
        rows.append((i, " ".join(words), "en", "press" if sourced else "spam", 100))
        if i % 6 == 0 or i > n - 200:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_views_exchange_labels(spark):
    """Each view learns from labels that the other one gave, and tells the classes apart by itself."""
    docs, labels = two_views(spark)
    rows = quality.features(docs, labels, "doc_id", "text", "quality")
    alone, taught = quality.train(rows, rounds=0), quality.train(rows)
    assert alone.history == [] and {view for _, view, n0, n1, stays in taught.history if n0 + n1 > 0 and stays}
    for view in ("text", "meta"):
        gave = [(n0, n1) for _, v, n0, n1, _ in taught.history if v == view]
        assert max(a + b for a, b in gave) > 10
    assert any(not np.allclose(getattr(alone, v), getattr(taught, v)) for v in ("text", "meta"))
    got = quality.score(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    for column in ("text_score", "meta_score", "score"):
        assert ((got[column] > 0.5) == (got["quality"] == 1)).mean() > 0.85, column
    # the words that tell quality are no shapes: without them the text view knows little
    assert np.abs(taught.text[quality.TEXT_SHAPES :]).max() > 0.1


def test_learning_pass_against_direct_sums(spark):
    docs, labels = two_views(spark, 500)
    rows = quality.features(docs, labels, "doc_id", "text", "quality")
    model = quality.train(rows, rounds=0)
    limits = quality.sure(rows, model)
    got = quality.learning_pass(rows, model, limits)
    b = rows.where("y IS NULL AND words").toPandas()
    z = dict(zip(("text", "meta"), model.views(b), strict=True))
    assert limits["text", 1] >= np.quantile(z["text"], 0.93) and limits["meta", 0] <= np.quantile(z["meta"], 0.5)
    for view, other, x in (("text", "meta", model.texts(b)), ("meta", "text", quality.meta_matrix(b))):
        for c in (0, 1):
            held = z[other] >= limits[other, 1] if c else z[other] <= limits[other, 0]
            slope, n = got[view, c]
            p = 1 / (1 + np.exp(-(x[held] @ getattr(model, view))))
            assert n == held.sum() and slope == pytest.approx(x[held].T @ (c - p), abs=1e-2)


def test_word_counts_against_a_loop():
    def model(text):
        words, half = text.lower().split(), quality.TEXT_WORDS // 2
        mask = (1 << 64) - 1
        spread = lambda x: (((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & mask) >> 40
        power, powers = 1, []
        for _ in range(1024):
            power = power * 0x9E3779B97F4A7C15 & mask
            powers.append(power)
        h = [sum((ord(c) + 1) * powers[i % 1024] for i, c in enumerate(w)) & mask for w in words]
        pairs = [(a * 0xC2B2AE3D27D4EB4F + b) & mask for a, b in zip(h, h[1:])]
        counts = Counter(spread(x) % half for x in h) + Counter(half + spread(x) % half for x in pairs)
        return bytes(min(255, round(quality.COUNT_STEPS * math.log1p(counts[i]))) for i in range(quality.TEXT_WORDS))

    for t in ("a", " one two  one\ttwo\n", "naïve É 😀 " * 30, "x" * 3_000 + " y", "w " * 5_000):
        assert quality.word_counts(t) == model(t)


# ---- 3 url filters


def judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else "allow"


def test_urls_against_brute_force(spark):
    hosts = ["ORG", "a.org", "example.org", "X.Example.Org", "notexample.org", "com", "b.com", "", "org.com", "a..com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/fr/", "/fr/a#b", "/de/", "?q=/de/", "#/es/", "//es/"]
    made = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths] + [None, "", "no scheme/es/", "a://b://c.org/x", "http://É.org/es/"]
    df = spark.createDataFrame(list(enumerate(made)) + [(0, made[0])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(1))
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urls.filter_urls(df, urls.RULES).select("page_id", "host", "path", "rule", "verdict").collect())
    want = [(i, *judge(u, urls.RULES)) for i, u in [*enumerate(made), (0, made[0])]]
    assert got == sorted((i, h, p, r or "", v) for i, h, p, r, v in want)
    assert {r.verdict for r in urls.filter_urls(df, ()).collect()} == {"allow"}
    assert urls.filter_urls(df.limit(0), urls.RULES).count() == 0


# ---- 4 fingerprints


def edited_model(text, other):
    m = len(text) // 3
    return text[: len(text) - m] + other[:m]


def test_fingerprints_of_edits(spark, docs, rows):
    described = fingerprints.describe(docs.where("doc_id <> 2001 OR doc_id IS NULL")).cache()
    got = described.toPandas()
    ordered = sorted(((i, t or "") for i, t, *_ in rows if i != 2_001), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert len(got) == len(ordered)
    by_text = {}
    for k, (i, t) in enumerate(ordered):
        other = ordered[k - 1][1]
        r = got[got["doc_id"].isna()] if i is None else got[got["doc_id"] == i]
        sha = hashlib.sha256(edited_model(t, other).encode()).hexdigest()
        assert sha in set(r["edited_sha256"]) and (r["n_chars"] == len(t)).all(), i
        by_text.setdefault(t, set()).update(r["fingerprint"])
        bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        for x in r.itertuples():
            assert x.near_edited == pytest.approx(bits(x.fingerprint, x.edited_fingerprint))
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[""] == {"0" * 32} and by_text[" \n\t "] == {"0" * 32}
    near = got.set_index("doc_id")
    copies = near.loc[1_001, "fingerprint"]
    assert all((int(near.loc[1_100 + i, "fingerprint"], 16) ^ int(copies, 16)).bit_count() < 40 for i in range(4))
    counted = fingerprints.with_neighbours(described, asked=2).toPandas()
    assert len(counted) == len(got)
    prints = [int(x, 16) for x in got["fingerprint"]]
    for r in counted.itertuples():
        asked = not pd.isna(r.doc_id) and r.doc_id % 2 == 0
        want = sum((int(r.fingerprint, 16) ^ x).bit_count() <= 3 for x in prints) - 1 if asked else None
        assert (r.n_near == want) if asked else pd.isna(r.n_near)
    assert fingerprints.with_neighbours(fingerprints.describe(docs.limit(0))).count() == 0
    one = fingerprints.describe(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_next_documents_over_many_partitions(spark):
    """Each row's next one is that before it in the order of ids, whatever the partitions, also among rows of one id."""
    rows = [(None if i % 7 == 0 else 13 if i % 3 == 0 else i, f"text {i} " * (1 + i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    placed = df.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").alias("key"), "text").cache()
    at = {r.place: (r.key, r.text) for r in placed.collect()}
    links = {r.place: r.next_place for r in fingerprints.successors(placed).collect()}
    order = sorted(at, key=lambda p: (at[p][0] is not None, at[p][0] or 0, hashes[at[p][1]], p))
    assert links == {p: order[k - 1] for k, p in enumerate(order)}


def test_fingerprints_of_long_repetitive_texts(spark):
    """Every term votes for the same bits, so a text of 40,000 equal words has the fingerprint of five."""
    df = spark.createDataFrame([(1, "w " * 40_000), (2, "w " * 5)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.votes(df, ["doc_id"], "text").collect()}
    assert got[1] == got[2] != "0" * 32


def test_fingerprint_search_finds_all(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(30)]
    near = [b ^ sum(1 << x for x in rng.sample(range(128), k)) for b in base for k in (0, 1, 3, 4, 8)]
    df = spark.createDataFrame([(i, f"{x:032x}") for i, x in enumerate(base + near)], "doc_id long, fingerprint string")
    for radius, spare in ((3, 1), (4, 2)):
        got = {(r.query, r.found_fingerprint, r.distance) for r in fingerprints.search(df.where("doc_id < 30"), df, radius, spare).collect()}
        want = {(i, f"{y:032x}", (x ^ y).bit_count()) for i, x in enumerate(base) for y in base + near if (x ^ y).bit_count() <= radius}
        assert got == want


# ---- 5 packing


def test_packing_keeps_all_words_and_conflicts(spark, docs, rows):
    got = packing.pack(docs, capacity=300, source_limit=3, texts=True).toPandas()
    want = Counter(w for _, t, *_ in rows for w in words_of(t))
    assert Counter(w for t in got["text"] for w in words_of(t)) == want
    assert all(len(words_of(r.text)) == r.n_words for r in got.itertuples())
    by_bin = got.groupby("bin_id")
    assert (by_bin["n_words"].sum() <= 300).all() and (by_bin["n_words"].sum() == by_bin["bin_words"].first()).all()
    assert (got.groupby(["bin_id", got["source"].fillna("null")]).size() <= 3).all()
    texts = {(i, t) for i, t, *_ in rows if i is not None and 1_000 <= i < 1_100}
    copies = got[got["doc_id"].isin([i for i, _ in texts])]
    assert copies["bin_id"].is_unique  # copies never share a bin
    again = packing.pack(docs.repartition(7), capacity=300, source_limit=3, texts=True).toPandas()
    columns = ["bin_id", "slot", "n_words", "text"]
    assert sorted(map(tuple, got[columns].values)) == sorted(map(tuple, again[columns].values))
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_fit_against_brute_force():
    rng = random.Random(2)
    pieces = [(rng.randint(1, 60), k, 0, f"c{rng.randint(0, 25)}", f"s{rng.randint(0, 3)}") for k in range(150)]
    bins = []  # (left, clusters, sources)
    want = {}
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], pieces[i][1:3])):
        size, *_, cluster, source = pieces[i]
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= size and cluster not in b[1] and b[2][source] < 4]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([100, set(), Counter()])
        bins[k][0] -= size
        bins[k][1].add(cluster)
        bins[k][2][source] += 1
        want[i] = k
    got = packing.pack_group(pieces, 100, 4)
    assert [b for b, _ in got] == [want[i] for i in range(len(pieces))]


def test_packing_many_tiny_documents_of_one_source(spark):
    """Bins are full and found in seconds; partitions don't change a bin."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"), F.lit("one").alias("source"))
    began = time.time()
    got = packing.pack(df).toPandas()
    assert time.time() - began < 20 and got["n_words"].sum() == 20_000 and got["bin_id"].nunique() <= 12
    again = packing.pack(df.repartition(7)).toPandas()
    assert got.set_index("doc_id")["bin_id"].to_dict() == again.set_index("doc_id")["bin_id"].to_dict()


@pytest.mark.parametrize("sources", [1, 20])
def test_packing_fills_bins(spark, sources):
    rng = random.Random(sources)
    rows = [(i, " ".join([f"x{i}"] * max(1, int(rng.lognormvariate(4.5, 1.2)))), f"s{i % sources}") for i in range(3_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert got["n_words"].sum() / (packing.CAPACITY * got["bin_id"].nunique()) > 0.95


# ---- 6 personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_model(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(t)], "ip": [m.span() for m in IP.finditer(t) if all(int(x) < 256 for x in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))], "phone": [m.span() for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15],
    }


def noise(seed):
    rng = random.Random(seed)
    bits = ["a@b.co", "x.y@", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "00", ".", "-", " ", "\n", "é", "9" * 30, "0", "a.b.c@d.e.f", "%+-@x-.y", "12", "3-4", "٣", "１"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))


def test_base_spans_equal_the_patterns():
    for seed in range(4_000):
        t = noise(seed)
        assert pii.base_spans(t) == base_model(t), (seed, t)
        base, every = pii.find(t)
        assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("mail jane [at] site [dot] org now", "email", "jane [at] site [dot] org"), ("write to jane.doe at example dot com today", "email", "jane.doe at example dot com"), ("call ｊａｎｅ@site.org", "email", "ｊａｎｅ@site.org"),
        ("card 4１11 1111 1111 1111 ok", "card", "4１11 1111 1111 1111"), ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"), ("jаne@site.org", "email", "jаne@site.org"), ("a​b@c.org", "email", "a​b@c.org"),
    ],
)
def test_disguises_map_back(text, kind, hidden):
    _, every = pii.find(text)
    at = text.index(hidden)
    assert (at, at + len(hidden)) in every[kind] or any(text[a:b] == hidden for a, b in every[kind]), every


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("dns eight dot eight dot eight dot eight is up", "ip", "eight dot eight dot eight dot eight"), ("host 192 dot 168 dot 1 dot 20 is down", "ip", "192 dot 168 dot 1 dot 20"),
        ("card four dash one dash one dash one dash one dash one dash one dash one dash one dash one dash one dash one dash one dash one dash one dash one ok", "card", "four" + " dash one" * 15),
        ("card 4111 dash 1111 dash 1111 dash 1111 ok", "card", "4111 dash 1111 dash 1111 dash 1111"), ("call plus 1 555 123 4567 today", "phone", "plus 1 555 123 4567"),
        ("write to jane at example dot it today", "email", "jane at example dot it"), ("write to jane at example dot nl", "email", "jane at example dot nl"), ("jane at example dot photography, please", "email", "jane at example dot photography"),
        ("jane at mail dot example dot co dot uk now", "email", "jane at mail dot example dot co dot uk"), ("jane arroba ejemplo punto lat hoy", "email", "jane arroba ejemplo punto lat"), ("jane at example.ca now", "email", "jane at example.ca"),
        *((f"mail jane at example dot {x} now", "email", f"jane at example dot {x}") for x in "ca ru dev app test".split()),
        ("call +49 30 12345 six seven eight now", "phone", "+49 30 12345 six seven eight"), ("card 41111 one one one one one one one one one one one ok", "card", "41111" + " one" * 11),
        ("ticket 1234567 one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_more_disguises_map_back(text, kind, hidden):
    assert [text[a:b] for a, b in pii.find(text)[1][kind]] == [hidden]


def test_prose_with_dots_and_dashes_has_no_spans():
    for t in ("They met at boiling point it was said", "The error at script.py, the one at user.id", "a look at red dot on paper", "stay at home.It was late", "from point 5 to point 6", "at this point in time, at noon. Then", "pages 12 dash 15"):
        assert not any(pii.find(t)[1].values()), (t, pii.find(t)[1])


def test_parts_of_thousands_of_digits():
    """Python refuses to convert numbers of over 4,300 digits."""
    for t in ("0" * 5_000 + "1.2.3.4", "9" * 5_000 + ".2.3.4", "1.2.3." + "0" * 4_999 + "7", "x " + "1" * 9_000 + " +" + "2" * 6_000):
        assert pii.base_spans(t)["ip"] == ([(0, len(t))] if t[0] != "9" and t[0] != "x" else [])
        assert pii.find(t)[1]["card"] == []


def test_clean_texts_have_no_spans():
    for t in ("We met at the dot com era, one two three times.", "Look at example dot com in the year two thousand", "Sections 1.2 and 3.4, 12 of 14", "at dot at dot", "", None, "one two three four five"):
        base, every = pii.find(t)
        assert not any(every.values()) or t is not None and "example" in t, (t, every)


def test_pii_query_rows(docs, rows):
    got = pii.detect(docs).toPandas()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, *_ in rows:
        base = base_model(t or "")
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, pii.KINDS.index(k), b, k) for k, s in base.items() for a, b in s))
        want[(i, len(base["email"]), hashlib.sha256(line.encode()).hexdigest())] += 1
    assert Counter((None if pd.isna(r.doc_id) else r.doc_id, r.n_email, r.base_sha256) for r in got.itertuples()) == want
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.where("text LIKE '%a@b.co%'").count() == 0
    assert clean.where("text IS NULL").count() == 1 and clean.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    assert pii.detect(docs.limit(0)).count() == 0


# ---- 7 mixing


def targets_model(sizes, weights, most=3.0):
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        for i in over or open_:
            out[i] = most * sizes[i] if over else left * weights[i] / total
        if not over:
            return out
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def test_mixing_meets_targets(docs, rows):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words_of(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, targets_model([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    for s, part in got.groupby(got["source"].map(lambda x: None if pd.isna(x) else x), dropna=False):
        s = None if pd.isna(s) else s
        assert part["target"].iloc[0] == pytest.approx(want[s]) and (part["source_size"] == sizes[s]).all()
        taken = (part["copies"] * part["size"]).sum()
        assert abs(taken - want[s]) <= part["size"].max()
        assert (part["copies"] <= 3).all()
    again = mixing.mix(docs.repartition(3)).toPandas()
    assert Counter(zip(got["doc_id"].fillna(-1), got["text_hash"], got["copies"], strict=True)) == Counter(zip(again["doc_id"].fillna(-1), again["text_hash"], again["copies"], strict=True))
    assert mixing.mix(docs.limit(0)).count() == 0
    taken = mixing.take(docs)
    assert taken.columns == docs.columns


def test_pivots_keep_expectations_and_words(spark):
    size, p = np.array([5, 9, 2, 7, 4]), np.array([0.3, 0.5, 0.9, 0.2, 0.6])
    rng = random.Random(3)
    runs = [(k, [(int(size[i]), i, 0, 0, 1, float(p[i]), rng.random()) for i in range(5)]) for k in range(4_000)]
    df = spark.createDataFrame(runs, f"k int, items array<{mixing.ITEM}>").select(mixing.pivots(F.col("items")).alias("r"))
    total = np.zeros(5)
    for r in df.select("r.held", "r.done").collect():
        out = np.zeros(5)
        for d in r.done:
            out[d["item"]["key"]] = d["up"]
        if r.held is not None:
            assert 0 < r.held.p < 1 and len(r.done) == 4
            out[r.held.key] = r.held.p
        assert (out @ size) == pytest.approx(p @ size)
        total += out
    assert total / 4_000 == pytest.approx(p, abs=0.04)


def test_mixing_has_no_python_and_no_source_limit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    df = spark.createDataFrame([(i % 400, "w " * (1 + i % 9), f"s{i % 50}" if i % 51 else None) for i in range(900)], "doc_id long, text string, source string")
    plan = mixing.mix(df)
    assert "Python" not in plan._jdf.queryExecution().toString() and "Pandas" not in plan._jdf.queryExecution().toString()
    got = plan.toPandas()
    assert len(got) == 900 and got["source"].isna().sum() == 18
    sizes = got.groupby(got["source"].fillna("~"))["size"].sum().sort_index()
    want = targets_model(list(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert got.groupby(got["source"].fillna("~"))["target"].first().sort_index().tolist() == pytest.approx(want)


def test_copies_of_one_row_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 10)
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10), ("d", 57), ("e", -1)], "k string, n long")
    got = Counter((r.k, r.i) for r in common.copies_of(df, "n", "i").collect())
    assert got == Counter([("b", 1)] + [("c", i) for i in range(1, 11)] + [("d", i) for i in range(1, 58)])


def test_mixing_over_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "s0" if i % 3 else "s1") for i in range(500)], "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    for _, part in got.groupby("source"):
        assert abs((part["copies"] * part["size"]).sum() - part["target"].iloc[0]) <= 7


# ---- 8 near duplicates


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def print_model(text):
    w = words_of(lower(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components_model(prints):
    """prints: id -> set of fingerprints."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] < label[a] and any((x ^ y).bit_count() <= 4 for x in prints[a] for y in prints[b]):
                    label[a], changed = label[b], True
    return label


def test_neardup_fingerprints_and_groups(docs, rows):
    got = neardup.group(docs.where("doc_id IS NOT NULL AND doc_id <> 2001")).toPandas()
    prints = {}
    for i, t, *_ in rows:
        if i is not None and i != 2_001:
            prints.setdefault(i, set()).add(print_model(t))
    label = components_model(prints)
    assert len(got) == sum(1 for i, *_ in rows if i is not None and i != 2_001)
    for r in got.itertuples():
        assert int(r.fingerprint, 16) in prints[r.doc_id] and r.component_id == label[r.doc_id], r
    assert neardup.group(docs.limit(0)).count() == 0
    with_null = neardup.group(docs).toPandas()
    assert len(with_null) == len(rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and set(kept.where("doc_id >= 1000 AND doc_id < 1100").toPandas()["doc_id"]) == {1_000}


def test_one_row_of_each_component_stays(spark):
    """Null and repeated ids, single ones and whole groups, lose no component; each keeps one row, always the same."""
    rng = random.Random(21)
    text = lambda k=80: " ".join(f"t{rng.randint(0, 10**6)}" for _ in range(k))
    alone, nulls, mixed = text(), text(), text()
    rows = [(None, alone), (None, nulls), (None, nulls), (None, nulls), (None, mixed), (8, mixed), (7, mixed), (7, mixed)]
    rows += [(5, text()) for _ in range(3)] + [(i, text()) for i in (1, 2)] + [(None, text()) for _ in range(20)]
    rows += [(None, None), (None, ""), (9, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("i", F.lit(1))
    kept = [(r.doc_id, r.text) for r in neardup.keep_one(df).collect()]
    assert neardup.keep_one(df).columns == df.columns
    prints = [print_model(t) for _, t in rows]
    label = components_model(dict(enumerate({p} for p in prints)))
    assert len(kept) == len(set(label.values()))
    assert {label[rows.index(k)] for k in kept} == set(label.values())
    assert (None, alone) in kept and (None, nulls) in kept and (7, mixed) in kept and (9, " ") in kept
    again = [(r.doc_id, r.text) for r in neardup.keep_one(df.orderBy(F.desc("text")).repartition(3)).collect()]
    assert Counter(kept) == Counter(again)


def test_chains_through_null_ids(spark, monkeypatch):
    """1 and 2 are near only to a text without an id."""
    bits = {"a": 0, "b": 0b111, "c": 0b111111, "d": -1}
    monkeypatch.setattr(neardup, "with_fingerprints", lambda docs, key, text: docs.select(key, F.create_map(*(F.lit(x) for kv in bits.items() for x in kv))[F.col(text)].cast("long").alias("fp")))
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint[-2:]): r.component_id for r in neardup.group(df).collect()}
    assert got == {(1, "00"): 1, (None, "07"): 1, (2, "3f"): 1, (None, "ff"): None}


@pytest.mark.parametrize("shard", [1024, 8])
def test_neardup_links_of_close_fingerprints(spark, shard):
    """Chains, stars and a block value that all share, whole and dealt into parts."""
    rng = random.Random(6)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 3, 4, 5, 9])))
    fps |= {(0xABC << 52) | rng.getrandbits(52) for _ in range(60)} | {(0xABC << 52) | 1 << b for b in range(20)}
    fps = sorted(fps)
    ids = list(range(len(fps)))
    rng.shuffle(ids)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, ids, strict=True)), "fp long, id long")
    links = neardup.shard_links(df, 4, shard)
    got = dict.fromkeys(ids)
    got.update({r.node: r.component for r in common.connected_components(links).collect()})
    label = components_model({i: {f} for f, i in zip(fps, ids, strict=True)})
    assert {i: c if c is not None else i for i, c in got.items()} == label


# ---- 9 substrings


def dedup_model(rows, least=2, words=16):
    """Texts after removal, by (id, text) in order of the input."""
    spans = {}
    for row, (i, t) in enumerate(rows):
        if t is None:
            continue
        cut = [t[a:b] for a, b in substrings.sentences(t)]
        name = (i is None, i or 0, row)
        for a in range(len(cut)):
            b, n = a, 0
            while b < len(cut) and (b - a < least or n < words):
                n += len(cut[b].split())
                b += 1
            if b - a >= least and n >= words:
                spans.setdefault(" ".join(" ".join(cut[a:b]).split()), []).append((name, a, b))
    gone = {}
    for places in spans.values():
        first = min(places)[:2]
        for name, a, b in places:
            if (name, a) != first and len(places) > 1:
                gone.setdefault(name[-1], set()).update(range(a, b))
    out = []
    for row, (i, t) in enumerate(rows):
        cut = [t[a:b] for a, b in substrings.sentences(t)] if t is not None else []
        out.append((i, None if t is None else "".join(s for k, s in enumerate(cut) if k not in gone.get(row, ()))))
    return out


def test_substring_dedup(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choices([f"v{i}" for i in range(300)], k=rng.randint(4, 14))).capitalize() + rng.choice([". ", "! ", ".\n", "\n"])
    shared = "".join(sentence() for _ in range(9))
    rows = []
    for i in range(30):
        body = [sentence() for _ in range(rng.randint(1, 12))]
        if i % 3 == 0:
            body.insert(rng.randint(0, len(body)), shared)
        rows.append((i, "".join(body)))
    rows += [(40, shared + shared), (41, None), (42, ""), (43, "short. text."), (None, shared), (44, "   "), (45, shared[:80])]
    # equal rows, rows of one id with other texts, of no id too
    rows += [(5, shared), (5, "Only here. " + sentence() + sentence()), (50, shared), (50, shared), (50, shared), (None, rows[1][1]), (None, rows[1][1]), (None, "A sentence of no id that stays as it is, because it occurs nowhere else in here, never. It has two.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("i", F.lit(1)).withColumn("key", F.lit(2)).withColumn("h", F.lit(3))
    got = substrings.dedup(df)
    assert set(df.columns) < set(got.columns)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in got.collect())
    assert found == sorted((i is None, i or 0, t is None, t or "") for i, t in dedup_model(rows))
    assert sum(shared.strip() in (r.text or "") for r in got.collect()) == 1
    assert substrings.dedup(df.limit(0)).count() == 0


def test_substring_dedup_covers_whole_passages(spark):
    """No sentence that is whole inside a repeat of 50 words or more stays: tails, text ends and single sentences too."""
    rng = random.Random(18)
    line = lambda k, tag: " ".join(f"{tag}{rng.randint(0, 10**6)}" for _ in range(k)) + ". "
    passages = [[line(k, "p") for k in sizes] for sizes in [(10, 10, 2), (25, 30, 1, 1), (9, 9, 3, 40, 2, 2), (50,), (16, 60)] + [tuple(rng.randint(1, 25) for _ in range(8)) for _ in range(6)]]
    bare = line(60, "bare")[:-2]
    rows = [(1, bare), (2, bare)]
    for k, p in enumerate(passages):
        own = [line(20, "o") for _ in range(4)]
        rows += [(10 + 10 * k + i, a + "".join(p) + b) for i, (a, b) in enumerate([("", ""), ("", ""), (own[0], own[1]), (own[2], ""), ("", own[3])])]
    got = {r.doc_id: r.text for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == bare and got[2] == ""
    for k, p in enumerate(passages):
        texts = [got[10 + 10 * k + i] for i in range(5)]
        assert texts[0] == "".join(p)
        assert not [s for s in p for t in texts[1:] if s.strip() in t], k
        assert texts[1] == "" and [len(t.split()) for t in texts[2:]] == [40, 20, 20]


def test_texts_without_spaces_have_sentences(spark):
    rng = random.Random(2)
    line = lambda: "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(20)) + "。"
    shared = [line(), line(), line()]
    rows = [(1, line() + "".join(shared)), (2, "".join(shared) + line()), (3, line())]
    got = {r.doc_id: r.text for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1][len("".join(shared)) :] and got[3] == rows[2][1]


# ---- 10 nearest neighbours


def distance(v, x):
    total = 0.0
    for a, b in zip(v, x, strict=True):  # sum() would compensate for rounding
        total += (a - b) * (a - b)
    return math.sqrt(total)


def nearest_model(items, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((distance(v, x), i) for i, x in items if i != q and len(x) == len(v))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("cells", [3, 12])
def test_vantage_points_are_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(ann, "LEAF", 8)
    monkeypatch.setattr(ann, "LEAST_CELLS", cells)
    monkeypatch.setattr(ann, "SHARD", 20)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    x = np.random.default_rng(1).normal(size=(300, 5)).round(1)
    x[50:90] = x[50]  # ties and a single distance
    good = [(i, v.tolist()) for i, v in enumerate(x) if v.any()] + [(900, [1.0, 2.0]), (901, [1.5, 2.0])]
    bad = [(700, None), (701, []), (702, [0.0] * 5), (703, [1.0, None, 0.0, 0.0, 0.0]), (704, [float("inf")] * 5), (705, [float("nan")] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("id", F.lit(0)).withColumn("block", F.lit(0))
    got = ann.nearest(df, df.where("vec_id % 100 = 0 OR vec_id >= 700"))
    want = nearest_model(good, [(i, v) for i, v in good if i % 100 == 0 or i >= 700], 10)
    found = sorted(tuple(r) for r in got.collect())
    assert [f[:3] for f in found] == [w[:3] for w in sorted(want)]
    assert [f[3] for f in found] == pytest.approx([w[3] for w in sorted(want)], abs=0)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    loose = {(r.query_id, r.vec_id) for r in ann.nearest(df, df.where("vec_id % 100 = 0"), factor=1.3).collect()}
    assert len(loose & {(w[0], w[2]) for w in want}) >= 0.9 * len({(w[0], w[2]) for w in want if w[0] % 100 == 0})


def test_block_tables_keep_shards_small():
    """Copies of a fingerprint stay bounded, and an even shard small, however many fingerprints there are."""
    for n in (10**3, 10**6, 10**7, 10**9, 10**10, 10**12):
        tables = neardup.block_tables(4, n, 1024)
        bits = min(sum(b - a for a, b in t) for t in tables)
        assert len(tables) <= 70 and n / 2**bits <= 1024
        # every 4 changed bits leave one table alone
        rng = random.Random(n)
        for _ in range(200):
            flipped = rng.sample(range(64), 4)
            assert any(not any(a <= f < b for f in flipped for a, b in t) for t in tables)


def test_query_rows_of_one_id(spark):
    """Two vectors of one query id are answered each, whatever the order of the rows; equal query rows once."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(1, 80)]
    asked = [(100, [0.5, 0.5, 0.0, 0.1]), (100, [-1.0, 0.0, 0.3, 0.2]), (100, [0.5, 0.5, 0.0, 0.1])]
    answers = []
    for order in (asked, asked[::-1]):
        df = spark.createDataFrame(rows + order, "vec_id long, embedding array<double>")
        answers.append(sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect()))
    want = nearest_model(rows, [(i, v) for i, v in asked[:2]], 10)
    assert answers[0] == answers[1] and [a[:3] for a in answers[0]] == sorted(w[:3] for w in want)


# ---- clashing names


def test_columns_named_like_the_operators_own(spark, docs, tmp_path):
    """Extra columns of any name stay as they are, and change no result."""
    names = ["place", "doc", "covered", "cleaned", "n_removed", "key_", "h_", "none_", "g_", "doc_", "text_hash", "shard", "nth", "total_", "component", "class", "words", "row", "bin_id", "group_", "name", "good"]
    wide = docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"own {n}").alias(n) for n in names))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    for run in (neardup.keep_one, pii.redact, mixing.take, lambda d: quality.keep_good(d, labels), substrings.dedup):
        got = run(wide)
        assert rows(got) == rows(run(wide.select("doc_id", "text", "lang", "source", "n_chars")))
        for n in names:
            assert n not in got.columns or n == "n_removed" or {r[0] for r in got.select(n).distinct().collect()} <= {f"own {n}"}
        assert set(wide.columns) <= set(got.columns)
    for run in (sharding.shards, packing.pack, neardup.group, pii.detect, mixing.mix, fingerprints.describe):
        assert run(wide).count() >= 60
    sharding.write_shards(wide, str(tmp_path / "x"), limit=4_000)
    assert spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(str(tmp_path / "x")).where("doc_ = 'own doc_'").count() == wide.count()


# ---- shared


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(200):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_queries_with_sql(spark, sf):
    from oracle import same_rows

    for name, sql in registry.oracle_sql().items():
        same_rows(registry.queries()[name](spark, sf), sql, sf)
