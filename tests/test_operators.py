"""Relational and graph operators against brute force, with nulls, ties, repeats and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.operators import edges, ids, knn, linking, mentions, pagerank, setops, summaries, vectors
from hopweave.operators.pagerank import LargeRanks, SmallRanks


def test_range_of_bounds(spark):
    for bounds in ([5], [1, 4, 4, 9], list(range(0, 300, 7)), [0.5, 2.5, 8.0]):
        rows = spark.range(-3, 320).select("id", ids.range_of(F.col("id"), bounds).alias("n")).collect()
        assert all(r.n == sum(b < r.id for b in bounds) for r in rows)


def test_dense_index_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ids, "RANGE_ROWS", 50)
    keys = [(i * 7919) % 10_007 for i in range(1_000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.pos for r in ids.dense_index(df, ["k"], start=5).collect()}
    assert got == {k: i + 5 for i, k in enumerate(sorted(keys))}
    assert ids.dense_index(df.limit(0), ["k"]).count() == 0


def test_first_per_key_and_unique_documents(spark):
    rows = [(0, "s0", 0, "A", "first"), (0, "s0", 1, "B", "b"), (1, "s1", 0, "A", "second"), (1, "s1", 1, "C", "c")]
    docs, mapping = ids.unique_documents(spark.createDataFrame(rows, "sample_pos long, sample_id string, ctx_pos int, title string, text string"))
    assert {(r.title, r.text, r.chunk_id) for r in docs.collect()} == {("A", "first", "chunk_0"), ("B", "b", "chunk_1"), ("C", "c", "chunk_2")}
    assert {tuple(r) for r in mapping.collect()} == {("s0", 0, "chunk_0"), ("s0", 1, "chunk_1"), ("s1", 0, "chunk_0"), ("s1", 1, "chunk_2")}


def test_canonical_and_upsert(spark):
    e = spark.createDataFrame([("b", "a", 0.5, 1), ("a", "b", 0.3, 2), ("c", "c", 1.0, 3)], "src string, dst string, score double, at int")
    assert [tuple(r) for r in edges.canonical(e, "at").collect()] == [("a", "b", 0.3)]
    assert [tuple(r) for r in edges.canonical(e).collect()] == [("a", "b", 0.5)]
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(tuple(r) for r in edges.upsert(old, new, ["k"]).collect()) == [(1, "x"), (2, "z"), (3, "w")]
    dangling = spark.createDataFrame([("a", "q", "T")], "source string, target string, type string")
    assert edges.with_ends(dangling, e.select("src"), e.select("dst")).count() == 0


def test_bridge_edges_bounds(spark):
    rows = [(f"chunk_{i}", f"n{n}") for n, size in ((0, 1), (1, 2), (2, 20), (3, 21), (4, 50), (5, 51)) for i in range(size)]
    o = spark.createDataFrame(rows, "chunk_id string, name string")
    sampled = mentions.bridge_edges(o, full=False).collect()
    assert len({(r.src, r.dst) for r in sampled}) == len(sampled) and all(r.src < r.dst for r in sampled)
    for n, size in ((3, 21), (4, 50)):
        only = mentions.bridge_edges(o.where(F.col("name") == f"n{n}"), full=False)
        assert 0 < only.count() <= 50, size
    full = {(r.src, r.dst) for r in mentions.bridge_edges(o, sampled=False).collect()}
    names = sorted(f"chunk_{i}" for i in range(20))
    assert full == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    assert tuple(mentions.band_stats(o.withColumn("x", F.lit(1))).first()) == (6, 1, 1, 4, 2, 2)


def test_frequent_names_stay_bounded(spark):
    """A name that all chunks share brings each frontier chunk the first `cap` others, itself and no more left out."""
    m = spark.range(500).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("chunk_id"), F.lit("hot").alias("name"))
    front = spark.createDataFrame([(1, "c001"), (2, "c400")], "qid int, chunk_id string")
    got = mentions.co_mentions(front, m, 3).collect()
    assert {q: sorted(r.id for r in got if r.qid == q) for q in (1, 2)} == {1: ["c000", "c002", "c003"], 2: ["c000", "c001", "c002"]}


def test_relations_to_many_names_stay_bounded(spark):
    """A name with many relations, each to a frequent name, leads to as many chunks as a cap can use, and to the right ones."""
    m = spark.range(300).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("chunk_id"), F.explode(F.array(F.lit("hot"), F.concat(F.lit("n"), (F.col("id") % 60).cast("string")))).alias("name"))
    r = spark.range(60).select(F.lit("hot").alias("source"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("target"))
    r = r.union(spark.createDataFrame([("n7", "n9")], "source string, target string"))
    led = mentions.leads(r, mentions.first_mentions(m, 4), 4)
    assert sorted(tuple(x) for x in led.collect()) == sorted([("hot", f"c{i:03d}") for i in range(4)] + [("n7", f"c{i:03d}") for i in (9, 69, 129, 189)])
    front = spark.createDataFrame([(1, "c001"), (2, "c007")], "qid int, chunk_id string")
    got = mentions.co_mentions(front, m, 3, r).collect()
    assert {q: sorted(x.id for x in got if x.qid == q) for q in (1, 2)} == {1: ["c000", "c002", "c003"], 2: ["c000", "c001", "c002"]}


def brute_knn(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    out = set()
    for i in range(len(x)):
        best = sorted((-s[i, j], j) for j in range(len(x)) if j != i)[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("by_scan", [True, False])
def test_knn_exact(spark, monkeypatch, by_scan):
    x = np.random.default_rng(3).normal(size=(90, 6))
    x[10] = x[20] = x[30]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, [0.0] * 6), (101, None), (102, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    if not by_scan:
        monkeypatch.setattr(knn, "SCAN_BYTES", 0)
        monkeypatch.setattr(knn, "BLOCK", 20)
    got = knn.nearest(df, df, 3, exclude_self=True).collect()
    assert {(r.qid, r.id, r["rank"]) for r in got} == brute_knn(x, 3)
    assert knn.nearest(df.limit(0), df, 3).count() == 0
    assert knn.nearest(df, df.limit(0), 3).count() == 0


@pytest.mark.parametrize("by_scan", [True, False])
def test_knn_in_small_tiles(spark, monkeypatch, by_scan):
    """Scores that single precision can't tell apart, many copies, and ids that are strings."""
    x = np.random.default_rng(6).normal(size=(120, 6)).astype(np.float32)
    x[40:70] = x[3]
    x[70:100] = x[5] + np.random.default_rng(7).normal(scale=1e-5, size=(30, 6)).astype(np.float32)
    df = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    for name, n in (("TILE_Q", 7), ("TILE_X", 5), ("AGAIN", 11), ("SCAN_BYTES", 32_000_000 if by_scan else 0)):
        monkeypatch.setattr(knn, name, n)
    got = knn.nearest(df, df, 3, exclude_self=True).collect()
    assert {(int(r.qid), int(r.id), r["rank"]) for r in got} == brute_knn(x.astype(np.float64), 3)


@pytest.mark.parametrize("copies", [0, 4_000])
def test_knn_tiles_are_bounded(copies):
    """A batch of rows never meets all queries at once, also where most of the rows are equal."""
    import tracemalloc

    x = np.random.default_rng(8).normal(size=(8_000, 16))
    x[:copies] = x[0]
    best = knn.Best(np.arange(8_000), x, 3, True)
    tracemalloc.start()
    best.add(np.arange(8_000), x)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000  # a table of all scores takes 512 MB
    tracemalloc.stop()
    assert len(best.rows()) == 24_000


def test_knn_refuses_vectors_of_several_lengths():
    import pyarrow as pa

    with pytest.raises(ValueError, match="one length"):
        knn.columns(pa.table({"id": [1, 2], "v": [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 5.0]]}))
    assert knn.columns(pa.table({"id": [1, 2], "v": [[1.0, 2.0], [3.0, 4.0]]}))[1].tolist() == [[1.0, 2.0], [3.0, 4.0]]


def test_knn_in_cells_finds_most(spark, monkeypatch):
    monkeypatch.setattr(knn, "SCAN_BYTES", 0)
    random = np.random.default_rng(4)
    x = random.normal(size=(8, 12)).repeat(25, axis=0) + random.normal(scale=0.3, size=(200, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {(r.qid, r.id) for r in knn.nearest(df, df, 3, exclude_self=True, n_cells=10, probes=3).collect()}
    assert len(got & {(i, j) for i, j, _ in brute_knn(x, 3)}) >= 0.9 * 600


def test_linking_both_ways(spark):
    m = spark.createDataFrame([("c1", "paris"), ("c2", "paris city"), ("c3", "york")], "chunk_id string, name string")
    e = spark.createDataFrame([("paris",), ("new york",), ("",), (None,)], "entity string")
    assert {(r.entity, r.id) for r in linking.linked_chunks(e, m, 5).collect()} == {("paris", "c1"), ("paris", "c2"), ("new york", "c3")}


def test_linking_is_not_each_with_each(spark):
    """All pairs of which one holds the other, long ones and repeats inside a name too; no nested loop unless strings are long."""
    entities = ["an", "banana", "bananas", "x", "ana split", "aa", "é", "zé", "q" * 200, "y" * 3]
    names = ["banana", "an", "nan", "aaaa", "x", "split", "zé", "é", "e", "p" * 150 + "x", "q" * 40, ""]
    df = lambda c, rows: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    wanted = sorted((e, n) for e in entities for n in names if e in n or n in e)
    assert sorted(tuple(r) for r in linking.linked_names(df("entity", [*entities, "", None]), df("name", names)).collect()) == wanted
    found = linking.linked_names(df("entity", entities[:8]), df("name", names[:9]))
    assert sorted(tuple(r) for r in found.collect()) == sorted((e, n) for e in entities[:8] for n in names[:9] if e in n or n in e)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def graph(seed):
    random = np.random.default_rng(seed)
    n = 40
    pairs = {tuple(sorted(p)) for p in random.integers(0, n - 4, size=(60, 2)).tolist() if p[0] != p[1]}  # the last four dangle
    return n, sorted(pairs | {(b, a) for a, b in pairs})


@pytest.mark.parametrize("seed", [1, 2])
def test_page_rank_both_ways(spark, seed):
    n, pairs = graph(seed)
    nodes = spark.createDataFrame([(str(i),) for i in range(n)], "id string")
    e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    seeds = {0: {"1": 0.5, "2": 0.5}, 1: {str(n - 1): 1.0}, 2: {"3": 0.25, str(n - 2): 0.75}, 3: {"absent": 1.0}}
    s = spark.createDataFrame([(q, i, w) for q, ws in seeds.items() for i, w in ws.items()], "qid long, id string, weight double")
    src, dst = np.array(pairs).T
    wanted = {}
    for q, ws in seeds.items():
        p = np.zeros(n)
        for i, w in ws.items():
            if i.isdigit():
                p[int(i)] = w
        if p.any():
            x = pagerank.solve(src, dst, n, p, 0.85, 30, 1e-3)
            wanted |= {(q, str(i)): v for i, v in enumerate(pagerank.scaled(x))}
    asked = spark.createDataFrame([(q, str(i)) for q in seeds for i in [*range(n), "other"]], "qid long, id string")
    for small, kind in (((1_000, 10_000), SmallRanks), ((0, 0), LargeRanks)):
        r = pagerank.ranks(nodes, e, s, max_iter=30, tol=1e-3, small=small)
        assert isinstance(r, kind)
        got = {(x.qid, x.id): x.ppr for x in r.of(asked).collect()}
        assert {k for k in got if k[1] != "other"} == set(wanted)
        assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in wanted.items())
        assert all(v == 0 for (_, i), v in got.items() if i == "other")


def test_page_rank_that_does_not_settle(spark):
    nodes, e = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    s = spark.createDataFrame([(1, "a", 1.0)], "qid long, id string, weight double")
    for small in ((10, 10), (0, 0)):
        assert pagerank.ranks(nodes, e, s, max_iter=2, tol=1e-12, small=small).of(s.select("qid", "id")).count() == 0
    assert pagerank.ranks(nodes, e.limit(0), s).of(s.select("qid", "id")).count() == 0


def test_rank_steps_of_all_questions_and_nodes(spark, monkeypatch):
    """Against dense steps, in blocks of questions; a node without edges has a row only as a seed."""
    monkeypatch.setattr(pagerank, "QUESTIONS", 2)
    monkeypatch.setattr(pagerank, "TASK_ROWS", 50)
    n, pairs = graph(1)
    src, dst = np.array(pairs).T
    linked, degree = set(src.tolist()), np.bincount(src, minlength=n)
    starts = [1, 2, 5, 8, n - 1, n - 1]
    wanted = {}
    for q in starts:
        x = np.full(n, 1 / n)
        for _ in range(3):
            x = 0.85 * np.bincount(dst, weights=(x / np.maximum(degree, 1))[src], minlength=n)
            x[q] += 0.15
        wanted |= {(q, i): x[i] * starts.count(q) for i in range(n) if i in linked or i == q}
    long = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))
    seeds = long([(q, q) for q in starts], "qid", "id").withColumn("weight", F.lit(1.0))
    ranked = pagerank.rank_steps(long([(i,) for i in range(n)], "id"), long(pairs, "src", "dst"), seeds, 3)
    rows = ranked.collect()
    assert len(rows) == len(wanted) and {(r.qid, r.id): r.x for r in rows} == {k: pytest.approx(v, abs=1e-12) for k, v in wanted.items()}


def test_results_of_all_nodes_are_not_shuffled(spark):
    """After questions and nodes meet, nothing is dealt out again."""
    even = spark.range(30).select("id", F.lit(0.5).alias("u"))
    own = spark.createDataFrame([(1, 2, 0.75), (3, 2, 0.25)], "qid long, id long, x double")
    rows = pagerank.everywhere(even, own, spark.range(1, 5).toDF("qid"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("NestedLoopJoin")]
    got = {(r.qid, r.id): r.x for r in rows.collect()}
    assert len(got) == 120 and {k: v for k, v in got.items() if v != 0.5} == {(1, 2): 0.75, (3, 2): 0.25}


@pytest.mark.parametrize("small", [(1_000, 10_000), (0, 0)])
def test_page_rank_everywhere(spark, small):
    n, pairs = graph(2)
    nodes = spark.createDataFrame([(str(i),) for i in range(n)], "id string")
    e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    s = spark.createDataFrame([(0, "1", 0.5), (0, "2", 0.5), (1, str(n - 1), 1.0), (3, "absent", 1.0)], "qid long, id string, weight double")
    r = pagerank.ranks(nodes, e, s, max_iter=30, tol=1e-3, small=small)
    asked = s.select("qid").distinct().join(nodes)
    wanted = {(x.qid, x.id): x.ppr for x in r.of(asked).collect()}
    got = r.everywhere(s.select("qid")).collect()
    assert len(got) == len(wanted) == 2 * n
    assert {(x.qid, x.id): x.ppr for x in got} == {k: pytest.approx(v, abs=1e-12) for k, v in wanted.items()}


def test_co_mention_edges_in_order(spark):
    rows = [(f"c{i:03d}", name) for name, n in (("hot", 60), ("x", 3)) for i in range(n)]
    m = spark.createDataFrame(rows, "chunk_id string, name string")
    every = sorted((f"c{a:03d}", f"c{b:03d}") for a in range(60) for b in range(a + 1, 60))
    for most in (7, 100, 5_000):
        assert sorted(tuple(r) for r in pagerank.co_mention_edges(m, most).collect()) == every[:most]


def test_drill_and_hybrid(spark):
    links = spark.createDataFrame([("summary_l2_t", "summary_l1_t_0"), ("summary_l1_t_0", "chunk_1"), ("summary_l1_t_0", "chunk_0"), ("summary_l1_u_0", "chunk_9")], "source string, target string")
    found = spark.createDataFrame([(1, 1, "summary_l1_u_0"), (1, 2, "summary_l2_t"), (1, 3, "summary_l1_t_0")], "qid int, rank int, id string")
    got = vectors.drill(found, links, 4).orderBy("rank").collect()
    assert [(r.id, r.summary) for r in got] == [("chunk_9", "summary_l1_u_0"), ("chunk_0", "summary_l2_t"), ("chunk_1", "summary_l2_t"), ("chunk_0", "summary_l1_t_0")]


def test_large_tables_of_visited_pairs_are_not_shuffled(spark):
    """Neither the visited pairs nor the pairs of a filter, which may be questions times rows, are dealt out by key."""
    pairs = spark.range(50).toDF("qid").join(spark.range(200).toDF("id").hint("broadcast"), (F.col("qid") + F.col("id")) % 3 == 0).select("qid", "id")
    found = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 4, 1), (2, 500, 2)], "qid long, id long, rank int")
    left = vectors.unvisited(found, pairs)
    assert {(r.qid, r.id) for r in left.collect()} == {(1, 1), (2, 500)}
    cut_rows = found.localCheckpoint()
    plan = setops.shared(pairs, cut_rows, ["qid", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    rows = setops.within_filter(found, pairs.withColumnRenamed("id", "chunk_id"))
    assert {(r.qid, r.id) for r in rows.collect()} == {(1, 2), (2, 4)}
    assert "HashAggregate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_min_max_and_top(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "k string, v double")
    assert sorted(tuple(r) for r in setops.min_max(df, "k", "v").collect()) == [("a", 0.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)]


def test_summary_tree_of_long_titles(spark, monkeypatch):
    monkeypatch.setattr(summaries, "MOST_CHUNKS", 10)
    rows = [("t", f"chunk_{i}", i, f"Text {i}.", [float(i % 3 == j) for j in range(3)]) for i in range(25)] + [("one", "chunk_25", 25, "Alone.", [1.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "title string, chunk_id string, pos long, text string, embedding array<double>")
    clustered = summaries.clusters(chunks)
    assert clustered.count() == 26
    nodes, links = summaries.summary_tree(chunks, clustered)
    got = {r.id: r for r in nodes.collect()}
    assert "summary_l2_t" in got and "summary_l2_one" not in got and got["summary_l1_one_0"].text == "[one] Alone."
    assert {r.target for r in links.collect() if r.type == "CONTAINS_CHUNK"} == {f"chunk_{i}" for i in range(26)}


def test_clusters_of_large_titles_follow_the_same_rule(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"t{t}", f"c{t}_{i}", 3 * i + t, [float(x) for x in rng.normal(size=3) + 4 * (i % 3)]) for t, n in ((0, 90), (1, 31), (2, 12)) for i in range(n)]
    rows += [("gap", f"g{i}", i, None if i == 7 else [1.0 * i]) for i in range(40)]
    df = spark.createDataFrame(rows, "title string, chunk_id string, pos long, embedding array<double>")
    found = lambda: {(r.title, r.chunk_id): r.cluster for r in summaries.clusters(df).collect()}
    small = found()
    monkeypatch.setattr(summaries, "MOST_CHUNKS", 20)
    large = found()
    assert large == small and len(large) == len(rows)
    assert max(large.values()) < 5 and len({c for (t, _), c in large.items() if t == "t0"}) > 1


def test_rounds_of_large_titles_write_nothing(spark, monkeypatch):
    """A round of a large title's clusters is one pass over the rows: the rows are checkpointed once, the rounds aren't."""
    monkeypatch.setattr(summaries, "MOST_CHUNKS", 20)
    x = np.random.default_rng(5).normal(size=(200, 4))
    df = spark.createDataFrame([("t", f"c{i}", i, v.tolist()) for i, v in enumerate(x)], "title string, chunk_id string, pos long, embedding array<double>")
    cuts = []
    monkeypatch.setattr(summaries, "cut", lambda d, cut=summaries.cut: cuts.append(1) or cut(d))
    got = {r.chunk_id: r.cluster for r in summaries.clusters(df).collect()}
    assert len(cuts) == 2
    labels = summaries.k_means(x, 5, summaries.start(200))
    assert got == {f"c{i}": int(c) for i, c in enumerate(labels)}
