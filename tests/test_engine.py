"""The engine end to end: samples, build, save, load, extend, evaluate, the command line, logs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from hopweave import __main__ as cli
from hopweave.config import Config
from hopweave.models import Models, SameWords
from hopweave.plans import evaluation
from hopweave.plans.engine import UNKNOWN, Engine
from hopweave.plans.graph import KnowledgeGraph
from hopweave.sources import documents, logs
from hopweave.streaming.ingest import current, ingest

SAMPLES = [
    {"_id": "a", "question": "Which river runs by Arden?", "answer": "Borio", "context": [["Arden", ["Arden lies by Borio.", "It is old."]], ["Borio", ["Borio is a river in Celt."]]], "supporting_facts": [["Arden", 0], ["Borio", 0]]},
    {"_id": "b", "question": "Is Celt old?", "answer": "yes", "context": [["Celt", ["Celt is near Arden."]], ["Arden", ["Another text."]]], "supporting_facts": [["Celt", 0]]},
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("samples") / "s.json"
    path.write_text(json.dumps(SAMPLES))
    e = Engine(spark, Models(judge=SameWords()), Config(beam_width=2, max_steps=2))
    rows = documents.samples(spark, str(path))
    filters = e.build_from_samples(rows)
    return e, rows, filters, str(path)


def test_samples_to_graph(engine):
    e, rows, filters, _ = engine
    assert {(r.qid, r.chunk_id) for r in filters.collect()} == {("a", "chunk_0"), ("a", "chunk_1"), ("b", "chunk_2"), ("b", "chunk_0")}
    assert {r.text for r in e.graph.chunks.where("title = 'Arden'").collect()} == {"Arden lies by Borio. It is old."}
    assert [(r.src, r.dst) for r in e.graph.next.orderBy("src").collect()] == [("chunk_0", "chunk_1"), ("chunk_1", "chunk_2")]
    ids = {r.id for r in e.graph.vectors.collect()}
    for edges in (e.graph.related, e.graph.bridge):
        assert all(r.src < r.dst and {r.src, r.dst} <= ids for r in edges.collect())


def test_evaluate(spark, engine, tmp_path):
    e, rows, filters, _ = engine
    documents.write_results(e.evaluate(rows, filters), str(tmp_path / "out"))
    records = {r.id: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert set(records) == {"a", "b"} and records["a"].retrieval.support_titles == ["Arden", "Borio"]
    assert records["a"].retrieval.retrieval_hit and records["b"].prediction in ("yes", "no")
    mean = evaluation.averages(spark.read.json(str(tmp_path / "out"))).first()
    assert mean["count"] == 2 and 0 <= mean.f1 <= 1


def test_unanswerable(spark, engine):
    e, *_ = engine
    q = spark.createDataFrame([("x", "Anything?")], "qid string, question string")
    none = spark.createDataFrame([("x", None)], "qid string, chunk_id string")
    assert e.query(q, none).first().prediction == UNKNOWN


def test_failed_samples_count(spark, engine):
    _, rows, *_ = engine
    schema = "qid string, prediction string, nodes array<struct<doc_title:string>>, best_path_titles array<string>, duration double"
    one = spark.createDataFrame([("a", "Borio", [("Arden",), ("Borio",)], ["Arden"], 1.0)], schema)
    records = evaluation.records(one, rows)
    got = evaluation.averages(records).first()
    assert (got["count"], got.f1, got.retrieval_hit, got.bridge_hit, got.path_hit) == (2, 0.5, 0.5, 0.5, 0.0)
    assert {r.id: r.status for r in records.collect()} == {"a": "High F1", "b": "Failed"}


def test_save_load_extend(spark, engine, tmp_path):
    e, *_ = engine
    e.save(str(tmp_path / "g"))
    other = Engine(spark, config=e.config).load(str(tmp_path / "g"))
    assert other.graph.counts().collect() == e.graph.counts().collect()
    docs = spark.createDataFrame([(0, "Arden", "again"), (1, "Dorin", "Dorin lies by Borio.")], "pos long, title string, text string")
    other.build(docs)
    assert {(r.title, r.chunk_id) for r in other.graph.chunks.collect()} == {("Arden", "chunk_0"), ("Borio", "chunk_1"), ("Celt", "chunk_2"), ("Dorin", "chunk_3")}
    assert {(r.src, r.dst) for r in other.graph.bridge.collect()} >= {("chunk_0", "chunk_3"), ("chunk_1", "chunk_3")}
    with pytest.raises(RuntimeError):
        Engine(spark, online=True).build(docs)
    other.reset()
    assert other.graph is None


def test_bad_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"text": "x"}, {"title": "T", "text": "y"}]))
    assert [(r.title, r.text) for r in documents.documents(spark, str(tmp_path / "d.json")).collect()] == [("Document_0", "x"), ("T", "y")]
    (tmp_path / "e.json").write_text(json.dumps([{"title": "no text"}]))
    with pytest.raises(Exception, match="JSON array"):
        documents.documents(spark, str(tmp_path / "e.json")).collect()


def test_command_line(spark, engine, tmp_path, capsys):
    *_, path = engine
    graph = str(tmp_path / "g")
    cli.main(["build", "--input", path, "--graph", graph, "--samples"])
    cli.main(["evaluate", "--graph", graph, "--input", path, "--output", str(tmp_path / "o"), "--filtered", "--limit", "1"])
    (tmp_path / "p.json").write_text(json.dumps({"answer": {"a": "Borio", "b": "no"}, "sp": {"a": [["Arden", 0], ["Borio", 0]]}}))
    cli.main(["metrics", str(tmp_path / "p.json"), path])
    said = capsys.readouterr().out
    assert "joint_em" in said and "0.5" in said


def test_logs(spark, tmp_path):
    line = "x | 📊 指标: F1={} | P=1.00 | R=1.00 | {} (耗时: 2.00s)"
    for name, rows in (("new", [("ok", "1.00", "🎉"), ("I don't know", "0.00", "❌ MISS")]), ("old", [("bad", "0.50", "⚠️"), ("bad", "0.00", "⚪ IDK")])):
        (tmp_path / name).write_text("\n".join(t for p, f, s in rows for t in (f"x | 🤖 预测: {p}", line.format(f, s), "📋 doc_filter: 10 个文档")))
    parsed = logs.parse(logs.read_log(spark, str(tmp_path)))
    got = {r.run: tuple(r)[1:] for r in logs.stats(parsed).collect()}
    assert got == {"new": (2, 1, 0, 0, 1, 2.0, 0.5), "old": (2, 1, 0, 1, 0, 2.0, 0.25)}
    diff = {r.metric: r["diff"] for r in logs.compare(logs.stats(parsed), "new", "old").collect()}
    assert diff["perfect"] == 50.0 and diff["mean_f1"] == 0.25
    assert logs.parse(logs.read_log(spark, str(tmp_path)), 1).count() == 2


def test_stream_ingest(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "graph")
    source.mkdir()
    for i, rows in enumerate(([("A", "Arden lies here."), ("B", "Borio is near Arden.")], [("A", "again"), ("C", "Celt has Borio.")])):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"title": t, "text": x}) for t, x in rows))
        assert ingest(spark, str(source), path).awaitTermination(300)
    graph = KnowledgeGraph.load(spark, current(spark, path))
    assert {(r.title, r.chunk_id, r.text) for r in graph.chunks.collect()} == {("A", "chunk_0", "Arden lies here."), ("B", "chunk_1", "Borio is near Arden."), ("C", "chunk_2", "Celt has Borio.")}
    assert graph.mentions.where(F.col("name") == "borio").count() == 2


def test_experiment_log(spark, tmp_path):
    """The logger's file is read again as a run's log."""
    logger = logs.experiment_log(str(tmp_path / "runs"), "run")
    for line in ("🤖 预测: Arden", "📊 指标: F1=0.50 | P=0.50 | R=0.50 | ❌ MISS (耗时: 2.00s)"):
        logger.info(line)
    for handler in logger.handlers:
        handler.flush()
    parsed = logs.parse(logs.read_log(spark, str(tmp_path / "runs"))).collect()
    assert [(r.prediction, r.f1, r.seconds) for r in parsed] == [("Arden", 0.5, 2.0)]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from hopweave.sources.lineage import shared_folder

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("spark://a", "hdfs://x")) == "hdfs://x" and shared_folder(session("local[2]", None))
    with pytest.raises(ValueError, match="executors share"):
        shared_folder(session("yarn", None))


def test_local_models(tmp_path, monkeypatch):
    from hopweave.config import local_model

    (tmp_path / "owner__model").mkdir()
    monkeypatch.setenv("HOPWEAVE_MODEL_FOLDERS", f"/nowhere:{tmp_path}")
    assert local_model("owner/model") == str(tmp_path / "owner__model") and local_model("owner/other") == "owner/other"
    monkeypatch.setenv("EMBEDDER", str(tmp_path))
    assert local_model("owner/model", key="EMBEDDER") == str(tmp_path)
    monkeypatch.setenv("EMBEDDER", "x/owner__model")
    assert local_model("y/z", key="EMBEDDER") == str(tmp_path / "owner__model")
