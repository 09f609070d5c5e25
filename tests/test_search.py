"""The batched search against a model that runs one question at a time over plain Python structures."""

import random
import re
from dataclasses import replace

import numpy as np
import pytest

from hopweave.config import Config
from hopweave.functions.scores import SOURCE_WEIGHTS
from hopweave.models import Models, hashed
from hopweave.operators.linking import rank_seeds
from hopweave.operators.pagerank import co_mention_edges, scaled, solve, walk_edges
from hopweave.plans.build import build
from hopweave.plans.graph import KnowledgeGraph
from hopweave.plans.search import search

PRECEDENCE = ("RelPath", "EntMention", "Sem", "Seq", "EntBridge", "QueryEnt")
NAMES = ["Arden", "Borio", "Celt", "Dorin", "Elmo", "Farr", "Gant", "Hale"]


def tokens(text):
    plain = re.sub(r"[!-/:-@\[-`{-~]", "", text.lower().replace("-", " "))
    return [w for w in plain.split() if w not in ("a", "an", "the")]


def rerank(query, text):
    q = set(tokens(query))
    return 10 * len(q & set(tokens(text))) / len(q) - 5 if q else -5.0


class Model:
    """One question after another; orders that the search leaves to the reader are by id."""

    def __init__(self, spark, graph, config):
        t = {k: v.toPandas() for k, v in graph.tables().items()}
        self.config, self.graph, self.spark = config, graph, spark
        self.chunks = {r.chunk_id: r for r in t["chunks"].itertuples()}
        self.vectors = {r.id: r for r in t["vectors"].itertuples()}
        self.children = {}
        for r in t["summary_edges"].itertuples():
            self.children.setdefault(r.source, []).append(r.target)
        self.names = {}
        for r in t["mentions"].itertuples():
            self.names.setdefault(r.chunk_id, set()).add(r.name)
        self.relations = {(r.source, r.target) for r in t["relations"].itertuples()}
        both = lambda rows: {(a, b) for r in rows for a, b in ((r.src, r.dst), (r.dst, r.src))}
        self.next, self.bridge = both(t["next"].itertuples()), both(t["bridge"].itertuples())
        self.related = both(r for r in t["related"].itertuples() if r.score > config.related_read_score)
        self.walk = [tuple(r) for r in walk_edges(graph.next, graph.related, co_mention_edges(graph.mentions, config.ppr_co_mentions)).collect()]

    def near(self, query, k, kind=None):
        q = hashed(query, 64).astype(np.float32).astype(float)
        q /= np.linalg.norm(q)
        rows = []
        for i, r in self.vectors.items():
            if kind is None or r.type == kind:
                v = np.asarray(r.embedding, float)
                rows.append((-round(float(q @ v / np.linalg.norm(v)), 9), i))
        return [i for _, i in sorted(rows)[:k]]

    def ppr(self, entities):
        if not entities:
            return None
        df = self.spark.createDataFrame([(0, sorted(entities))], "qid int, entities array<string>")
        seeds = {r.id: r.weight for r in rank_seeds(df, self.graph.mentions, self.config.ppr_entities, self.config.ppr_seeds).collect()}
        ids = sorted(self.chunks)
        at = {c: i for i, c in enumerate(ids)}
        if not seeds or not self.walk:
            return None
        p = np.zeros(len(ids))
        for c, w in seeds.items():
            p[at[c]] = w
        src, dst = np.array([[at[a], at[b]] for a, b in self.walk]).T
        x = solve(src, dst, len(ids), p / p.sum(), self.config.ppr_alpha, self.config.ppr_max_iter, self.config.ppr_tol)
        return None if x is None else dict(zip(ids, scaled(x), strict=True))

    def trust(self, r, ppr, node, entities):
        squash = 1 / (1 + np.exp(-r / 5))
        cover = 0.3 + 0.7 * sum(e in node["text"].lower() for e in entities) / len(entities) if entities else 0.3
        penalty, weight = 1 / (1 + 0.15 * node["depth"]), SOURCE_WEIGHTS.get(node["source"], 0.9)
        if ppr is None:
            return 0.55 * squash + 0.15 * cover + 0.15 * penalty + 0.15 * weight
        return 0.5 * squash + 0.1 * ppr.get(node["id"], 0.0) + 0.15 * cover + 0.12 * penalty + 0.13 * weight

    def drill(self, question, k):
        out = []
        for s in self.near(question, k, "summary"):
            direct = sorted(c for c in self.children.get(s, ()) if not c.startswith("summary_"))
            out += direct
            for l1 in sorted(c for c in self.children.get(s, ()) if c.startswith("summary_")):
                out += sorted(c for c in self.children.get(l1, ()) if not c.startswith("summary_"))
        return out[:k]

    def title(self, i):
        return self.chunks[i].title if i in self.chunks else ""

    def seeds(self, question, allowed):
        beam = self.config.beam_width
        if allowed is not None and len(allowed) <= self.config.small_space:
            return [(i, "Doc") for i in sorted(allowed) if i in self.chunks and self.chunks[i].text]
        drilled = [(i, "SummaryDrill") for i in self.drill(question, beam * (2 if allowed is not None else 1))]
        if allowed is not None:
            found = [x for x in drilled if x[0] in allowed]
            for i in self.near(question, beam * 3):
                if i in allowed and all(i != c for c, _ in found):
                    found.append((i, "Doc"))
            return found
        found = drilled
        for i in self.near(question, beam * 2):
            if any(i == c for c, _ in found):
                continue
            for c in sorted(self.children.get(i, ())) if i.startswith("summary_") else [i]:
                if all(c != x for x, _ in found):
                    found.append((c, "Doc"))
        return found

    def expand(self, chunk, visited, entities):
        cfg, own = self.config, self.names.get(chunk, set())
        out = {}

        def add(label, found, cap):
            for i in sorted(set(found) - visited)[:cap]:
                out.setdefault(i, label)

        ends = {b for a, b in self.relations if a in own}
        ways = {
            "RelPath": [c for c, ns in self.names.items() if ns & ends], "EntMention": [c for c, ns in self.names.items() if ns & own],
            "Sem": [b for a, b in self.related if a == chunk], "Seq": [b for a, b in self.next if a == chunk],
        }
        for label in PRECEDENCE[:4]:
            add(label, ways[label], cfg.neighbour_cap)
        add("EntBridge", [b for a, b in self.bridge if a == chunk], cfg.bridge_cap)
        for e in entities:
            add("QueryEnt", [c for c, ns in self.names.items() if any(e in n or n in e for n in ns)], cfg.query_entity_cap)
        return sorted(out.items(), key=lambda x: (PRECEDENCE.index(x[1]), x[0]))

    def run(self, question, entities, allowed):
        cfg, beam = self.config, self.config.beam_width
        entities, ppr = sorted(set(entities)), self.ppr(entities)
        small = allowed is not None and len(allowed) <= cfg.small_space
        frontier = []
        for i, source in self.seeds(question, allowed):
            title = "SummaryDrill" if source == "SummaryDrill" else self.title(i)
            node = {"id": i, "source": source, "title": title, "text": self.vectors[i].text, "depth": 0, "path": [f"Start -> '{title}'"], "context": f"[{title}] {self.vectors[i].text}", "titles": [self.title(i)] if self.title(i) else []}
            node["score"] = self.trust(rerank(question, node["text"]), ppr, node, entities)
            frontier.append(node)
        started = bool(frontier)
        frontier.sort(key=lambda n: -n["score"])
        frontier = frontier[: cfg.small_space if small else beam]
        visited, selected = set(), {}
        for _ in range(cfg.max_steps):
            if not frontier:
                break
            node = frontier.pop(0)
            if node["id"] in visited:
                continue
            visited.add(node["id"])
            if not (node["score"] >= cfg.trust_threshold or small and len(selected) < cfg.min_keep):
                continue
            selected[node["id"]] = node
            near = self.expand(node["id"], visited, entities)
            if len(near) < cfg.hybrid_below:
                query = f"{question} {node['context'][:500].replace(chr(10), ' ').strip()}"
                hits = [i for i in self.near(query, 2 * cfg.hybrid_k) if i not in visited and self.vectors[i].type != "summary"][: cfg.hybrid_k]
                near += [(i, "Doc") for i in hits if i not in dict(near)]
            if not near:
                continue
            query = f"{question} [Context: {node['context'][-1000:].replace(chr(10), ' ')}]"
            new = [(i, "VectorJump") for i in self.near(query, beam) if i not in visited] + near
            new = [x for x in new if not allowed or x[0] in allowed][: 3 * beam]
            for i, label in new:
                v = self.vectors[i]
                title = v.title if label == "Doc" else label
                shown = v.title if label == "VectorJump" else title
                doc_title = self.title(i) or (v.title if label == "VectorJump" else "")
                child = {"id": i, "source": label, "title": title, "text": v.text, "depth": node["depth"] + 1, "titles": node["titles"] + [doc_title] * bool(doc_title)}
                child["path"] = [*node["path"], f"-> [VectorJump] '{shown}'" if label == "VectorJump" else f"-> '{shown}'"]
                child["context"] = node["context"] + f"\n[{shown}] {v.text}"
                child["score"] = self.trust(rerank(query, v.text), ppr, child, entities)
                frontier.append(child)
            if new:
                frontier.sort(key=lambda n: -n["score"])
                frontier = frontier[: 2 * beam]
        if not selected and started and allowed and small:
            rows = [{"id": i, "title": self.title(i), "score": rerank(question, self.chunks[i].text), "path": ["Fallback (Raw Doc)"], "titles": []} for i in sorted(allowed) if i in self.chunks]
            selected = {r["id"]: r for r in sorted(rows, key=lambda r: -r["score"])[:beam]}
        best = sorted(selected.values(), key=lambda n: -n["score"])
        return [(n["id"], n["title"], round(n["score"], 9)) for n in best], " -> ".join(best[0]["path"]) if best else "", best[0]["titles"] if best else []


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    rng = random.Random(5)
    words = ["river", "stone", "music", "battle", "king", "city", "game", "song", "book", "light"]
    docs = []
    for i in range(36):
        said = [" ".join(rng.choices(words, k=4) + rng.choices(NAMES, k=rng.choice([0, 1, 2]))) + "." for _ in range(3)]
        docs.append((i, f"t{i // 6 if i < 12 else i}", " ".join(said)))
    config = Config(knn_min_score=0.3, related_read_score=0.5, neighbour_cap=4, bridge_cap=3, query_entity_cap=2, beam_width=2, max_steps=4, ppr_tol=1e-3, small_space=5)
    graph = build(spark.createDataFrame(docs, "doc_id long, title string, text string"), config=config)
    path = str(tmp_path_factory.mktemp("graph"))
    graph.save(path)
    return KnowledgeGraph.load(spark, path), config


def questions():
    rng = random.Random(9)
    out = []
    for q in range(9):
        allowed = None if q % 3 == 0 else {f"chunk_{i}" for i in rng.sample(range(36), 4 if q % 3 == 1 else 14)}
        out.append((q, f"Which {rng.choice(NAMES)} song about the river king {q}", [n.lower() for n in rng.sample(NAMES, q % 4)], allowed))
    return [*out, (9, "An empty filter", ["arden"], set()), (10, "Unknown", ["zzz"], {"chunk_1", "nowhere"})]


@pytest.mark.parametrize("threshold", [0.01, 0.99])
def test_search_equals_the_model(spark, tiny, threshold):
    """With the high threshold nothing but forced evidence stays, with `min_keep` 0 the fallback answers."""
    graph, config = tiny
    config = replace(config, trust_threshold=threshold, min_keep=0 if threshold > 0.5 else 3)
    asked = questions()
    q = spark.createDataFrame([x[:3] for x in asked], "qid long, question string, entities array<string>")
    filters = spark.createDataFrame([(x[0], c) for x in asked if x[3] is not None for c in (x[3] or {None})], "qid long, chunk_id string")
    got = {r.qid: r for r in search(graph, q, filters, Models(), config).collect()}
    assert len(got) == len(asked)
    model = Model(spark, graph, config)
    for qid, question, entities, allowed in asked:
        nodes, path, titles = model.run(question, entities, allowed)
        r = got[qid]
        assert [(n.id, n.title, pytest.approx(n.score, abs=1e-8)) for n in r.nodes] == nodes, qid
        assert (r.best_path, r.best_path_titles) == (path, titles), qid
        assert len(r.nodes) <= max(config.max_steps, config.beam_width)


def test_no_steps_means_fallback_or_nothing(spark, tiny):
    graph, config = tiny
    q = spark.createDataFrame([(0, "river", ["arden"]), (1, "river", [])], "qid long, question string, entities array<string>")
    filters = spark.createDataFrame([(0, "chunk_3"), (0, "chunk_4")], "qid long, chunk_id string")
    got = {r.qid: r for r in search(graph, q, filters, Models(), replace(config, max_steps=0)).collect()}
    assert {n.id for n in got[0].nodes} == {"chunk_3", "chunk_4"} and got[0].best_path == "Fallback (Raw Doc)"
    assert got[1].nodes == [] and got[1].best_path == ""
