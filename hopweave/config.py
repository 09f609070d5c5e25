"""Settings of the engine: one frozen record, with values from the environment where they are set."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

# Fixed values that results depend on.
ENTITY_LABELS = ("Person", "Organization", "Location", "Event", "Product", "Concept", "Work", "Facility", "Date", "Award", "Technology", "Sport", "Animal")
BRIDGE_LABELS = tuple(x for x in ENTITY_LABELS if x != "Date")
ENTITY_STOPWORDS = (
    "year", "month", "day", "date", "time", "century", "decade", "week", "hour", "minute", "second", "period", "era", "age", "city", "country",
    "world", "place", "area", "region", "state", "town", "village", "district", "province", "county", "zone", "territory", "man", "woman", "person",
    "people", "group", "company", "team", "member", "individual", "individuals", "organization", "institution", "life", "history", "part", "end",
    "beginning", "work", "series", "type", "kind", "name", "number", "way", "thing", "fact", "case", "point", "example", "system", "method",
    "process", "result", "effect", "cause",
)


@dataclass(frozen=True)
class Config:
    """Defaults of the graph build and the search; `from_env` takes HOPWEAVE_<NAME> first."""

    # entities
    entity_chars: int = 3000
    relation_chars: int = 512
    min_entity_length: int = 2
    min_entities_for_relations: int = 2
    # bridge edges
    bridge_min_name: int = 2
    bridge_min_chunks: int = 2
    bridge_max_chunks: int = 50
    bridge_full_connect: int = 20
    bridge_sample_neighbours: int = 5
    bridge_max_edges: int = 50
    # semantic edges
    knn_k: int = 3
    knn_min_score: float = 0.5
    related_read_score: float = 0.7
    # summaries
    cluster_size: int = 3
    max_clusters: int = 5
    # summaries by a model: texts of so many characters are asked about, up to so many of them; what stays after an error
    summary_least: int = 500
    summary_chars: int = 2000
    summary_error_chars: int = 200
    summary_echo: int = 0
    # expansion
    neighbour_cap: int = 15
    bridge_cap: int = 10
    query_entity_cap: int = 5
    hybrid_below: int = 3
    hybrid_k: int = 5
    # search
    beam_width: int = 8
    max_steps: int = 3
    trust_threshold: float = 0.01
    small_space: int = 20
    min_keep: int = 3
    # personalized page rank
    ppr_alpha: float = 0.85
    ppr_max_iter: int = 30
    ppr_tol: float = 1e-4
    ppr_co_mentions: int = 500
    ppr_entities: int = 5
    ppr_seeds: int = 10
    # models
    batch_size: int = 16

    @classmethod
    def in_memory(cls, **changes) -> Config:
        """The variant whose short summaries are the texts themselves and whose model sees longer ones."""
        return replace(cls(summary_chars=4000, summary_error_chars=300, summary_echo=1), **changes)

    @classmethod
    def from_env(cls, **changes) -> Config:
        found = {f.name: type(f.default)(os.environ[n]) for f in fields(cls) if (n := f"HOPWEAVE_{f.name.upper()}") in os.environ}
        return replace(cls(), **(found | changes))


def local_model(name: str, folders: Sequence[str] | None = None, key: str | None = None) -> str:
    """Where a plug-in model's files are: the path that environment variable `key` names, else a folder for `name` below one of `folders`.

    A name of the form owner/model may be a folder in a folder, the model's own, or one with the parts joined by one or
    two underscores. Without such a folder the name itself is returned, for a plug-in that fetches models.
    HOPWEAVE_MODEL_FOLDERS lists the folders, as paths do in PATH.
    """
    wanted = os.environ.get(key) if key else None
    if wanted and os.path.exists(wanted):
        return wanted
    name = wanted or name
    folders = os.environ.get("HOPWEAVE_MODEL_FOLDERS", "").split(os.pathsep) if folders is None else folders
    forms = (name, name.rpartition("/")[2], name.replace("/", "_"), name.replace("/", "__"))
    return next((path for folder in folders if folder for form in forms if os.path.exists(path := os.path.join(folder, form))), name)
