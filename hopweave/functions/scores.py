"""Scores of the search over columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that results depend on.
SOURCE_WEIGHTS = {"QueryEnt": 1.0, "EntBridge": 0.90, "RelPath": 0.85, "SummaryDrill": 0.85, "Sem": 0.80, "VectorJump": 0.75, "Seq": 0.65}
OTHER_SOURCE_WEIGHT = 0.90
TRUST_WITH_RANK = (0.50, 0.10, 0.15, 0.12, 0.13)
TRUST_WITHOUT_RANK = (0.55, 0.15, 0.15, 0.15)


def squash(score: Column) -> Column:
    return 1 / (1 + F.exp(-score / 5))


def coverage(text: Column, entities: Column) -> Column:
    """0.3, and up to 0.7 more by the share of entities that the text holds."""
    found = F.size(F.filter(entities, lambda e: F.contains(F.lower(text), e)))
    return F.when(F.size(entities) > 0, 0.3 + 0.7 * found / F.size(entities)).otherwise(0.3)


def path_penalty(depth: Column) -> Column:
    return 1 / (1 + 0.15 * depth)


def source_weight(source: Column) -> Column:
    out = F
    for name, w in SOURCE_WEIGHTS.items():
        out = out.when(source == name, w)
    return out.otherwise(OTHER_SOURCE_WEIGHT)


def trust(rerank: Column, ppr: Column, text: Column, entities: Column, depth: Column, source: Column) -> Column:
    """The weighted sum of all signals; `ppr` is null for questions without page rank, whose weight the others share."""
    signals = (squash(rerank), coverage(text, entities), path_penalty(depth), source_weight(source))
    a, r, *rest = TRUST_WITH_RANK
    ranked = sum((w * s for w, s in zip(rest, signals[1:], strict=True)), a * signals[0] + r * ppr)
    plain = sum((w * s for w, s in zip(TRUST_WITHOUT_RANK[1:], signals[1:], strict=True)), TRUST_WITHOUT_RANK[0] * signals[0])
    return F.when(ppr.isNull(), plain).otherwise(ranked)


def keeps(score: Column, small: Column, n_selected: Column, threshold: float, least: int) -> Column:
    """Whether a popped chunk is evidence: by its score, and in a small space as long as there is little."""
    return (score >= threshold) | (small & (F.coalesce(n_selected, F.lit(0)) < least))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision and in the order of the components; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)
