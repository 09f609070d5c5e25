"""Quality classifier by co-training.

Two logistic models see different views of a document: its text (hashed words and pairs of successive words, and shapes
of characters, words and lines) and its page metadata (source, language, and the length that the metadata state). Both
start from the labelled rows. In each round every view labels those unlabelled documents of the whole corpus that it is
most sure of, a share of them for each class (by a distributed quantile) if their calibrated probability is LEAST_SURE
at least, and the other view learns from them, the classes in the labelled rows' proportion and never outweighing them.
A view without such documents of both classes gives none, nor does one that doesn't tell the classes apart on held-out labelled rows
(a rank test), as metadata alone may not; and a view goes back to what it was before a round that raised its held-out
loss. `Model.history` says how many labels each view gave in each round, and whether they stayed. The views are
calibrated on held-out labelled rows (Platt), combined as independent evidence, and the sum is calibrated on others that
were held out for it. All documents are scored.

Features are made once, in one pass over the texts, and kept as narrow rows (TEXT_WORDS bytes and some numbers). A
learning pass over them sums gradients on the executors; only the sums (some hundred numbers, whatever the input) reach
the driver, which weighs them by the labelled rows' curvature. The labelled rows that the driver holds are a sample of
at most LABELLED, chosen by a hash of their id.

Defined results: texts without words, null ones included, score 0 and are rejected; ids without a label just aren't
labelled, and of several labels of one id the mean decides; where the labelled rows lack a class nothing can be
learned, and every document with words scores 1; null sources, languages and lengths are values of their own; repeated
rows are scored alike, and rows of one id, null ids too, stay or go each by its own score; extra columns stay in
`keep_good`'s result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, small_batches, table

LABELLED, FOLDS, ROUNDS, STEPS = 20_000, 10, 3, 2
#: The share of all unlabelled documents that a view labels of a class, and how sure it must be of them.
SURE_SHARE, LEAST_SURE = 0.05, 0.85
RIDGE, THRESHOLD = 1e-2, 0.5
SOURCES, LANGS = 64, 16
#: Buckets of words and of pairs of words, and shapes.
TEXT_WORDS, TEXT_SHAPES, META_FEATURES = 512, 16, 3 + SOURCES + LANGS
TEXT_FEATURES = TEXT_SHAPES + TEXT_WORDS
#: Steps of a logarithmic count that a byte holds.
COUNT_STEPS = 24.0
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, PIPE, MARK, SIGN = range(9)


def kinds() -> np.ndarray:
    out = np.full(0x250, LOWER, np.uint8)
    for c in range(0x250):
        s = chr(c)
        out[c] = LINE if s == "\n" else SPACE if s.isspace() else UPPER if s.isupper() else LOWER if s.isalpha() else DIGIT if s.isdigit() else STOP if s in ".,;:?'\"-()’" else PIPE if s in "|\t" else MARK if s == "!" else SIGN
    return out


KIND = kinds()


POWERS = np.cumprod(np.full(1 << 10, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def word_counts(text: str) -> bytes:
    """Logarithmic counts of hashed words (first half) and pairs of successive words (second half), a byte each.

    A word's hash is a polynomial of its code points, whose powers repeat after 1,024 of them.
    """
    half = TEXT_WORDS // 2
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = KIND[np.minimum(code, 0x24F)]
    inside = (kind != SPACE) & (kind != LINE)
    begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(begins):
        return bytes(TEXT_WORDS)
    first = np.repeat(begins, np.diff(np.append(begins, len(code))))
    at = np.arange(begins[0], len(code))
    terms = np.where(inside[begins[0] :], (code[begins[0] :].astype(np.uint64) + np.uint64(1)) * POWERS[(at - first) & 1023], np.uint64(0))
    h = np.add.reduceat(terms, begins - begins[0])
    pairs = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]
    spread = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    counts = [np.bincount((spread(x) % np.uint64(half)).astype(np.int64), minlength=half) for x in (h, pairs)]
    return np.minimum(255, np.round(COUNT_STEPS * np.log1p(np.concatenate(counts)))).astype(np.uint8).tobytes()


def text_shapes(text: str | None) -> np.ndarray:
    w = (text or "").split()
    if not w:
        return np.zeros(TEXT_SHAPES)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(KIND[np.minimum(code, 0x24F)], minlength=9)
    words, distinct, letters = len(w), len(set(w)), max(1, n[LOWER] + n[UPPER])
    same = sum(map(operator.eq, w, w[1:]))
    lines = n[LINE] + 1
    shown = len(code)
    return np.array([
        1, n[UPPER] / letters, n[SIGN] / shown, n[MARK] / shown, n[PIPE] / shown, n[DIGIT] / shown, n[STOP] / words, letters / words,
        distinct / words, np.log(distinct) / np.log(words + 1), same / words, np.log(words), np.log1p(words / lines), lines / words,
        min(1.0, (n[SIGN] + n[MARK] + n[PIPE]) / words), np.sqrt(n[UPPER] / letters),
    ])


def bucket(value: str | None, n: int) -> int:
    return 0 if value is None else 1 + xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) % (n - 1)


def meta_matrix(b: pd.DataFrame) -> np.ndarray:
    out = np.zeros((len(b), META_FEATURES))
    size = b["size"].to_numpy(float)
    out[:, 0], out[:, 1], out[:, 2] = 1, np.maximum(size, 0), size < 0
    rows = np.arange(len(b))
    out[rows, 3 + b["source"].to_numpy(int)] = 1
    out[rows, 3 + SOURCES + b["lang"].to_numpy(int)] = 1
    return out


def text_matrix(b: pd.DataFrame) -> np.ndarray:
    """Shapes, and the words' logarithmic counts by the logarithm of their number."""
    if not len(b):
        return np.zeros((0, TEXT_FEATURES), np.float32)
    shapes = np.stack(b["f"].to_numpy()).astype(np.float32)
    counts = np.frombuffer(b"".join(b["w"]), np.uint8).reshape(len(b), TEXT_WORDS).astype(np.float32)
    return np.concatenate((shapes, counts / COUNT_STEPS / np.maximum(shapes[:, 11:12], 0.7)), axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Rows whose curvature is summed at once, and the most standard deviations that a text feature counts.
BLOCK, FAR = 4_096, 4.0
#: What a calibration's prior weighs.
AS_IS = 2.0


def slope_of(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The gradient of the log-likelihood at beta."""
    return x.T.astype(float) @ (y - sigmoid(x @ beta)) if len(x) <= BLOCK else sum(slope_of(x[i : i + BLOCK], y[i : i + BLOCK], beta) for i in range(0, len(x), BLOCK))


def curve_of(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[1], x.shape[1]))
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK]
        p = sigmoid(part @ beta)
        out += (part * (p * (1 - p))[:, None].astype(part.dtype)).T @ part
    return out


def step(beta: np.ndarray, curve: np.ndarray, slope: np.ndarray, n: float) -> np.ndarray:
    """A damped Newton step with a ridge."""
    ridge = RIDGE * max(1.0, n) ** 0.5 * np.ones(len(beta))
    if len(beta) == TEXT_FEATURES:
        ridge[TEXT_SHAPES:] *= 100  # many weak words against few strong shapes
    move = np.linalg.solve(curve + np.diag(ridge + 1e-6), slope - ridge * beta)
    return beta + move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 15) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        before = beta
        beta = step(beta, curve_of(x, beta), slope_of(x, y, beta), len(y))
        if np.abs(beta - before).max() < 1e-4:
            break
    return beta


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) that calibrate log-odds z on y, with the smoothed targets of Platt.

    A prior of AS_IS rows holds them near (1, 0): with few held-out rows the log-odds stay as the model states them.
    """
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([np.clip(z, -20, 20), np.ones(len(z))], axis=1)
    start = np.array([1.0, 0.0])
    beta = start
    for _ in range(50):
        p = sigmoid(x @ beta)
        slope, curve = x.T @ (goal - p) - AS_IS * (beta - start), (x * (p * (1 - p))[:, None]).T @ x + AS_IS * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curve, slope), -1, 1)
    return max(float(beta[0]), 0.0), float(beta[1])


@dataclass
class Model:
    """Both views' weights over scaled features, their calibrations and that of their sum."""

    mean: np.ndarray
    scale: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    text_fit: tuple[float, float] = (1.0, 0.0)
    meta_fit: tuple[float, float] = (1.0, 0.0)
    both_fit: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0
    #: (round, view that learns, documents labelled 0 and 1 by the other view, whether the lesson stayed).
    history: list[tuple[int, str, int, int, bool]] = field(default_factory=list)

    def texts(self, b: pd.DataFrame) -> np.ndarray:
        return np.clip((text_matrix(b) - self.mean) / self.scale, -FAR, FAR).astype(np.float32)

    def views(self, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of the two views."""
        t, m = self.texts(b) @ self.text, meta_matrix(b) @ self.meta
        return t * self.text_fit[0] + self.text_fit[1], m * self.meta_fit[0] + self.meta_fit[1]

    def both(self, b: pd.DataFrame) -> np.ndarray:
        t, m = self.views(b)
        return t + m - self.prior


NAME = ["name", "name2"]


def features(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, NAME, f, w, size, source, lang, words, y): one narrow row for each row of `docs`; y is null for most."""
    small_batches(docs.sparkSession)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = [text_shapes(t) for t in b["text"]]
            yield pd.DataFrame({
                "none": b["none"], "key": b["key"], "name": b["name"], "name2": b["name2"], "f": f, "w": [word_counts(t) if t else bytes(TEXT_WORDS) for t in b["text"]],
                "size": b["size"], "source": [bucket(s, SOURCES) for s in b["source"]], "lang": [bucket(s, LANGS) for s in b["lang"]], "words": [bool(x[0]) for x in f],
            })

    rows = docs.select(*inputs(docs, key, text), *name_of(docs, key, text)).select(F.col("key").isNull().alias("none"), F.coalesce("key", F.lit(0)).alias("key"), *NAME, "text", "size", "source", "lang")
    schema = "none boolean, key long, name long, name2 long, f array<float>, w binary, size double, source int, lang int, words boolean"
    rows = rows.mapInPandas(made, schema).withColumn("key", F.when(~F.col("none"), F.col("key"))).drop("none")
    known = labels.select(F.col(labels.columns[0] if key not in labels.columns else key).cast("long").alias("labelled"), F.col(label).cast("double").alias("y"))
    known = known.where("labelled IS NOT NULL AND y IS NOT NULL").groupBy("labelled").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    return cut(rows.join(known, rows.key == known.labelled, "left").drop("labelled"))


def inputs(docs: DataFrame, key: str, text: str) -> list[Column]:
    """key, text, size, source and lang: all that a score depends on; a missing column counts as null."""
    column = lambda name, kind: (F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast(kind)
    size = F.coalesce(F.log1p(F.greatest(column("n_chars", "double"), F.lit(0.0))), F.lit(-1.0))
    return [F.col(key).cast("long").alias("key"), F.col(text).alias("text"), size.alias("size"), column("source", "string").alias("source"), column("lang", "string").alias("lang")]


def name_of(docs: DataFrame, key: str, text: str) -> list[Column]:
    """Two hashes that name a row by its inputs."""
    own = inputs(docs, key, text)
    return [F.xxhash64(F.lit(i), *own, *(c.isNull() for c in own)).alias(n) for i, n in enumerate(NAME)]


def tells_apart(z: np.ndarray, y: np.ndarray) -> bool:
    """Whether scores z rank class 1 over class 0 beyond chance (one-sided, about 1 in 200)."""
    n1, n0 = y.sum(), (1 - y).sum()
    ranks = pd.Series(z).rank().to_numpy()
    auc = (ranks[y > 0].sum() - n1 * (n1 + 1) / 2) / max(1.0, n1 * n0)
    return auc - 0.5 > 2.6 * np.sqrt((n1 + n0 + 1) / (12 * max(1.0, n1 * n0)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -z, z)).mean())


def sure(rows: DataFrame, model: Model) -> dict[tuple[str, int], float]:
    """By (view, class): the log-odds from which (class 1) or down to which (class 0) the view labels, over all unlabelled rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t, m = model.views(b)
            yield pd.DataFrame({"text": t, "meta": m})

    scores = rows.where("y IS NULL AND words").mapInPandas(run, "text double, meta double")
    got = scores.agg(*(F.percentile_approx(v, [SURE_SHARE, 1 - SURE_SHARE], 2_000).alias(v) for v in ("text", "meta"))).first()
    least = float(np.log(LEAST_SURE / (1 - LEAST_SURE)))
    return {(v, c): (max(least, got[v][1]) if c else min(-least, got[v][0])) if got[v] else least * (2 * c - 1) for v in ("text", "meta") for c in (0, 1)}


def learning_pass(rows: DataFrame, model: Model, limits: dict[tuple[str, int], float]) -> dict[tuple[str, int], tuple[np.ndarray, float]]:
    """By (view, class): gradient and count over the unlabelled rows that the other view is sure of."""
    sizes = {"text": len(model.text), "meta": len(model.meta)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {(v, c): np.zeros(n + 1) for v, n in sizes.items() for c in (0, 1)}
        for b in batches:
            z = dict(zip(("text", "meta"), model.views(b), strict=True))
            for view, other in (("text", "meta"), ("meta", "text")):
                for c in (0, 1):
                    held = z[other] >= limits[other, 1] if c else z[other] <= limits[other, 0]
                    if held.any():
                        x = model.texts(b[held]) if view == "text" else meta_matrix(b[held])
                        total[view, c] += np.append(slope_of(x, np.full(len(x), float(c)), getattr(model, view)), len(x))
        for (view, c), v in total.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"view": view, "c": c, "at": at, "v": v[at]})

    got = rows.where("y IS NULL AND words").mapInPandas(run, "view string, c int, at int, v double").groupBy("view", "c", "at").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for view, n in sizes.items():
        for c in (0, 1):
            v = np.zeros(n + 1)
            part = got[(got["view"] == view) & (got["c"] == c)]
            v[part["at"].to_numpy(int)] = part["v"]
            out[view, c] = (v[:-1], v[-1])
    return out


def train(rows: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model | None:
    """The model, or None where the labelled rows lack a class."""
    known = rows.where("y IS NOT NULL AND words")
    n = known.count()
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(unit < min(1.0, 0.95 * labelled / max(1, n))) if n > labelled else known
    held = sample.limit(labelled).drop(*NAME).toPandas().sort_values(["key", "size"]).reset_index(drop=True)
    y = held["y"].to_numpy(float)
    if min(y.sum(), (1 - y).sum()) < 2:
        return None
    both_classes = lambda m: 0 < y[m].sum() < m.sum()
    fold = np.fromiter((xxhash.xxh64_intdigest(str(k)) % FOLDS for k in held["key"]), np.int64, len(held))
    views, last = fold == 0, fold == 1  # held out for the views' calibration, and for that of their sum
    learn = ~views & ~last
    if not (both_classes(views) and both_classes(last) and both_classes(learn)):
        views = last = learn = np.ones(len(held), bool)
    y_learn = y[learn]
    raw = text_matrix(held[learn])
    mean, scale = raw.mean(axis=0), raw.std(axis=0)
    mean[0], scale[0] = 0, 1
    model = Model(mean, np.where(scale > 1e-6, scale, 1), np.zeros(TEXT_FEATURES), np.zeros(META_FEATURES), prior=float(np.log(y.sum() / (1 - y).sum())))
    xs = {"text": model.texts(held[learn]), "meta": meta_matrix(held[learn])}
    model.text, model.meta = fit(xs["text"], y_learn), fit(xs["meta"], y_learn)

    def calibrate() -> None:
        model.text_fit = platt(model.texts(held[views]) @ model.text, y[views])
        model.meta_fit = platt(meta_matrix(held[views]) @ model.meta, y[views])

    calibrate()
    for turn in range(rounds):
        held_out = dict(zip(("text", "meta"), model.views(held[views]), strict=True))
        limits = sure(rows, model)
        for v, z in held_out.items():
            if not tells_apart(z, y[views]):
                limits[v, 0], limits[v, 1] = -np.inf, np.inf
        before = {v: (getattr(model, v), loss(z, y[views])) for v, z in held_out.items()}
        curves = {v: curve_of(xs[v], getattr(model, v)) for v in xs}
        given: dict[str, list[int]] = {}
        for _ in range(STEPS):
            extra = learning_pass(rows, model, limits)
            for view in ("text", "meta"):
                beta = getattr(model, view)
                slope, weight = slope_of(xs[view], y_learn, beta), float(len(y_learn))
                own = {1: y_learn.sum(), 0: (1 - y_learn).sum()}
                # the classes keep the labelled rows' proportion, and at most their weight
                whole = min(1.0, *(extra[view, c][1] / own[c] for c in own))
                for c in own:
                    more, count = extra[view, c]
                    if count:
                        slope, weight = slope + whole * own[c] / count * more, weight + whole * own[c]
                given.setdefault(view, [int(extra[view, c][1]) for c in (0, 1)])
                # pseudo-labelled rows curve like labelled ones
                setattr(model, view, step(beta, curves[view] * (weight / len(y_learn)), slope, weight))
        calibrate()
        for view, z in zip(("text", "meta"), model.views(held[views]), strict=True):
            old, least = before[view]
            stays = min(given[view]) > 0 and loss(z, y[views]) <= least + 1e-9
            if not stays:
                setattr(model, view, old)
            model.history.append((turn, view, *given[view], stays))
        calibrate()
        if not any(stays for t, *_, stays in model.history if t == turn):
            break
    model.both_fit = platt(model.both(held[last]), y[last])
    return model


def judged(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, threshold: float, rounds: int) -> DataFrame:
    """(none, key, NAME, text_score, meta_score, score, good) for each row of `docs`."""
    rows = features(docs, labels, key, text, label)
    model = train(rows, rounds=rounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = b["words"].to_numpy(bool)
            if model is None:
                t = m = s = np.ones(len(b))
            else:
                t, m = map(sigmoid, model.views(b))
                s = sigmoid(model.both(b) * model.both_fit[0] + model.both_fit[1])
            t, m, s = (np.round(np.where(words, v, 0.0), 6) for v in (t, m, s))
            yield pd.DataFrame({"none": b["none"], "key": b["key"], "name": b["name"], "name2": b["name2"], "text_score": t, "meta_score": m, "score": s, "good": words & (s >= threshold)})

    rows = rows.drop("y").withColumn("none", F.col("key").isNull()).withColumn("key", F.coalesce("key", F.lit(0)))
    return rows.mapInPandas(run, "none boolean, key long, name long, name2 long, text_score double, meta_score double, score double, good boolean")


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """(key, text_score, meta_score, score, good) for each row of `docs`; scores are rounded to six places."""
    return judged(docs, labels, key, text, label, threshold, rounds).select(F.when(~F.col("none"), F.col("key")).alias(key), "text_score", "meta_score", "score", "good")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier accepts."""
    bad = judged(docs, labels, key, text, label, threshold, ROUNDS).where("NOT good").select(*NAME).distinct()
    rows = docs.select(F.struct("*").alias("doc_"), *name_of(docs, key, text))
    return rows.join(bad, NAME, "left_anti").select("doc_.*")


def op2(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
