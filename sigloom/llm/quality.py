"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees grown on a bounded labelled sample give their paths as conjunctive rules; a lasso logistic regression weighs them;
the rules that keep a weight become one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import bounded_sample, small_batches

#: Bound of the labelled sample: the rows of the smallest hashes of doc_id.
SAMPLE = 12_000

STATS = ["chars", "words", "lines", "word_len", "upper", "digit", "punct", "symbol", "pipe", "mark", "wide", "space", "same_lines", "longest_line", "new_words", "ends_odd"]
_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "punct": b".,;:?'\"()-", "symbol": b"#$%&*@^~_=+<>{}[]\\/`", "pipe": b"|", "mark": b"!",
    "wide": bytes(range(128, 256)), "space": b" \t\n\r",
}


def _measure(text: bytes, sums: np.ndarray) -> list[float]:
    n = max(1, len(text))
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w = max(1, len(words))
    share = dict(zip(_GROUPS, sums / n, strict=True))
    odd = sum(not (x[-1:].isalnum() or x[-1] > 127 or x[-1:] in b".,") for x in words) / w
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), min(50.0, n / w), *share.values(),
        1 - len(set(lines)) / max(1, len(lines)), max(map(len, lines), default=0) / n, len(set(words)) / w, odd,
    ]


_TABLE = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS.values()):
    _TABLE[list(_g), _i] = 1


def _stats(texts: pa.Array) -> pa.Array:
    """STATS of each text (binary); of a null or empty text those of no characters."""
    rows = [(x or b"") for x in texts.to_pylist()]
    counts = np.array([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in rows]).reshape(len(rows), 256) @ _TABLE
    table = np.array([_measure(x, c) for x, c in zip(rows, counts, strict=True)], float).reshape(len(rows), len(STATS))
    return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(STATS))], STATS)


def text_stats(text: Column) -> Column:
    return F.arrow_udf(_stats, "struct<" + ",".join(f"{s}:double" for s in STATS) + ">")(text)


@dataclass(frozen=True)
class Rule:
    """All of its tests hold: (statistic, above or not, threshold)."""

    tests: tuple[tuple[int, bool, float], ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.tests:
            out &= (x[:, f] > t) == above
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for f, above, t in self.tests:
            c = stats[STATS[f]]
            out = out & ((c > t) if above else (c <= t))
        return out


def _grow(x: np.ndarray, y: np.ndarray, features: np.ndarray, depth: int, least: int, tests: tuple = ()) -> list[Rule]:
    """Paths, from the root to every node, of a tree of least Gini impurity over the quantiles of features."""
    out = [Rule(tests)] if tests else []
    if not depth or len(y) < 2 * least or y.min() == y.max():
        return out
    best = (1e-9, -1, 0.0)
    base = len(y) * y.mean() * (1 - y.mean())
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, up = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        cuts = cuts[(cuts >= least) & (cuts <= len(y) - least)]
        if not len(cuts):
            continue
        a, b = up[cuts - 1], up[-1] - up[cuts - 1]
        gain = base - a * (1 - a / cuts) - b * (1 - b / (len(y) - cuts))
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), int(f), float((v[cuts[k]] + v[cuts[k] - 1]) / 2))
    if best[1] < 0:
        return out
    _, f, t = best
    above = x[:, f] > t
    for side in (False, True):
        m = above == side
        out += _grow(x[m], y[m], features, depth - 1, least, (*tests, (f, side, t)))
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal gradient steps."""
    n, k = r.shape
    rate = 4.0 * n / max(1.0, np.linalg.norm(np.c_[np.ones(n), r], 2) ** 2)
    w = z = np.zeros(k + 1)
    w[0] = z[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z[0] + r @ z[1:], -30, 30)))
        g = np.r_[(p - y).mean(), r.T @ (p - y) / n]
        new = z - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - rate * penalty)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        margin = F.lit(self.intercept)
        for rule, w in self.rules:
            margin = margin + F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """The model of a labelled sample. No rows: every text scores 0.5; one label only: near that label."""
    if not len(y):
        return RuleModel(0.0, ())
    prior = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return RuleModel(float(np.log(prior / (1 - prior))), ())
    rng, found = np.random.default_rng(seed), {}
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), 3000))
        features = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        for rule in _grow(x[rows], y[rows].astype(float), features, depth, max(3, len(rows) // 200)):
            on = rule.of(x)
            if 0 < on.sum() < len(y):
                found.setdefault(on.tobytes(), (rule, on))
    kept = sorted(found.values(), key=lambda ro: repr(ro[0]))
    if not kept:
        return RuleModel(float(np.log(prior / (1 - prior))), ())
    b, w = _lasso(np.array([on for _, on in kept], float).T, y.astype(float), penalty)
    return RuleModel(b, tuple((r, float(v)) for (r, _), v in zip(kept, w, strict=True) if abs(v) > 1e-4))


def fold(doc_id: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Fit on at most `sample` labelled documents whose fold is not 0. A document labelled twice takes the larger label; of several rows with one
    doc_id the one of the smallest statistics counts."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = bounded_sample(known, "doc_id", sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", text_stats(F.col("text").cast("binary")).alias("s")).collect()
    # a doc_id of several rows teaches with the one of the least statistics, whatever order they come in
    rows = list({r.doc_id: r for r in sorted(rows, key=lambda r: (r.doc_id, tuple(r.s)), reverse=True)}.values())[::-1]
    x = np.array([list(r.s) for r in rows], float).reshape(len(rows), len(STATS))
    return fit_rules(x, np.array([int(r.quality > 0) for r in rows], int))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Null and empty texts score as texts of no characters; a null doc_id is
    not held out; repeated rows score alike; only the text is an input, so that lang, source and further columns play no part."""
    model = learn(docs, labels)
    scored = docs.select("doc_id", text_stats(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("s"))
    score = model.score(F.col("s"))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least threshold, unchanged: each is judged by itself, so that repeated rows stay or go together; null and
    empty texts are judged as texts of no characters; an empty table stays empty, and without labels every text scores 0.5 and stays."""
    model = learn(docs, labels)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rated = docs.select(row.alias("row"), text_stats(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("stats"))
    return rated.where(model.score(F.col("stats")) >= threshold).select("row.*")
