"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small regression trees are boosted on a bounded sample of labelled documents; every path from a
root to a node is a rule (a conjunction of bounds on statistics). An L1-penalised logistic
regression keeps few of them, and the kept rules become one Spark column expression. The
statistics are taken from whole texts in Arrow batches; the rules run in the JVM.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeter.llm.common import fold, table

#: Labelled documents that the model is fitted to, at most.
SAMPLE = 20_000
TREES = 24
DEPTH = 3
BINS = 32
RATE = 0.3
#: Weight of the L1 penalty, per sampled row.
PENALTY = 2e-3
STEPS = 600
THRESHOLD = 0.7

STATS = [
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "upper", "digit", "mark",
    "bang", "symbol", "blank", "high", "log_lines", "distinct_lines", "words_a_mark", "line_words",
]

# Classes of bytes, fixed values.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "mark": b".,;:",
    "bang": b"!?",
    "symbol": b"\"#$%&'()*+-/<=>@[\\]^_`{|}~",
    "blank": b" \t\n\x0b\x0c\r",
    "high": bytes(range(128, 256)),
}
_MEMBERS = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _MEMBERS[list(_c), _i] = 1.0


def _of_words(b: bytes) -> tuple[float, ...]:
    words = b.split()
    n = len(words)
    lines = [x for x in b.split(b"\n") if x]
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    distinct = Counter(words)
    top = max(distinct.values())
    return (
        float(n), sum(map(len, words)) / n, len(distinct) / n, top / n, float(len(lines)),
        len(set(lines)) / max(len(lines), 1),
    )


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATS per text; an empty text has zeros."""
    out = np.zeros((len(texts), len(STATS)))
    counts = np.zeros((len(texts), 256))
    words = np.zeros((len(texts), 6))
    for i, b in enumerate(texts):
        if b:
            counts[i] = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
            words[i] = _of_words(b)
    size = counts.sum(1)
    share = (counts @ _MEMBERS) / np.maximum(size, 1)[:, None]
    by = dict(zip(_CLASSES, share.T, strict=True))
    n = words[:, 0]
    marks = counts[:, [ord("."), ord("!"), ord("?")]].sum(1)
    by |= {
        "log_bytes": np.log1p(size), "log_words": np.log1p(n), "word_bytes": words[:, 1],
        "distinct_words": words[:, 2], "top_word": words[:, 3], "log_lines": np.log1p(words[:, 4]),
        "distinct_lines": words[:, 5], "words_a_mark": n / (marks + 1),
        "line_words": n / np.maximum(words[:, 4], 1),
    }
    for j, name in enumerate(STATS):
        out[:, j] = by[name]
    return out


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def _stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(statistics(list(texts)), columns=STATS)


def stats_of(text: Column) -> Column:
    """Struct of STATS of a text column; null counts as empty."""
    return _stats(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, is upper bound, value) that hold together, and the rule's weight."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, of: str) -> Column:
        out = F.lit(True)
        for name, upper, value in self.bounds:
            c = F.col(of)[name]
            out = out & (c <= value if upper else c > value)
        return out


@dataclass(frozen=True)
class Model:
    base: float
    rules: tuple[Rule, ...] = ()

    def score(self, of: str = "stats") -> Column:
        """Probability of label 1 as a column over a struct of statistics."""
        total = F.lit(self.base)
        for r in self.rules:
            total = total + F.when(r.column(of), r.weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _tree(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, columns: np.ndarray) -> list[tuple]:
    """Nodes of one tree as (bounds, row mask); a bound is (column, upper, bin). Adds RATE steps."""
    nodes = []

    def grow(mask: np.ndarray, bounds: tuple, depth: int) -> None:
        if bounds:
            nodes.append((bounds, mask))
        if depth == DEPTH or mask.sum() < 40:
            return
        best = (1e-6, None)
        g, h = grad[mask], hess[mask]
        whole = g.sum() ** 2 / (h.sum() + 1)
        for c in columns:
            b = binned[mask, c]
            gl = np.cumsum(np.bincount(b, g, BINS))[:-1]
            hl = np.cumsum(np.bincount(b, h, BINS))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
            gain[(nl < 10) | (nl > len(b) - 10)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (c, at))
        if best[1] is None:
            return
        c, at = best[1]
        low = binned[:, c] <= at
        grow(mask & low, bounds + ((c, True, at),), depth + 1)
        grow(mask & ~low, bounds + ((c, False, at),), depth + 1)

    grow(np.ones(len(grad), bool), (), 0)
    return nodes


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Rules from boosted trees, weighted by a lasso logistic regression."""
    n, ones = len(y), float(y.sum())
    base = float(np.log((ones + 1) / (n - ones + 1)))
    if n < 40 or ones in (0, n):
        return Model(base)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    f, found = np.full(n, base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        columns = rng.permutation(x.shape[1])[: x.shape[1] * 2 // 3]
        nodes = _tree(binned, y - p, p * (1 - p), columns)
        for bounds, mask in nodes:
            found.setdefault(mask.tobytes(), (bounds, mask))
        leaves = [(b, m) for b, m in nodes if not any(o != b and o[: len(b)] == b for o, _ in nodes)]
        for _, m in leaves:
            f[m] += RATE * (y - p)[m].sum() / ((p * (1 - p))[m].sum() + 1)
    found = [v for v in found.values() if 10 <= v[1].sum() <= n - 10]
    if not found:
        return Model(base)
    masks = np.stack([m for _, m in found], 1).astype(float)
    base, weights = _lasso(masks, y, PENALTY)
    kept = np.flatnonzero(weights)
    if len(kept):  # the penalty chooses rules; their weights are then fitted without it
        base, weights[kept] = _lasso(masks[:, kept], y, 0.0)
    rules = []
    for (bounds, _), w in zip(found, weights, strict=True):
        if w:
            real = tuple((STATS[c], up, float(cuts[c][at])) for c, up, at in bounds if at < len(cuts[c]))
            rules.append(Rule(real, float(w)))
    return Model(float(base), tuple(rules))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient steps on the mean log loss plus ``penalty`` times |w|."""
    n, k = x.shape
    step = 4.0 * n / (np.linalg.norm(np.hstack([x, np.ones((n, 1))]), 2) ** 2)
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(x @ v + c))) - y
        w2 = v - step * (x.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, np.where(np.abs(w) < 1e-6, 0, w)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to at most ``sample`` labelled documents, those of the smallest hashes of doc_id.

    Rows of fold 2 of 4, null labels and doc_ids with contradicting labels are left out.
    Only the sample's statistics reach the driver.
    """
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(4) != 2))
        .groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
        .where("q = q2").select(F.col("doc_id").alias("marked"), "q")
        .orderBy(F.xxhash64("marked"), "marked").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("marked"))
    # a doc_id may be on many rows: one of its texts is enough
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("q").alias("q"))
    got = rows.select("doc_id", "q", stats_of(F.col("text")).alias("s")).select("doc_id", "q", "s.*").toPandas()
    got = got.sort_values("doc_id")
    return fit(got[STATS].to_numpy(float), got["q"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` and ``predicted`` (score >= 0.7); null and empty texts are scored too."""
    rows = docs.withColumn("__stats", stats_of(F.col("text"))).withColumn("score", model.score("__stats"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop("__stats")


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf, "labels"))
    return score(docs, model).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted"
    )
