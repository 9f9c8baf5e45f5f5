"""Language ID: the family first, then one-versus-one linear SVMs between a family's languages.

A text becomes the square roots of its hashed byte 2- and 3-gram counts (lower case, everything
that is not a letter a blank), scaled to length one. Families and languages within a family are
told apart by squared-hinge linear SVMs, one per pair of classes, fitted to a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeter.llm.common import fold, table

#: Distinct texts in the sample, about; languages share it evenly.
SAMPLE = 2_000
#: Values of lang that are learned at most.
LANGUAGES = 100
WIDTH = 2_048
STEPS = 150
PENALTY = 1e-4
UNKNOWN = "und"
#: Bytes of a text that are looked at in one go.
STRIDE = 1 << 20

# Families of languages by code, fixed values; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")
# ASCII that is not a letter becomes a blank
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    """Unit vector of a text; zeros if it has fewer than two bytes."""
    counts = np.zeros(WIDTH)
    data = text.lower().encode("utf-8", "replace").translate(_PLAIN)
    data = b" " + data + b" "
    for at in range(0, len(data) - 2, STRIDE):
        a = np.frombuffer(data[at : at + STRIDE + 2], np.uint8).astype(np.uint32)
        two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + a[2:] * np.uint32(0x27D4EB2F)
        blank = (a[:-1] == 32) & (a[1:] == 32)
        counts += np.bincount((two[~blank] >> np.uint32(21)) & np.uint32(WIDTH - 1), minlength=WIDTH)
        counts += np.bincount((three[~blank[:-1]] >> np.uint32(21)) & np.uint32(WIDTH - 1), minlength=WIDTH)
    out = np.sqrt(counts)
    size = np.linalg.norm(out)
    return (out / size if size else out).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) by accelerated gradient steps on the mean squared hinge loss."""
    n, k = x.shape
    w, v, t = np.zeros(k + 1, np.float32), np.zeros(k + 1, np.float32), 1.0
    side = np.where(y, 1.0, -1.0).astype(np.float32)
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)).astype(np.float32)
    step = 1.0 / (4.0 + PENALTY)
    for _ in range(STEPS):
        slack = np.maximum(1 - side * (x @ v[:-1] + v[-1]), 0) * side * weight
        grad = np.append(-2 * (x.T @ slack) + PENALTY * v[:-1], -2 * slack.sum())
        w2 = (v - step * grad).astype(np.float32)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = (w2 + (t - 1) / t2 * (w2 - w)).astype(np.float32)
        w, t = w2, t2
    return w


@dataclass(frozen=True)
class Duels:
    """One-versus-one machines between classes."""

    classes: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH + 1), np.float32))

    @classmethod
    def fit(cls, x: np.ndarray, names: np.ndarray) -> Duels:
        classes = tuple(sorted(set(names)))
        pairs = tuple(combinations(range(len(classes)), 2))
        rows = []
        for i, j in pairs:
            of = (names == classes[i]) | (names == classes[j])
            rows.append(_svm(x[of], names[of] == classes[i]))
        return cls(classes, pairs, np.stack(rows) if rows else np.zeros((0, x.shape[1] + 1), np.float32))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean chance of each class to win its duels."""
        if len(self.classes) == 1:
            return np.ones((len(x), 1))
        out = np.zeros((len(x), len(self.classes)))
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        won = 1 / (1 + np.exp(-2.5 * np.clip(margin, -20, 20)))
        for k, (i, j) in enumerate(self.pairs):
            out[:, i] += won[:, k]
            out[:, j] += 1 - won[:, k]
        return out / (len(self.classes) - 1)


@dataclass(frozen=True)
class Model:
    families: Duels | None
    languages: dict[str, Duels]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not known or self.families is None:
            return names, scores
        for lo in range(0, len(known), 512):
            part = known[lo : lo + 512]
            x = np.stack([features(texts[i]) for i in part])
            p = self.families.probabilities(x)
            best = p.argmax(1)
            for f in set(best):
                mine = np.flatnonzero(best == f)
                duels = self.languages[self.families.classes[f]]
                q = duels.probabilities(x[mine])
                for k, row in zip(mine, q, strict=True):
                    names[part[k]] = duels.classes[int(row.argmax())]
                    scores[part[k]] = p[k, f] * row.max()
        return names, np.clip(scores, 0, 1)


@F.pandas_udf(T.BinaryType())
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t or "").tobytes() for t in texts])


def sample(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Distinct (lang, text) pairs outside fold 1 of 3, about ``rows`` of them, evenly by language.

    A text is in if its hash lies below the language's share of its distinct texts, so the choice does
    not depend on how rows are dealt, and copies neither add to it nor take from it; a language with few
    texts (up to twice its share) gives all. Of more than
    ``LANGUAGES`` values of lang, those with most texts are learned.
    """
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(3) != 1))
    texts = learn.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n"))
    counts = {r["lang"]: r["n"] for r in texts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return learn.select("lang", F.xxhash64("text").alias("h"), "text").limit(0)
    each = max(20, rows // len(counts))
    # with few texts all are in, also where the count of them is a little off
    shares = [x for k, n in counts.items() for x in (F.lit(k), F.lit(1.0 if n <= 2 * each else each / n))]
    place = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_000)) / 1e6
    picked = learn.where(place < F.try_element_at(F.create_map(*shares), F.col("lang")))
    return picked.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))


def train(docs: DataFrame) -> Model:
    """Only vectors of the sample reach the driver; lang is the label and never an input."""
    picked = sample(docs).select("lang", "h", _features("text").alias("x")).toPandas()
    if not len(picked):
        return Model(None, {})
    picked = picked.sort_values(["lang", "h"])
    x = np.stack([np.frombuffer(v, np.float32) for v in picked.pop("x")])
    langs = picked["lang"].to_numpy(str)
    families = np.array([FAMILY_OF.get(c, c) for c in langs])
    return Model(
        Duels.fit(x, families),
        {f: Duels.fit(x[families == f], langs[families == f]) for f in sorted(set(families))},
    )


def prediction(model: Model, text: str = "text") -> Column:
    """Struct (lang_pred, score) of a text column; ``und`` and 0 without a letter."""

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores = model.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return run(F.col(text))


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    rows = docs.select("doc_id", (fold(3) == 1).alias("held_out"), prediction(model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
