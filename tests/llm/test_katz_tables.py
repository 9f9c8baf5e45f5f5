import functools
import math
from collections import Counter, defaultdict

import brute
import pytest

from admeter.llm import katz, katz_tables
from pyspark.sql import functions as F


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def brute_model(train, order):
    """p(w | h) of a Katz model of the order, as dictionaries say it."""
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        t = [None] * (order - 1) + t
        for i in range(order - 1, len(t)):
            for k in range(1, order + 1):
                counts[k][tuple(t[i - k + 1 : i + 1])] += 1
    d = [None] + [
        katz.discounts([Counter(c.values())[r] for r in range(katz.CUT + 2)]) for c in counts[1:]
    ]
    after = [defaultdict(dict) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            after[k][g[:-1]][g[-1]] = c

    def less(c, k):
        return c * (d[k][c] if c <= katz.CUT else 1.0)

    @functools.cache
    def context(h):
        """What counts are divided by and the weight of words not seen; None for a new context."""
        k, seen = len(h) + 1, after[len(h) + 1].get(h)
        if not seen:
            return None
        n, mass = sum(seen.values()), sum(less(c, k) for c in seen.values())
        if k == 1:
            over = n if mass < n else n + 1
            return over, 1 - mass / over
        rest = 1 - sum(p(h[1:], x) for x in seen)
        n = mass if rest <= 1e-12 else n if mass < n else n + 1
        return n, (1 - mass / n) / rest if rest > 1e-12 else 0.0

    def p(h, w):
        known, k = context(h), len(h) + 1
        if known and w in after[k][h]:
            return less(after[k][h][w], k) / known[0]
        weight = known[1] if known else 1.0
        return weight * p(h[1:], w) if h else weight

    return counts, p


def brute_scores(rows, p, order):
    out = Counter()
    cache = {}
    for r in rows:
        t = tokens(r["text"])
        padded = [None] * (order - 1) + t
        total = 0.0
        for i in range(len(t)):
            g = tuple(padded[i : i + order])
            if g not in cache:
                cache[g] = math.log10(p(g[:-1], g[-1]))
            total += cache[g]
        out[r["doc_id"], len(t), round(total, 4)] += 1
    return out


TRAIN = ["a b a c", "a b", "b b b b b b b", "c", "", None, "A a a a a a a a", "d e f g a b", "x y z x y z x y w"] * 2
OTHER = ["a b z", "never seen", "", None, "x y z x", "d e f g a b", "d e f g a b", "a b a c b"]


@pytest.mark.parametrize("order", [1, 3])
def test_texts_outside_the_corpus(spark, tmp_path, order):
    docs = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    other = [{"doc_id": None if i == 3 else i // 2, "text": t} for i, t in enumerate(OTHER + OTHER[-2:])]
    katz_tables.fit(docs, f"{tmp_path}/m", order)
    model = katz_tables.Model(spark, f"{tmp_path}/m")  # as another session would open it
    got = model.score(spark.createDataFrame(other, "doc_id long, text string")).collect()
    counts, p = brute_model([tokens(t) for t in TRAIN], order)
    assert Counter((*r[:2], round(r.score, 4)) for r in got) == brute_scores(other, p, order)
    assert [(t["tokens"], t["ngrams"]) for t in model.totals()] == [(sum(c.values()), len(c)) for c in counts[1:]]


@pytest.mark.parametrize("order", [3])
def test_probabilities_of_a_context_add_up_to_one(spark, tmp_path, order):
    """Over the training words and one unknown, for every context and some that were never seen."""
    docs = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    model = katz_tables.fit(docs, f"{tmp_path}/m", order)
    words = ["", *sorted({w for t in TRAIN for w in (t or "").lower().split()}), "unknown"]
    hashed = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w) AS w")
    names = katz_tables._names(order)
    seen = katz_tables.grams(docs, order, []).select(*names[:-1]).distinct()
    strange = spark.range(3).selectExpr(*[f"id + {i} AS {g}" for i, g in enumerate(names[:-1])])
    asked = seen.unionByName(strange).crossJoin(hashed.withColumnRenamed("w", names[-1]))
    found = model.probabilities(asked, order, model.totals()[0]["unknown"])
    sums = [r["s"] for r in found.groupBy(*names[:-1]).agg({"p": "sum"}).withColumnRenamed("sum(p)", "s").collect()]
    assert len(sums) > 10 and sums == pytest.approx([1.0] * len(sums))


@pytest.mark.parametrize("kind", ["odd", "sf"])
def test_whole_tables(spark, folders, tmp_path, kind):
    """Order 3 against dictionaries, order 2 against the scores of ``katz``."""
    rows = brute.rows(folders[kind])
    docs = spark.read.parquet(f"{folders[kind]}/documents.parquet").select("doc_id", "text", (katz.fold(5) == 1).alias("held_out"))
    _, p = brute_model([tokens(r["text"]) for r in rows if brute.fold(r["doc_id"], 5) != 1], 3)
    got = katz_tables.fit(docs.where("not held_out"), f"{tmp_path}/three").score(docs).collect()
    assert Counter((*r[:2], round(r.score, 4)) for r in got) == brute_scores(rows, p, 3)
    if kind == "sf":
        two = katz_tables.fit(docs.where("not held_out"), f"{tmp_path}/two", 2).score(docs).collect()
        want = {r.doc_id: r for r in katz.scores(docs).collect()}
        assert len(two) == len(want)
        for r in two:
            assert r.n_tokens == want[r.doc_id].n_tokens and r.score == pytest.approx(want[r.doc_id].score, abs=1e-4)


def test_no_text_at_all(spark, empty, tmp_path):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    model = katz_tables.fit(docs, f"{tmp_path}/m")
    assert model.score(docs).collect() == []
    (r,) = model.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    assert tuple(r) == (1, 3, 0.0)
    with pytest.raises(ValueError):
        katz_tables.fit(docs, f"{tmp_path}/n", 0)
