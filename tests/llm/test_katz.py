import math
from collections import Counter, defaultdict

import brute
import pytest

from admeter.llm import katz


def brute_model(train):
    """p(w | h) of the words of training texts, as dictionaries say it."""
    c1, c2 = Counter(), Counter()
    for t in train:
        c1.update(t)
        c2.update(zip([None, *t], t, strict=False))

    def cut(counts):
        n = Counter(counts.values())
        return katz.discounts([n[r] for r in range(katz.CUT + 2)])

    def less(c, d):
        return c * (d[c] if c <= katz.CUT else 1.0)

    total = sum(c1.values())
    d1, d2 = cut(c1), cut(c2)
    kept = sum(less(c, d1) for c in c1.values())
    over = total if kept < total else total + 1
    unknown = 1 - kept / over if total else 1.0

    def p1(w):
        return less(c1[w], d1) / over if c1[w] else unknown

    after = defaultdict(dict)
    for (h, w), c in c2.items():
        after[h][w] = c

    def p2(h, w):
        seen = after.get(h)
        if not seen:
            return p1(w)
        n, mass = sum(seen.values()), sum(less(c, d2) for c in seen.values())
        rest = 1 - sum(p1(x) for x in seen)
        n = mass if rest <= 1e-12 else n if mass < n else n + 1
        return less(seen[w], d2) / n if w in seen else (1 - mass / n) / rest * p1(w)

    return c1, p2


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


@pytest.mark.parametrize("kind", ["odd", "sf"])
@pytest.mark.parametrize("stride", [2_000, 6 << 20])
def test_scores_equal_brute_force(spark, folders, monkeypatch, kind, stride):
    monkeypatch.setattr(katz, "STRIDE", stride)
    docs = [(r["doc_id"], brute.fold(r["doc_id"], 5) == 1, tokens(r["text"])) for r in brute.rows(folders[kind])]
    c1, p2 = brute_model([t for _, held, t in docs if not held])
    n, v = sum(c1.values()), len(c1)
    want = Counter()
    for d, held, t in docs:
        base = sum(math.log10((c1[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = sum(math.log10(p2(h, w)) for h, w in zip([None, *t], t, strict=False))
        want[d, held, len(t), sum(c1[w] > 0 for w in t), n, round(base, 4), round(score, 4)] += 1
    got = katz.op2_katz_backoff(spark, folders[kind]).collect()
    assert Counter((*r[:5], round(r.base_score, 4), round(r.score, 4)) for r in got) == want


def test_probabilities_add_up_to_one():
    text = [tokens(t) for t in ("a b a c", "a b", "b b b b b b b", "c", "", "a a a a a a a a", "d e f g a b")]
    for train in (text, text[:1], [text[4]], []):
        c1, p2 = brute_model(train)
        for h in [None, *c1, b"never"]:
            assert sum(p2(h, w) for w in [*c1, b"unknown"]) == pytest.approx(1)


def test_no_rows_and_no_training_rows(spark, empty):
    assert katz.op2_katz_backoff(spark, empty).collect() == []
    df = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    (r,) = katz.scores(df).collect()
    assert tuple(r) == (1, True, 3, 0, 0, 0.0, 0.0)


def test_scores_beat_the_base_on_held_out_texts(spark):
    got = [r for r in katz.op2_katz_backoff(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(got) > 100 and sum(r.score for r in got) > sum(r.base_score for r in got)
