import itertools
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pandas as pd
import pytest

from admeter.llm import near_text, near_vectors
from admeter.llm.components import components
from admeter.llm.tiles import runs
from pyspark.sql import functions as F

KINDS = ["odd", "empty", "sf"]


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(docs, k=4, similarity=80):
    sets = [(d, sets_of(t, k)) for d, t in docs]
    first = defaultdict(list)
    links = []
    for i, (d, s) in enumerate(sets):
        shared = Counter(j for x in s for j in first[x])
        for j, both in shared.items():
            if 100 * both >= similarity * len(s | sets[j][1]) and None not in (d, sets[j][0]):
                links.append((d, sets[j][0]))
        for x in s:
            first[x].append(i)
    part = roots({d for d, _ in sets if d is not None}, links)
    return Counter((d, len(s), part.get(d), d is None or part[d] == d) for d, s in sets)


@pytest.mark.parametrize("kind", KINDS)
def test_classes_equal_brute_force(spark, folders, kind):
    docs = [(r["doc_id"], r["text"]) for r in brute.rows(folders[kind])]
    got = near_text.op8_minhash_hamming(spark, folders[kind]).collect()
    assert Counter(map(tuple, got)) == brute_classes(docs)


@pytest.mark.parametrize("tile", [6, 600])
def test_groups_of_near_copies(spark, monkeypatch, tile):
    """Chains and stars of copies, in one tile and in many."""
    monkeypatch.setattr(near_text, "TILE", tile)
    monkeypatch.setattr(near_text, "BUCKET_TILE", tile)
    rng = random.Random(2)
    docs, n = [], itertools.count(100)
    for _ in range(4):
        base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9999)}"
            docs.append((next(n), " ".join(copy)))
        for _ in range(12):  # a chain drifts away from its start
            base[rng.randrange(len(base))] = f"y{rng.randint(0, 9999)}"
            docs.append((next(n), " ".join(base)))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter(map(tuple, near_text.classes(df, words=4).collect()))
    assert got == brute_classes(docs)
    assert len({r[2] for r in got}) < len(docs) // 2


def test_every_text_of_a_doc_id_finds_its_near_copies(spark):
    """One doc_id on two to four texts, each with a near copy of its own."""
    rng = random.Random(6)
    docs, copies = [], itertools.count(100)
    for doc_id in range(12):
        for _ in range(2 + doc_id % 3):
            base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
            docs.append((doc_id, " ".join(base)))
            base[rng.randrange(120)] = "x"
            docs.append((next(copies), " ".join(base)))
    # texts of one doc_id also connect classes of smaller ids, all of them
    docs += [(500, docs[i][1] + " end") for i in (0, 4, 10)] + [(500, None)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter(map(tuple, near_text.classes(df, words=4).collect()))
    assert got == brute_classes(docs)
    assert all(not kept for d, _, _, kept in got if d >= 100)


def test_keys_find_every_pair_within_the_distance(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        a = [rng.randrange(65536) for _ in range(near_text.POSITIONS)]
        b = list(a)
        for i in rng.sample(range(near_text.POSITIONS), near_text.DISTANCE):
            b[i] ^= 1 + rng.randrange(65535)
        rows.append(tuple(bytearray(b"".join(v.to_bytes(2, "little") for v in x)) for x in (a, b)))
    df = spark.createDataFrame(rows, "a binary, b binary")
    met = F.arrays_overlap(near_text.chunk_keys(F.col("a")), near_text.chunk_keys(F.col("b")))
    got = df.select(met.alias("met"), near_text.distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert {tuple(r) for r in got} == {(True, near_text.DISTANCE)}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)]
    links += [(2000, i) for i in range(1900, 1990)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == roots({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_intersections(monkeypatch):
    monkeypatch.setattr(near_text, "MATRIX", 7)
    rng = random.Random(5)
    for m in (2, 3, 9, 30):
        sets = [np.array(sorted({rng.randrange(60) for _ in range(rng.randint(1, 40))}), np.uint64) for _ in range(m)]
        got = near_text.intersections(sets)
        assert [[len(set(a) & set(b)) for b in sets] for a in sets] == got.tolist()


def test_runs_cross_batches():
    frames = [pd.DataFrame({"k": k, "v": range(len(k))}) for k in ([1, 1, 2], [], [2], [2, 3, 3], [3], [4])]
    assert [list(g["k"]) for g in runs(iter(frames), ["k"])] == [[1, 1], [2, 2, 2], [3, 3, 3], [4]]
    assert list(runs(iter([]), ["k"])) == []


def brute_vectors(rows, cosine=0.93):
    by = {}
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is None:
            continue
        by.setdefault(r["vec_id"], None)
        if r["label"] is None or not v or None in v or not np.isfinite(v).all() or not np.linalg.norm(v):
            continue
        by[r["vec_id"]] = (r["label"], np.array(v, np.float64))
    fit = {i: x for i, x in by.items() if x}
    links = [
        (i, j)
        for i, j in itertools.combinations(fit, 2)
        if fit[i][0] == fit[j][0] and len(fit[i][1]) == len(fit[j][1])
        and fit[i][1] @ fit[j][1] / (np.linalg.norm(fit[i][1]) * np.linalg.norm(fit[j][1])) >= cosine
    ]
    count = Counter(x for p in links for x in p)
    part = roots(by, links)
    return Counter((i, count[i], part[i], part[i] == i) for i in by), links


@pytest.mark.parametrize("kind", KINDS)
def test_vectors_equal_brute_force(spark, folders, kind):
    got = near_vectors.op6_subspace_join(spark, folders[kind]).collect()
    want, links = brute_vectors(brute.rows(folders[kind], "embeddings"))
    assert Counter(map(tuple, got)) == want
    assert links or kind != "odd"


@pytest.mark.parametrize("tile", [7, 2000])
@pytest.mark.parametrize("dim", [1, 3, 10, 64])
def test_groups_of_near_vectors(spark, monkeypatch, tile, dim):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    rng = np.random.default_rng(dim)
    rows = []
    for k in range(12):
        base = rng.normal(size=dim)
        for s in np.linspace(0.01, 0.5, 8):
            v = base + rng.normal(size=dim) * s * np.linalg.norm(base) / dim**0.5
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], k % 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = Counter(map(tuple, near_vectors.near_vectors(df).collect()))
    want, _ = brute_vectors([dict(zip(("vec_id", "embedding", "label"), r, strict=True)) for r in rows])
    assert got == want


def test_many_copies_of_one_vector(spark, monkeypatch):
    """A third of all rows is one vector: its copies cost a few vectors, and all count."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=16).astype(np.float32)
    near = [(base + rng.normal(size=16) * 0.05).astype(np.float32) for _ in range(40)]
    rows = [(i, [float(v) for v in base], i % 2) for i in range(50_000)]
    rows += [(50_000 + i, [float(x) for x in v], 1) for i, v in enumerate(near * 2)]
    seen = []
    pairs = near_vectors.distinct_vectors
    monkeypatch.setattr(near_vectors, "distinct_vectors", lambda fit: seen.append(pairs(fit)) or seen[-1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = near_vectors.near_vectors(df).groupBy("n_links", "component_id").count().collect()
    assert seen[0].count() <= 2 * near_vectors.SHARES + len(near) * 2
    # 25,000 copies of label 0 have only each other
    assert Counter({(r.n_links, r.component_id): r["count"] for r in got})[24_999, 0] == 25_000
    few = [r for r in rows if r[2] and (r[0] < 10 or r[0] >= 50_000)]
    want, _ = brute_vectors([dict(zip(("vec_id", "embedding", "label"), r, strict=True)) for r in few])
    more = 25_000 - 5  # copies that the brute force was spared
    whole = Counter()
    for i, n, part, _ in want:
        links_to_base = i < 50_000 or np.float64(rows[i][1]) @ np.float64(base) >= 0.93 * np.linalg.norm(
            np.float64(rows[i][1])) * np.linalg.norm(np.float64(base))
        whole[n + more * bool(links_to_base), part] += 25_000 // 5 if i < 50_000 else 1
    assert {(r.n_links, r.component_id): r["count"] for r in got if r.component_id} == whole


def test_double_components_are_compared_as_doubles(spark):
    """Vectors on either side of the threshold that are one in single precision."""
    angle = np.arccos(0.93)
    rows = [(0, [1.0, 0.0], 0)] + [(k, [float(np.cos(angle + d)), float(np.sin(angle + d))], 0) for k, d in ((1, -1e-11), (2, 1e-11))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, links = brute_vectors([dict(zip(("vec_id", "embedding", "label"), r, strict=True)) for r in rows])
    assert (0, 1) in links and (0, 2) not in links
    assert Counter(map(tuple, near_vectors.near_vectors(df).collect())) == want


def test_large_doc_ids_keep_their_digits_beside_null(spark):
    """Numbers above 2^53 in a batch with a row that has none."""
    big = 2**62 + 1
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(big, text), (big + 2, text), (None, text), (7, "other words that stand alone here")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_text.classes(df.coalesce(1)).collect()}
    assert got == {(big, big, True), (big + 2, big, False), (None, None, True), (7, 7, True)}
