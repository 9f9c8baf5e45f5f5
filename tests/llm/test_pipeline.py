import hashlib
from collections import Counter

import brute
import corpus_pipeline
import pytest
from test_near import brute_classes
from test_native import brute_targets
from tokenizers import Tokenizer

from admeter.llm import bpe, language, quality_rules
from admeter.sources.shared import keep

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize("kind", ["odd", "sf"])
def test_stages_equal_plain_python(spark, folders, kind):
    folder = folders[kind]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in STAGES.items():
        before = docs
        docs = keep(stage(spark, docs, folder), "test")
        kept[name] = (rows_of(before), rows_of(docs), before)
        assert docs.columns == columns or name == "BPE encoding and decoding"

    def key(r):
        return tuple(r[c] for c in columns)

    before, after, df = kept["quality classifier"]
    scored = quality_rules.score(df, quality_rules.train(df, spark.read.parquet(f"{folder}/labels.parquet")))
    if kind == "sf":
        good = {r.doc_id for r in scored.collect() if r.predicted}
        assert Counter(map(key, after)) == Counter(key(r) for r in before if r["doc_id"] in good)
        assert 0.5 * len(before) < len(after) < len(before)

    before, after, df = kept["language ID"]
    names, scores = language.train(df).predict([r["text"] for r in before])
    good = [r for r, n, s in zip(before, names, scores, strict=True) if n != "und" and s >= 0.4]
    assert Counter(map(key, after)) == Counter(map(key, good))

    before, after, _ = kept["MinHash near-dedup"]
    want = brute_classes([(r["doc_id"], r["text"]) for r in before], k=5)
    firsts = {d for d, _, _, k in want if k and d is not None}
    assert Counter(r["doc_id"] for r in after if r["doc_id"] is not None) == Counter(list(firsts))
    assert sum(r["doc_id"] is None for r in after) == sum(r["doc_id"] is None for r in before)

    before, after, _ = kept["mixing sources to target weights"]
    sizes, taken, words = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(brute.words(r["text"]))
        words[r["doc_id"]] += len(brute.words(r["text"]))
    target = brute_targets(sizes) if sizes else {}
    mixed = Counter()
    for r in after:
        taken[r["source"]] += len(brute.words(r["text"]))
        mixed[r["doc_id"]] += len(brute.words(r["text"]))
        assert r["n_chars"] == len(r["text"]) or r["text"] in {b["text"] for b in before}
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert all(n <= 3 * words[d] for d, n in mixed.items())

    before, after, _ = kept["BPE encoding and decoding"]
    reader = Tokenizer.from_file(bpe.default_path())
    ids = Counter((r["doc_id"], tuple(reader.encode(r["text"] or "", add_special_tokens=False).ids)) for r in before)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in after) == ids
    assert all(r["n_tokens"] == len(r["ids"]) for r in after)
    for r in after:
        text = reader.decode(r["ids"], skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run(spark, folders):
    got = corpus_pipeline.run(spark, folders["sf"])
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and got.count() > 100
    assert corpus_pipeline.run(spark, folders["empty"]).collect() == []


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows_reach_every_stage(spark, folders, name):
    docs = spark.read.parquet(f"{folders['odd']}/documents.parquet")
    after = rows_of(STAGES[name](spark, docs, folders["odd"]))
    before = rows_of(docs)
    if name == "BPE encoding and decoding":
        assert len(after) == len(before)
        return
    assert all(list(r) == docs.columns for r in after)
    if name == "quality classifier":  # three usable labels teach no rule
        assert Counter(map(str, after)) == Counter(map(str, before))
    elif name == "language ID":
        assert {r["doc_id"] for r in after} >= {1, 5, 14} and 2 not in {r["doc_id"] for r in after}
    elif name == "MinHash near-dedup":
        assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 14]
        assert sum(r["doc_id"] is None for r in after) == 2
    else:
        sizes = Counter()
        for r in before:
            sizes[r["source"]] += len(brute.words(r["text"]))
        target, taken = brute_targets(sizes), Counter()
        for r in after:
            taken[r["source"]] += len(brute.words(r["text"]))
        assert all(abs(taken[s] - target[s]) <= 1 for s in target)


@pytest.mark.parametrize("labels", [[], [(i, 0, 0) for i in range(30)], [(i, 1, 0) for i in range(100)]])
def test_labels_that_teach_nothing_drop_nothing(spark, folders, tmp_path, labels):
    docs = spark.read.parquet(f"{folders['sf']}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert STAGES["quality classifier"](spark, docs, str(tmp_path)).count() == docs.count()


def test_unlike_texts_of_one_doc_id_both_stay(spark, folders):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (5, b), (9, a + " more"), (3, "something else altogether here today"), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(STAGES["MinHash near-dedup"](spark, docs, folders["sf"]).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(5, a), (5, b), rows[4], (None, a), (None, a)], key=str)
