import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

from admeter.llm import bpe, language, quality_rules
from pyspark.sql import functions as F

KINDS = ["odd", "sf"]


@pytest.fixture(scope="module")
def reader():
    return Tokenizer.from_file(bpe.default_path())


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in brute.rows(folder)}
    got = language.op4_language_id(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(truth))
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if brute.fold(i, 3) == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_and_no_rows(spark, odd, empty):
    got = language.op4_language_id(spark, odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r["doc_id"] for r in brute.rows(odd))
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 7))
    assert by[1].lang_pred in {"en", "fr", "de", "es", "xx"}
    assert language.op4_language_id(spark, empty).collect() == []


def test_labels_do_not_reach_a_prediction(spark):
    docs = spark.createDataFrame(
        [(i, t, lang) for i in range(60) for t, lang in ((f"the house is {i} big", "en"), (f"das Haus ist {i} groß", "de"))],
        "doc_id long, text string, lang string",
    )
    model = language.train(docs)
    other = docs.withColumn("lang", F.lit("fr"))
    for df in (docs, other):
        rows = df.select("text", language.prediction(model).alias("p")).collect()
        assert all(r.p.lang_pred == ("en" if "house" in r.text else "de") for r in rows)


def test_one_language_only(spark):
    docs = spark.createDataFrame([(i, f"word {i}", "en") for i in range(9)], "doc_id long, text string, lang string")
    got = docs.select(language.prediction(language.train(docs)).alias("p")).collect()
    assert {(r.p.lang_pred, r.p.score) for r in got} == {("en", 1.0)}


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in brute.rows(folder, "labels")}
    got = quality_rules.op7_quality_rules(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(r["doc_id"] for r in brute.rows(folder))
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_rules_as_columns_equal_rules_on_arrays(spark):
    rng = np.random.default_rng(3)
    texts = ["word " * rng.integers(1, 40) + "!" * rng.integers(0, 9) + "A" * rng.integers(0, 30) for _ in range(400)]
    x = quality_rules.statistics([t.encode() for t in texts])
    y = (np.array([t.count("!") for t in texts]) < 4).astype(float)
    model = quality_rules.fit(x, y)
    assert 0 < len(model.rules) < 100
    total = np.full(len(x), model.base)
    for r in model.rules:
        held = np.ones(len(x), bool)
        for name, upper, value in r.bounds:
            c = x[:, quality_rules.STATS.index(name)]
            held &= (c <= value) if upper else (c > value)
        total += r.weight * held
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_rules.score(df, model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], 1 / (1 + np.exp(-total)))
    assert np.mean([(got[i] >= 0.5) == y[i] for i in range(len(texts))]) > 0.98


def test_quality_of_odd_and_no_rows(spark, odd, empty):
    got = quality_rules.op7_quality_rules(spark, odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r["doc_id"] for r in brute.rows(odd))
    assert all(0 <= r.score <= 1 for r in got)
    assert quality_rules.op7_quality_rules(spark, empty).collect() == []


def odd_texts():
    rng = random.Random(5)
    letters = [chr(c) for c in (*range(1, 0x250), *range(0x300, 0x600), 0x2028, 0x85, 0x3000, 0x1C, 0x200B, 0x1F642)]
    letters += list("東京각가İΣẞᲉꟋ՘")
    return [
        "", " ", "it's we'll I'VE don't", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> c", "</w> <w>",
        "ΑΣ İstanbul ΣΣ", "x" * 3000, "ab" * 2000 + " z", "\x1c a\x1fb", *["a" * i for i in range(9)],
        *["!" * i for i in range(20)], *["the" * i for i in range(9)],
        *["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1500)],
        *["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 80))) for _ in range(3000)],
    ]


def test_encoding_equals_the_library(reader):
    c, texts = bpe.Codec(bpe.default_path()), odd_texts()
    for text, done in zip(texts, c.encoded(texts), strict=True):
        want = reader.encode(text, add_special_tokens=False)
        ids = [int(x) for a, _ in done for x in a.split(" ")]
        assert ids == want.ids, text
        assert " ".join(c.decode_written(a) for a, _ in done) == reader.decode(want.ids, skip_special_tokens=False)
        assert c.decode(ids) == reader.decode(want.ids, skip_special_tokens=False)


def test_proposals_that_stand_need_no_merges():
    c, rng = bpe.Codec(bpe.default_path()), random.Random(6)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, 90))) for _ in range(3000)]
    exact = [c.merged(c.base(w)) for w in words]
    assert c.encode_words(words) == exact
    assert [c._merged_long(c.base(w)) for w in words] == exact
    proposed = [c.propose(w) for w in words]
    assert 0 < sum(p == e for p, e in zip(proposed, exact, strict=True)) < len(words)


def test_long_texts_are_cut_at_blanks(monkeypatch, reader):
    monkeypatch.setattr(bpe, "STRIDE", 50)
    text = "don't stop\nthe <|endoftext|> music " * 30 + "unbroken" * 20
    (done,) = bpe.Codec(bpe.default_path()).encoded([text])
    assert len(done) > 30
    assert [int(x) for a, _ in done for x in a.split(" ")] == reader.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", KINDS)
def test_digests(spark, folders, reader, kind):
    want = Counter()
    for r in brute.rows(folders[kind]):
        ids = reader.encode(r["text"] or "", add_special_tokens=False).ids
        back = reader.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), back)]
        want[r["doc_id"], len(ids), *sha] += 1
    got = bpe.op9_speculative_bpe(spark, folders[kind])
    assert Counter(map(tuple, got.collect())) == want


def test_ids_and_texts_as_columns(spark, empty, reader):
    assert bpe.op9_speculative_bpe(spark, empty).collect() == []
    df = spark.createDataFrame([("The cat's <|endoftext|>",), (None,), ("",)], "text string")
    rows = bpe.encoded(df, ["text"]).withColumn("back", bpe.decoded(F.col("ids"))).collect()
    for r in rows:
        assert r.ids == reader.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.back == reader.decode(r.ids, skip_special_tokens=False)


def test_copies_take_nothing_from_the_sample(spark):
    """Three thousand rows of five texts are five texts, and all of them are learned from."""
    rows = [(i, f"texte numéro {i % 5} en français avec des mots", "fr") for i in range(3000)]
    rows += [(10_000 + i, f"english text number {i} with some words in it", "en") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = {r["lang"]: r["count"] for r in language.sample(docs).groupBy("lang").count().collect()}
    assert picked["fr"] == 5 and 900 < picked["en"] <= 1500
