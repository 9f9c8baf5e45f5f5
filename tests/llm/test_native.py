import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from compare import connect, difference

from admeter.llm import kd_shards, merkle, mixing, token_rollup
from admeter.llm.common import boundaries
from pyspark.sql import functions as F

KINDS = ["odd", "sf"]


def nulls_first(x):
    return (x is not None, x)


@pytest.mark.parametrize("kind", KINDS)
def test_fingerprints(spark, folders, kind):
    docs = sorted(
        ((r["doc_id"], r["text"] or "") for r in brute.rows(folders[kind])),
        key=lambda r: (nulls_first(r[0]), r[1].encode()),
    )
    want = []
    for i, (doc_id, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        want.append((doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), text, edit))
    got = merkle.op1_merkle_fingerprints(spark, folders[kind]).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(w[:3] for w in want)
    prints = defaultdict(set)
    by = {(r.doc_id, r.edited_sha256): r for r in got}
    for doc_id, _, sha, text, edit in want:
        r = by[doc_id, sha]
        prints[text].add(r.fingerprint)
        prints[edit].add(r.edited_fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (text == edit) or text != edit
    assert all(len(p) == 1 for p in prints.values())
    assert len({p for x in prints.values() for p in x}) == len(prints)
    if kind == "sf":
        assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)


def test_fingerprints_of_no_rows(spark, empty):
    assert merkle.op1_merkle_fingerprints(spark, empty).collect() == []


def test_fingerprints_of_one_row(spark):
    row = merkle.with_next(spark.createDataFrame([(5, "ab")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row] == [(5, "ab", "ab")]


def test_pieces_line_up_again_after_an_insertion(spark):
    """One character before a long line without sentence marks, or a word within it, changes few pieces."""
    words = [f"word{i}{'aeroplane stone'[i % 15].strip()} x{i}" for i in range(500)]
    line = " ".join(words)
    inner = " ".join([*words[:250], "inserted", *words[250:]])
    rows = [(line, "X" + line), (line, inner), (line, line[: len(line) // 2])]
    df = spark.createDataFrame(rows, "a string, b string")
    near = [r[0] for r in df.select(merkle.likeness(merkle.tree(F.col("a")), merkle.tree(F.col("b")))).collect()]
    assert near[0] > 0.95 and near[1] > 0.95 and 0.5 < near[2] < 0.8


def test_pieces_make_up_the_text_and_edits_are_located(spark):
    lines = [f"Line {i}. It says {i * 7} things, and more of them than fit a piece" for i in range(20)]
    other = list(lines)
    other[3], other[17] = "changed", "also changed"
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    r = df.select(
        merkle.changed_paragraphs(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("x"),
        merkle.changed_paragraphs(merkle.tree(F.col("a")), merkle.tree(F.col("a"))).alias("same"),
        F.array_join(F.regexp_extract_all("a", F.lit(merkle.PIECES), F.lit(0)), "").alias("joined"),
    ).first()
    assert (r.x, r.same) == ([3, 17], [])
    assert r.joined == "\n".join(lines)


@pytest.mark.parametrize("kind", KINDS)
def test_kd_shards(spark, folders, kind):
    docs = brute.rows(folders[kind])
    want = Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs
    )
    got = kd_shards.op3_kd_tree_shards(spark, folders[kind]).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    slots, loads, groups = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        groups[r.text_crc32, r.size].add(r.shard)
    assert set(slots) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    largest = Counter()
    for r in got:
        largest[r.text_crc32, r.size] += r.size
    slack = max(largest.values())
    mean = sum(loads.values()) / 16
    assert max(loads.values()) <= mean + slack


def test_kd_shards_are_even(spark):
    text = F.concat(F.lit("t"), F.repeat(F.lit("ab c"), (F.col("id") % 97).cast("int")), F.col("id").cast("string"))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text"))
    hot = spark.range(1500).select((F.col("id") + 5000).alias("doc_id"), F.lit("one text that is copied").alias("text"))
    got = kd_shards.shard(docs.unionByName(hot)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    mean = sum(r.b for r in got) / 16
    assert len(got) == 16 and max(abs(r.b - mean) for r in got) < 0.02 * mean


def test_kd_shards_of_no_rows(spark, empty):
    assert kd_shards.op3_kd_tree_shards(spark, empty).collect() == []


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed |= {s: 3 * sizes[s] for s in above}


@pytest.mark.parametrize("kind", KINDS)
def test_mixing(spark, folders, kind):
    docs = brute.rows(folders[kind])
    sizes = Counter()
    for r in docs:
        sizes[r["source"]] += len(brute.words(r["text"]))
    target = brute_targets(sizes)
    got = mixing.op5_mixed_blocks(spark, folders[kind]).collect()
    again = mixing.op5_mixed_blocks(spark, folders[kind]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    source = defaultdict(list)
    for r in docs:
        source[r["doc_id"], len(brute.words(r["text"]))].append(r["source"])
    assert Counter((r.doc_id, r.size) for r in got) == Counter({k: len(v) for k, v in source.items()})
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    if kind == "sf":
        taken = Counter()
        for r in got:
            (s,) = source[r.doc_id, r.size]
            assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
            taken[s] += r.taken
        assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    else:
        assert sum(r.taken for r in got) == pytest.approx(sum(target.values()), abs=len(target))


@pytest.mark.parametrize("kind", KINDS)
def test_mixed_blocks(spark, folders, kind):
    """Every slot holds its block's words, and the counts over the shards meet the targets."""
    docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
    streams, of = defaultdict(list), defaultdict(set)
    for r in sorted(brute.rows(folders[kind]), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        streams[r["source"]] += [(w.decode(), r["doc_id"]) for w in brute.words(r["text"])]
        of[r["doc_id"]].update(w.decode() for w in brute.words(r["text"]))
    sizes = {s: len(w) for s, w in streams.items()}
    got = mixing.mixed_blocks(docs).collect()
    shards, seen = defaultdict(Counter), defaultdict(list)
    for r in got:
        words = r.words.split(" ")
        assert len(words) == r.n_words <= mixing.BLOCK and 0 <= r.shard < mixing.OUTPUT_SHARDS
        assert set(words) <= set().union(*[of[d] for d in r.doc_ids])
        if kind == "sf":  # doc_ids are distinct there, so the order of words is fixed
            at = streams[r.source][r.block * mixing.BLOCK :][: r.n_words]
            assert words == [w for w, _ in at]
            assert r.doc_ids == list(dict.fromkeys(d for _, d in at))
        shards[r.source][r.shard] += r.n_words
        seen[r.source].append(r.slot)
    target = brute_targets(sizes)
    for s, want in target.items():
        assert sorted(seen[s]) == list(range(len(seen[s])))
        assert abs(sum(shards[s].values()) - want) <= 1
    if kind == "sf":
        assert len({r.shard for r in got}) > mixing.OUTPUT_SHARDS // 2
        counts = Counter(r.doc_id for r in mixing.op5_mixed_blocks(spark, folders[kind]).collect() if r.taken)
        assert set(counts) == {d for r in got for d in r.doc_ids}


def test_mixing_of_no_rows(spark, empty):
    assert mixing.op5_mixed_blocks(spark, empty).collect() == []


def test_permutations(spark):
    for n in (1, 2, 3, 64, 1000):
        x = mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(0))
        got = [r[0] for r in spark.range(n).select(x).collect()]
        assert sorted(got) == list(range(n))
        assert n < 64 or got != list(range(n))


def test_slots_undo_the_permutation(spark):
    block = mixing.BLOCK
    sources = [(0, 0, 0, 700 * block + 5, 700 * block + 5, 2 * (700 * block + 5) + 300 * block + 9), (1, 0, 0, 10, 10, 25), (2, 0, 0, 0, 0, 0)]
    ranges = spark.createDataFrame(sources, "idx int, part int, start long, s long, source_size long, take long")
    got = mixing.slots(ranges).collect()
    for idx, _, _, _, size, take in sources:
        mine = [r for r in got if r.idx == idx]
        full = size // block
        assert sum(r.n_words for r in mine) == take
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        if mine:
            in_pass = full + (size % block > 0)
            pairs = spark.createDataFrame([(r.slot % in_pass, r["pass"], r.block) for r in mine if r.slot % in_pass < full] or [(0, 0, 0)], "at long, pass long, block long")
            image = mixing.permuted(F.col("at"), F.lit(max(full, 1)), F.lit(idx), F.col("pass"))
            assert pairs.where(image != F.col("block")).count() == 0
            assert all(r.block == full for r in mine if r.slot % in_pass >= full)


def test_rollup_oracle(spark, folders):
    df = token_rollup.op10_token_rollup(spark, folders["sf"])
    assert difference(df, connect(folders["sf"]), token_rollup.OP10_SQL) is None


def test_rollup_on_odd_and_no_rows(spark, odd, empty):
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_rollup.op10_token_rollup(spark, odd).collect()}
    assert got["c", None, "words"] == (1, 4)
    assert got[None, None, "words"] == (2, 11)
    assert token_rollup.op10_token_rollup(spark, empty).collect() == []


def test_rollup_batches_count_once(spark, tmp_path):
    store = token_rollup.Store(spark, str(tmp_path / "r"))
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_n_tokens long"

    def batch(*rows):
        return spark.createDataFrame(list(rows), schema)

    one = batch(("insert", "a", "en", "t1", 5, None), ("insert", "a", "en", "t1", 7, None), ("insert", None, None, "t1", None, None))
    assert store.totals().collect() == []
    assert store.apply("b1", one) and not store.apply("b1", one)
    two = batch(("revise", "a", "en", "t1", 9, 7), ("delete", "a", "en", "t1", None, 5), ("odd", "a", "en", "t1", 1, 1))
    # a crashed batch has no success marker and counts for nothing
    token_rollup.deltas(one).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.root}/delta/b2")
    assert store.apply("b2", two)
    want = {("a", "en", "t1", 1, 9), (None, None, "t1", 1, 0)}
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact()
    store.compact()
    assert not store.apply("b2", two)
    assert {tuple(r) for r in store.totals().collect()} == want
    assert store.apply("b3", batch(("delete", None, None, "t1", None, 0)))
    assert {tuple(r) for r in store.totals().collect()} == {("a", "en", "t1", 1, 9)}


def test_rollup_refuses_ids_that_are_no_folder(spark, tmp_path):
    store = token_rollup.Store(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("insert", "a", "en", "t", 3, None)], "op string, source string, lang string, tokenizer string, n_tokens long, old_n_tokens long")
    for batch in ("a/b", "", "..", "_x", ".x", "a b"):
        with pytest.raises(ValueError):
            store.apply(batch, one)
    for batch in ("2026-01-01", "b_2", "c.3", "d"):
        assert store.apply(batch, one) and not store.apply(batch, one)
        store.compact()
        assert not store.apply(batch, one)
    assert store._committed("base") == ["00000003", "00000004"] and store._committed("delta") == []
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "t", 4, 12)]


def test_ranges(spark):
    assert boundaries(spark.range(0), "id", 4) == []
    assert len(boundaries(spark.range(100), "id", 4)) == 3
