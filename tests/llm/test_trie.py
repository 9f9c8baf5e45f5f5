"""The conversation trie against plain Python, with rounds of all sizes."""

import hashlib
import math
import random

import pytest
from brute import fold, rows

from admeter.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, k1 string, depth int, n_convs string"


def brute(turns):
    convs = {}
    for r in turns:
        if r["conv_id"] is not None:
            key = (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")
            convs.setdefault(r["conv_id"], []).append(key)
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in convs.items():
        h = fold(c, 9)
        built[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
    members, kids = {}, {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out, leaves, saved = [], {}, {}
    for k in sorted(members, key=len, reverse=True):
        below, own = kids.get(k, []), members[k]
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + ((len(own) - 1) * len(k[-1][1].encode()) if k else 0)
        ends = ",".join(map(str, sorted(c for c in own if len(built[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(own), len(k), parent, len(own), len(below), leaves[k], saved[k], digest))
    return sorted(out, key=str)


def odd_turns():
    """Nulls, ties, repeated rows, a missing first conversation, hot first turns, a long chain."""
    rnd = random.Random(3)
    turns = [
        (0, 0, "user", "hello"), (0, 1, None, "é"), (0, None, "system", None), (0, 1, "a", "tie"), (0, 1, "a", "tie"),
        (None, 0, "user", "no conversation"), (7, None, None, None), (8, 3, "user", ""), (-3, 0, "user", "below zero"),
        (-5, 0, "user", "hello"), (-5, 1, "user", "x" * 5000),
    ]
    for c in range(10, 90):
        for t in range(rnd.randrange(1, 12)):
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", rnd.choice(["same", "same", "other", f"own {c}"])))
    turns += [(200, t, "user", f"step {t}") for t in range(3000)]
    turns += [(200_000_000 + c, t, "user", "copy") for c in range(40) for t in range(9)]
    turns += [(c << 17, t, "user", "copy") for c in range(3000, 3010) for t in range(9)]
    return [r + ("x", 1, None) for r in turns]


@pytest.mark.parametrize("limit", [1, 300, ct.TASK_WEIGHT])
def test_trie_equals_plain_python(spark, limit):
    df = spark.createDataFrame(odd_turns(), SCHEMA)
    want = brute([r.asDict() for r in df.collect()]) if limit > 1 else None
    if limit == 1:  # every cut is a round over the cluster; a small table will do
        df = df.where("conv_id between 10 and 14")
        want = brute([r.asDict() for r in df.collect()])
    assert sorted(map(tuple, ct.trie(df, limit).collect()), key=str) == want


def test_whole_table(spark, folders):
    got = ct.op13_conversation_trie(spark, folders["sf"])
    assert got.columns[:3] == ["conv_id", "depth", "parent_conv_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows(folders["sf"], "conversations"))


def test_no_rows(spark):
    assert ct.trie(spark.createDataFrame([], SCHEMA)).count() == 0
