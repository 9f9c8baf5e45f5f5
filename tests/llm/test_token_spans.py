"""Token alignment against both libraries on whole texts, in plain Python."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from brute import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from admeter.llm import token_spans as ts

A = Tokenizer.from_file(ts.path_of(ts.FILE_A))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=ts.path_of(ts.FILE_B))
BYTE = ts.byte_level()
BYTES_A = {i: bytes(BYTE[c] for c in p) for p, i in A.get_vocab(with_added_tokens=False).items()}


def byte_of_b(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def plain(text):
    """(a ids, b ids, groups, links) of one whole text; None without tokens."""
    if not text:
        return None
    data = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    parts = [BYTES_A[i] for i in a], [byte_of_b(i) for i in b]
    if any(b"".join(x) != data for x in parts):
        return None
    ends = []
    for x in parts:
        n, e = 0, []
        for y in x:
            n += len(y)
            e.append(n)
        ends.append(e)
    where_b = {e: j for j, e in enumerate(ends[1])}
    groups, links, i0, j0 = [], [], 0, 0
    for i, e in enumerate(ends[0]):
        if e in where_b:
            j = where_b[e]
            links.append((a[i], b[j]))
            groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
    return a, b, groups, links


def brute(docs):
    found = [(r["doc_id"], plain(r["text"])) for r in docs]
    counts = Counter(link for _, f in found if f for link in f[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, f in found:
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        best = sum(counts[x] == most[x[1]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("name", ["odd", "empty", "sf"])
def test_whole_tables(spark, folders, name):
    assert result(ts.op12_token_spans(spark, folders[name])) == brute(rows(folders[name]))


TEXTS = [
    "a\n\nb\n c \n", "  two  blanks ", "\ttab and wide", "▁ blank piece", "nul \x00 here", "東京 🙂🙂 x́ é\ne",
    "don't we'll <s> </s> <unk> <0x41> <|endoftext|>", "\x1c \x1d\x85 x", " ", "\n", "x\ny", "龘靐 齉‍  z", "\r\n a",
    "word " * 3000, "nospaceatall" * 3000, "é" * 5000, "\U000e0001 tag", "a ᠎ b᠎\nc",
]


def test_odd_texts_and_small_batches(spark, monkeypatch):
    docs = [{"doc_id": i, "text": t} for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string").coalesce(1)
    assert result(ts.aligned(df)) == brute(docs)


def test_parts_of_long_texts(monkeypatch):
    for name, value in (("STRETCH", 50), ("BATCH", 120), ("KNOWN", 7)):
        monkeypatch.setattr(ts, name, value)
    batches = ts.Batches(ts.Spans(ts.path_of(ts.FILE_A), ts.path_of(ts.FILE_B)))
    texts = [t for t in TEXTS if len(t) < 20_000] + ["a fine long text with many words in it " * 40, "bad ▁ one " * 30]
    batches.documents([str(i) for i in range(len(texts))], texts)
    batches.close()
    for i, t in enumerate(texts):
        mine = [r for r in batches.out if r["doc_id"] == i]
        f = plain(t)
        want = [len(x) for x in f] if f else [0] * 4
        assert [sum(r[c] for r in mine) for c in COLUMNS[1:5]] == want
        digest = hashlib.sha256(";".join(f[2]).encode()).hexdigest() if f else ""
        assert max(r["groups_sha256"] or "" for r in mine) == digest
    counted = Counter()
    for r in batches.out:
        if r["kind"] == 0:
            counted.update(dict(zip(r["pairs"].tolist(), r["counts"].tolist(), strict=True)))
    assert counted == Counter(a * ts.PAIR + b for t in texts if (f := plain(t)) for a, b in f[3])


SPANS = ts.Spans(ts.path_of(ts.FILE_A), ts.path_of(ts.FILE_B))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab'st1. \n\t▁é東🙂́ \x85龘-")), min_size=1, max_size=40))
def test_segments_hold_the_tokens_of_the_text(text):
    codes = SPANS.codes([" " + text])[0]
    f = plain(text)
    if f is None:
        assert min(SPANS.n_a[c] for c in codes) < 0
    else:
        assert ";".join(SPANS.groups[c] for c in codes) == ";".join(f[2])
        assert sum(SPANS.n_a[c] for c in codes) == len(f[0])
