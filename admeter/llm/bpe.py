"""BPE encoding and decoding by speculation: propose greedily, verify pairs, merge what fails.

A text is cut into words as the tokenizer file states. For a word not seen before, the longest
vocabulary entries from the left are proposed. The proposal is what merging would give if every
entry is what merging gives for its own characters and if no merge could have joined any two
neighbours; the latter is tested for all distinct neighbours of a batch at once on arrays. Only
words that fail go through the exact merges. Words of a batch are encoded once; a bounded cache
per worker keeps their ids and tokens.

Vocabulary and merges come from a tokenizers file given by its path, which every executor must
have (the package is installed there).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admeter.llm.common import table

VOCABULARY = "word_bpe_49k.json"
#: Characters of a text that are handled at a time (cut at a blank), and of a batch of texts.
STRIDE = 1 << 20
#: Words in a worker's cache before it is emptied, and the longest word that it keeps.
CACHE, CACHED_WORD = 500_000, 100
NEVER = np.int64(1) << 40
NO_MERGE = (int(NEVER), -1)
#: Symbols up to which merges look through a list instead of a heap.
SHORT = 64

# The word pattern of the tokenizer file, as it stands there, and for ASCII text in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+"
_WORDS, _ASCII_WORDS = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
_BLANK = re.compile(r"[ \n]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@functools.cache
def _recent() -> regex.Pattern:
    """Characters that one of the installed Unicode tables knows and Python's does not yet.

    The libraries' tables are of different years; such characters are left to the reader of the
    tokenizer file.
    """
    unknown = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    found = regex.findall(r"\P{Cn}+", unknown)
    ranges = "".join(f"{re.escape(x[0])}-{re.escape(x[-1])}" for run in found for x in _runs(run))
    return re.compile(f"[{ranges}]" if ranges else r"(?!)")


def _runs(text: str) -> Iterator[str]:
    """Stretches of code points that follow each other."""
    start = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or ord(text[i]) != ord(text[i - 1]) + 1:
            yield text[start:i]
            start = i


#: An encoded word: ids and tokens as text, number of tokens.
#: A word's ids as decimals joined by blanks, and their number.
Word = tuple[str, int]


class Codec:
    """A vocabulary with its merges. Ids rank merges: a merge's product has the higher id."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*self.vocabulary.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for s, i in (self.vocabulary | self.special).items():
            self.token[i] = s
        self._written = {str(i): t for i, t in enumerate(self.token)}
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            i, j, k = (self.vocabulary[x] for x in (a, b, a + b))
            self.merge[i, j] = (r, k)
            self.left[k], self.right[k], self.rank[k] = i, j, r
        keys = np.array([i << 20 | j for i, j in self.merge], np.int64)
        order = keys.argsort()
        self._pairs = keys[order]
        self._ranks = np.array([r for r, _ in self.merge.values()], np.int64)[order]
        # entries at a word's end, and those inside a word with all their beginnings (-1)
        self._last: dict[str, int] = {}
        self._inner: dict[str, int] = {}
        for t, i in self.vocabulary.items():
            if self._ends(t):
                self._last[t[: len(t) - len(self.suffix)]] = i
            if not self.suffix or not self._ends(t):
                self._inner[t] = i
        for t in list(self._inner):
            for to in range(1, len(t)):
                self._inner.setdefault(t[:to], -1)
        self.longest = max(map(len, self._last))
        self._bytes = byte_characters()
        self._whole: dict[int, bool] = {}
        self._cache: dict[str, Word] = {}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _ends(self, t: str) -> bool:
        return not self.suffix or (t.endswith(self.suffix) and len(t) > len(self.suffix))

    def words_of(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return _ASCII_WORDS.findall(text.lower())
        if _recent().search(text):
            reader = _reader(self.path)
            text = reader.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in reader.pre_tokenizer.pre_tokenize_str(text)]
        # lower case letter by letter: a sigma does not depend on its place
        return _WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def symbols(self, word: str) -> str:
        if word.isascii() and word.isalnum():
            return word
        return "".join(map(self._bytes.__getitem__, word.encode("utf-8", "replace")))

    def propose(self, s: str) -> list[int]:
        """Longest entries from the left; the last one ends the word."""
        out, at, n = [], 0, len(s)
        inner, last = self._inner.get, self._last.get
        while at < n:
            if n - at <= self.longest and (k := last(s[at:])) is not None:
                out.append(k)
                break
            found, to = -1, at
            while to < n - 1 and (k := inner(s[at : to + 1])) is not None:
                to += 1
                if k >= 0:
                    found, end = k, to
            if found < 0:
                raise ValueError(f"no entry for {s[at]!r}")
            out.append(found)
            at = end
        return out

    def merged(self, symbols: list[int]) -> list[int]:
        """Exact merges: always the lowest rank, leftmost first."""
        if len(symbols) > SHORT:
            return self._merged_long(symbols)
        ids, get = list(symbols), self.merge.get
        ranks = [get(p, NO_MERGE) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is NO_MERGE:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], best[1]), NO_MERGE)
            if i + 1 < len(ids):
                ranks[i] = get((best[1], ids[i + 1]), NO_MERGE)
        return ids

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        ids, n = list(symbols), len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*self.merge[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merge]
        heap = [(r, i, k, a, b) for r, k, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, k, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = k, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merge.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def base(self, s: str) -> list[int]:
        """One id per character, the last one with the end of the word."""
        return [self.vocabulary[c] for c in s[:-1]] + [self.vocabulary[s[-1] + self.suffix]]

    def stands(self, k: int) -> bool:
        """Whether merging the characters of an entry gives that entry."""
        if k not in self._whole:
            t = self.token[k]
            ends = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
            chars = t[: -len(self.suffix)] if ends else t
            symbols = self.base(chars) if ends else [self.vocabulary[c] for c in chars]
            self._whole[k] = self.merged(symbols) == [k]
        return self._whole[k]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of entries side by side: no merge joins them across the border.

        The entries are taken apart, last merge first. At each step the two parts at the border
        stand side by side until one of them goes into the merge it was taken from; they would
        have been joined if their own merge ranks lower (on the right also equal: of equal
        merges the left one comes first).
        """
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        used_a, used_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            r = self._rank_of(a, b)
            bad = (r < used_a) & (r <= used_b) & (r < NEVER)
            ok[live[bad]] = False
            go = ~bad & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            live, a, b, used_a, used_b = live[go], a[go], b[go], used_a[go], used_b[go]
            first = self.rank[a] > self.rank[b]
            used_a = np.where(first, self.rank[a], used_a)
            used_b = np.where(first, used_b, self.rank[b])
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: proposals where all neighbours agree, exact merges elsewhere."""
        symbols = [self.symbols(w) for w in words]
        proposals = [self.propose(s) for s in symbols]
        flat = np.array([k for p in proposals for k in p], np.int64)
        owner = np.repeat(np.arange(len(words)), [len(p) for p in proposals])
        failed = np.zeros(len(words), bool)
        entries, where = np.unique(flat, return_inverse=True)
        unfit = np.array([not self.stands(int(k)) for k in entries], bool)
        if len(flat):
            failed[owner[unfit[where]]] = True
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        if len(inner):
            pairs, where = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
            odd = ~self.compatible(pairs >> 20, pairs & 0xFFFFF)
            failed[owner[inner[odd[where]]]] = True
        for i in np.flatnonzero(failed):
            proposals[i] = self.merged(self.base(symbols[i]))
        return proposals

    def _lookup(self, words: list[str]) -> dict[str, Word]:
        """Encoded forms of these words (at least)."""
        if len(self._cache) > CACHE:
            self._cache.clear()
        new = [w for w in dict.fromkeys(words) if w not in self._cache]
        if not new:
            return self._cache
        long_ones = {}
        for w, ids in zip(new, self.encode_words(new), strict=True):
            word = (" ".join(map(str, ids)), len(ids))
            (self._cache if len(w) <= CACHED_WORD else long_ones)[w] = word
        return {**self._cache, **long_ones} if long_ones else self._cache

    def parts(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """Words of a stretch of text, then the special token that ends it (or None).

        Long texts come in stretches that end at a blank, which no word spans.
        """
        at = 0
        while at < len(text):
            end = at + STRIDE
            if end < len(text):
                blank = _BLANK.search(text, end)
                end = blank.end() if blank else len(text)
            stretch = text[at:end]
            at = end
            if self._special is None or not any(s in stretch for s in self.special):
                yield self.words_of(stretch), None
                continue
            pieces = self._special.split(stretch)
            for i in range(0, len(pieces), 2):
                yield self.words_of(pieces[i]), pieces[i + 1] if i + 1 < len(pieces) else None

    def encoded(self, texts: list[str]) -> list[list[tuple[str, int]]]:
        """Per text its stretches as (ids, number), in order; ids are decimals joined by blanks."""
        parts = [list(self.parts(t)) for t in texts]
        known = self._lookup([w for p in parts for words, _ in p for w in words])
        out = []
        for p in parts:
            done = []
            for words, special in p:
                if words:
                    ids, n = zip(*map(known.__getitem__, words), strict=True)
                    done.append((" ".join(ids), sum(n)))
                if special is not None:
                    done.append((str(self.special[special]), 1))
            out.append(done)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file states no decoder: tokens joined by blanks; ids out of range are left out."""
        return " ".join(self.token[i] for i in ids if 0 <= i < len(self.token))

    def decode_written(self, ids: str) -> str:
        """``decode`` for ids as ``encoded`` writes them."""
        return " ".join(map(self._written.__getitem__, ids.split(" ")))


@functools.lru_cache(maxsize=2)
def _reader(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _stretches(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of texts that together have about STRIDE characters."""
    mine, size = [], 0
    for i, t in enumerate(texts):
        mine.append(i)
        size += len(t)
        if size >= STRIDE:
            yield mine
            mine, size = [], 0
    if mine:
        yield mine


def encoded(docs: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """``columns`` of docs, n_tokens, ids (array<int>) and the digest of what the ids decode to.

    A null ``text`` counts as empty.
    Results leave a worker in batches of about STRIDE characters of text.
    """
    at = path or default_path()
    rows = docs.select(*columns, F.col("text").alias("__text"))
    fields = [*rows.drop("__text").schema.fields, T.StructField("n_tokens", T.LongType())]
    ids_field = T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*fields, ids_field, T.StructField("decoded_sha256", T.StringType())])
    names = ["n_tokens", "ids", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(at)
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            for part in _stretches(texts):
                found = c.encoded([texts[i] for i in part])
                ids = [[int(x) for a, _ in done for x in a.split(" ")] for done in found]
                mine = batch.slice(part[0], len(part))
                out = [mine.column(x) for x in columns]
                out += [pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
                back = [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([*out, pa.array(back)], names=[*columns, *names])

    return rows.mapInArrow(run, schema)


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of an array of ids; null stays null."""
    at = path or default_path()

    @F.pandas_udf(T.StringType())
    def run(rows: pd.Series) -> pd.Series:
        c = codec(at)
        return pd.Series([None if r is None else c.decode(list(r)) for r in rows], dtype=object)

    return run(ids)


def digests(text: Column, path: str | None = None) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of a text column; null counts as empty.

    Texts become ids, written as decimals, and the text is decoded from these, stretch by stretch, so
    that arrays of ids need not travel; ``encoded`` and ``decoded`` give them.
    """
    at = path or default_path()
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]

    @F.pandas_udf(T.StructType([T.StructField(*f) for f in fields]))
    def run(texts: pd.Series) -> pd.DataFrame:
        c, values, rows = codec(at), [t or "" for t in texts], []
        for part in _stretches(values):
            for done in c.encoded([values[i] for i in part]):
                ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
                for k, (a, m) in enumerate(done):
                    ids.update((" " + a if k else a).encode())
                    text = c.decode_written(a)
                    back.update((" " + text if k else text).encode())
                    n += m
                rows.append((n, ids.hexdigest(), back.hexdigest()))
        return pd.DataFrame(rows, columns=[f[0] for f in fields])

    return run(text)


def op9_speculative_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", digests(F.col("text")).alias("d")).select("doc_id", "d.*")
