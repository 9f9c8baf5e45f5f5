"""Language-model scores by Katz backoff over word bigrams.

Counts are discounted by Good-Turing (counts above CUT stay; where counts of counts do not give a
discount between 0 and 1, half a count is taken off). What a context loses goes to the words that
never followed it, in proportion to their own probability: p(w | h) = d(c) c / total(h) for seen
pairs and backoff(h) p(w) for others, with backoff(h) = (1 - seen mass) / (1 - sum of p(w) over
seen w). So every context's probabilities add up to 1 over the training words and one unknown.
p(w) is discounted in the same way; its lost mass is the unknown's.

How it runs. Texts become batches of word numbers, written once. Each batch asks about
its words, dealt by word, and learns their ids and counts. Each batch sends its distinct word
pairs, packed by context, to the partition of the context; a context that is frequent is spread
over as many partitions as its share asks for. A partition adds up counts, counts of counts and
what the backoff weights need, and answers every batch in the order it was asked. Batches then score
their texts. Words are known by 64-bit hashes. Tables are partitioned by word, context and
batch; the driver gets sums, and the parts of the few contexts that were spread (at most twice
the partitions).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admeter.llm.common import fold, partitions, table
from admeter.llm.tiles import held_batches, runs
from admeter.llm.words import word_hashes
from admeter.sources.shared import keep

#: Good-Turing discounts apply up to this count.
CUT = 5
#: Bytes of text in a batch.
STRIDE = 6 << 20
#: The end of a text, a token; no word is empty. The start of a text is a context only.
END = np.uint64(0)
START_ID = -1


def _packed(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def _unpacked(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


def _planes(a: np.ndarray) -> list[np.ndarray]:
    """The four bytes of each number, as four arrays."""
    return list(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy())


def _whole(planes: list[np.ndarray]) -> np.ndarray:
    return np.stack(planes, 1).view("<u4").ravel().astype(np.int32)


def _deltas(sorted_ids: np.ndarray) -> np.ndarray:
    return np.diff(sorted_ids, prepend=np.int64(START_ID))


def batched(docs: DataFrame, parts: int) -> DataFrame:
    """batch, payload (documents, parts of the words, tokens as numbers of words), words (hashes, counts)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pd.DataFrame:
            ids, held, texts = zip(*rows, strict=True)
            lens = np.array(list(map(len, texts)), np.int64)
            vocabulary, tokens = np.unique(np.concatenate(texts), return_inverse=True)
            train = ~np.repeat(np.array(held, bool), lens)
            # frequent words get small numbers, which pack well
            order = np.argsort(-np.bincount(tokens, minlength=len(vocabulary)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            n = np.bincount(tokens[train], minlength=len(vocabulary))[order]
            vocabulary = vocabulary[order]
            part = _narrow(_word_part(vocabulary, parts))
            data = _packed(list(ids), np.array(held, bool), _narrow(lens), part, _planes(rank[tokens]))
            return pd.DataFrame(
                {"batch": [number], "payload": [data], "words": [_packed(vocabulary, _narrow(n))]}
            )

        for pdf in frames:
            for doc_id, held, text in zip(pdf["doc_id"], pdf["held_out"], pdf["text"], strict=True):
                hashes = np.append(word_hashes(text or b""), END)
                rows.append((None if pd.isna(doc_id) else int(doc_id), held, hashes))
                size += len(text or b"") + 8
                if size >= STRIDE:
                    yield row()
                    number, rows, size = number + 1, [], 0
        if rows:
            yield row()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("binary").alias("text")
    )
    with held_batches(docs, 1000):
        return keep(rows.mapInPandas(run, "batch long, payload binary, words binary"), "katz-batches")


def _by_part(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order by part, and for each part its stretch of that order."""
    order = np.argsort(part, kind="stable")
    numbers, length = _run_lengths(part[order])
    ends = np.cumsum(length)
    return order, [(int(k), slice(int(e - n), int(e))) for k, e, n in zip(numbers, ends, length, strict=True)]


def _word_part(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def numbered(batches: DataFrame, parts: int) -> DataFrame:
    """batch, part, payload: ranks within the part and training counts of a batch's words there.

    Rows without batch hold a part's totals. A word's id is its part and its rank in it.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for batch, data in zip(pdf["batch"], pdf["words"], strict=True):
                vocabulary, n = _unpacked(data)
                order, stretches = _by_part(_word_part(vocabulary, parts))
                rows = [(k, batch, _packed(vocabulary[order[s]], n[order[s]])) for k, s in stretches]
                yield pd.DataFrame(rows, columns=["part", "batch", "payload"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(frames, ["part"]):
            part, asks = int(g["part"][0]), [_unpacked(x) for x in g["payload"]]
            words, at = np.unique(np.concatenate([w for w, _ in asks]), return_inverse=True)
            c = np.bincount(at, np.concatenate([n for _, n in asks]), minlength=len(words)).astype(np.int64)
            of_counts = np.bincount(np.minimum(c, CUT + 2), minlength=CUT + 3)
            out = [(None, part, _packed(int(c.sum()), of_counts))]
            ends = np.cumsum([len(w) for w, _ in asks])
            for batch, end, (w, _) in zip(g["batch"], ends, asks, strict=True):
                mine = at[end - len(w) : end]
                out.append((int(batch), part, _packed(_narrow(mine), _narrow(c[mine]))))
            yield pd.DataFrame(out, columns=["batch", "part", "payload"]).astype({"batch": "Int64"})

    with held_batches(batches, 16):
        rows = batches.select("batch", "words").mapInPandas(ask, "part int, batch long, payload binary")
        rows = rows.repartition(parts, "part").sortWithinPartitions("part", "batch")
        return keep(rows.mapInPandas(count, "batch long, part int, payload binary"), "katz-words")


def discounts(n: list[int]) -> np.ndarray:
    """d(0) .. d(CUT) from counts of counts n[1] .. n[CUT + 1]; d(0) is unused."""
    d = np.ones(CUT + 1)
    gone = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        x = -1.0
        if gone < 1 and n[r]:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - gone) / (1 - gone)
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


@dataclass(frozen=True)
class Unigrams:
    """Totals of the training words and their discounted probabilities."""

    n: int
    v: int
    d: np.ndarray
    total: float
    unknown: float

    @classmethod
    def of(cls, words: DataFrame) -> Unigrams:
        n, of_counts = 0, np.zeros(CUT + 3, np.int64)
        for r in words.where("batch is null").select("payload").toLocalIterator():
            tokens, some = _unpacked(r["payload"])
            n, of_counts = n + tokens, of_counts + some
        counts = of_counts.tolist()
        d = discounts(counts)
        kept = n - sum((1 - d[r]) * r * counts[r] for r in range(1, CUT + 1))
        total = float(n) if kept < n else n + 1.0
        return cls(n, sum(counts[1:]), d, total, 1 - kept / total if n else 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        seen = c * np.where(c <= CUT, self.d[np.minimum(c, CUT)], 1.0) / self.total
        return np.where(c > 0, seen, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


class Batch:
    """A batch with its words' ids and counts, and its distinct pairs in the order they are sent."""

    def __init__(self, data: bytes, words: pd.DataFrame, n: int, parts: int):
        self.doc_ids, self.held, lens, word_part, planes = _unpacked(data)
        self.lens, self.tokens = lens.astype(np.int64), _whole(planes)
        told = dict(zip(words["part"], words["payload"], strict=True))
        self.ids, self.c = np.empty((2, len(word_part)), np.int64)
        order, stretches = _by_part(word_part)
        for k, s in stretches:
            rank, c = _unpacked(told[k])
            self.ids[order[s]], self.c[order[s]] = (k << 33) + rank.astype(np.int64), c
        starts = np.cumsum(self.lens) - self.lens
        size = len(self.ids)
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[starts] = size  # the start of a text as a context
        ids = np.append(self.ids, START_ID)
        # the start stands before as many texts as there are ends; ends are last in a text
        often = np.append(self.c, self.c[self.tokens[starts + self.lens - 1][0]] if len(starts) else 0)
        pairs, self.which = np.unique(before * size + self.tokens, return_inverse=True)
        h, w = (pairs // size).astype(np.int32), (pairs % size).astype(np.int32)
        del before, pairs
        train = ~np.repeat(self.held, self.lens)
        count = np.bincount(self.which[train], minlength=len(h)).astype(np.int32)
        self.which = self.which.astype(np.int32)
        spread = np.maximum(1, -(-often * parts // max(n, 1)))
        salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
        home = (ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)
        part = ((home[h] + salt[w] % spread[h]) % parts).astype(np.int32)
        # by part, then context id, then word id
        self.order = np.lexsort((ids[w], ids[h], part))
        self.part, self.h, self.w = part[self.order], ids[h[self.order]], w[self.order]
        self.count, self.spread = count[self.order], spread[h[self.order]] > 1

    def blocks(self) -> Iterator[tuple[int, slice]]:
        cuts = np.flatnonzero(np.diff(self.part)) + 1
        edges = [0, *cuts.tolist(), len(self.part)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield int(self.part[a]), slice(a, b)


def asked(batches: DataFrame, words: DataFrame, n: int, parts: int) -> DataFrame:
    """part, batch, payload: the pairs each batch asks a partition about."""

    def run(packed: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, data in zip(packed["batch"], packed["payload"], strict=True):
            b = Batch(data, mine, n, parts)
            for part, s in b.blocks():
                contexts, length = _run_lengths(b.h[s])
                local, at = np.unique(b.w[s], return_inverse=True)
                order = np.argsort(b.ids[local])
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                spread = b.spread[s][np.cumsum(length) - length]
                data = _packed(
                    _narrow(_deltas(contexts)), _narrow(length), np.packbits(spread),
                    _narrow(_deltas(b.ids[local][order])), _narrow(b.c[local][order]),
                    _narrow(place[at]), _narrow(b.count[s]),
                )
                out.append((part, number, data))
        return pd.DataFrame(out, columns=["part", "batch", "payload"])

    packed = batches.select("batch", "payload")
    both = packed.groupBy("batch").cogroup(words.where("batch is not null").groupBy("batch"))
    return both.applyInPandas(run, "part int, batch long, payload binary")


def _run_lengths(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    return a[starts], np.diff(np.append(starts, len(a)))


def answered(blocks: DataFrame, words: Unigrams, parts: int) -> DataFrame:
    """batch, part, payload: the answers; rows without batch hold a partition's own sums."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(frames, ["part"]):
            part, asks = int(g["part"][0]), [_unpacked(x) for x in g["payload"]]
            contexts = [np.cumsum(a[0].astype(np.int64)) + START_ID for a in asks]
            ids = [np.cumsum(a[3].astype(np.int64)) + START_ID for a in asks]
            all_h, h_at = np.unique(np.concatenate(contexts), return_inverse=True)
            all_w, w_at = np.unique(np.concatenate(ids), return_inverse=True)
            c = np.zeros(len(all_w), np.int64)
            c[w_at] = np.concatenate([a[4] for a in asks])
            h_from = np.cumsum([0, *map(len, contexts)])
            w_from = np.cumsum([0, *map(len, ids)])
            pair_h = np.concatenate([np.repeat(h_at[h_from[i] : h_from[i + 1]], a[1]) for i, a in enumerate(asks)])
            pair_w = np.concatenate([w_at[w_from[i] : w_from[i + 1]][a[5]] for i, a in enumerate(asks)])
            pairs, at = np.unique(pair_h * len(all_w) + pair_w, return_inverse=True)
            count = np.bincount(at, np.concatenate([a[6] for a in asks]), minlength=len(pairs)).astype(np.int64)
            sums = _context_sums(pairs // len(all_w), pairs % len(all_w), count, words.p(c), len(all_h))
            spread = np.zeros(len(all_h), bool)
            for i, a in enumerate(asks):
                spread[h_at[h_from[i] : h_from[i + 1]]] |= np.unpackbits(a[2], count=len(contexts[i])).astype(bool)
            of_counts = np.bincount(np.minimum(count, CUT + 2), minlength=CUT + 3)[: CUT + 2]
            out = [(None, part, _packed(of_counts, all_h[spread], sums[spread]))]
            ends = np.cumsum([len(a[5]) for a in asks])
            for i, (batch, a) in enumerate(zip(g["batch"], asks, strict=True)):
                mine = count[at[ends[i] - len(a[5]) : ends[i]]]
                known = sums[h_at[h_from[i] : h_from[i + 1]]]
                out.append((int(batch), part, _packed(_narrow(mine), [_narrow(x) for x in known[:, :-1].T.astype(np.int64)], known[:, -1])))
            yield pd.DataFrame(out, columns=["batch", "part", "payload"]).astype({"batch": "Int64"})

    dealt = blocks.repartition(parts, "part").sortWithinPartitions("part", "batch")
    with held_batches(blocks, 16):
        return keep(dealt.mapInPandas(run, "batch long, part int, payload binary"), "katz-answers")


def _context_sums(h: np.ndarray, w: np.ndarray, count: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Per context: number of words with each count up to CUT, sum of larger counts, sum of p."""
    seen = count > 0
    h, w, count = h[seen], w[seen], count[seen]
    columns = [np.bincount(h[count == r], minlength=n) for r in range(1, CUT + 1)]
    columns.append(np.bincount(h, np.where(count > CUT, count, 0), minlength=n))
    columns.append(np.bincount(h, p[w], minlength=n))
    return np.stack(columns, 1).astype(np.float64)


def backoff(sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context the total that counts are divided by, and the weight of words not seen there."""
    r = np.arange(1, CUT + 1)
    total = sums[:, :CUT] @ r + sums[:, CUT]
    mass = sums[:, :CUT] @ (r * d[1:]) + sums[:, CUT]
    rest = 1 - sums[:, CUT + 1]
    none_left = rest <= 1e-12  # every word was seen here
    divisor = np.where(none_left, mass, np.where(mass < total, total, total + 1))
    divisor = np.where(total > 0, divisor, 1.0)
    weight = np.where(none_left, 0.0, (1 - mass / divisor) / np.where(none_left, 1.0, rest))
    return divisor, np.where(total > 0, weight, 1.0)


@dataclass(frozen=True)
class Scores:
    """What scoring needs besides a batch and its answers."""

    words: Unigrams
    d: np.ndarray
    spread: dict[int, np.ndarray]
    parts: int

    def rows(self, data: bytes, words: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = Batch(data, words, self.words.n, self.parts)
        answer = dict(zip(answers["part"], answers["payload"], strict=True))
        logs = np.zeros(len(b.part))
        p = self.words.p(b.c)
        for part, s in b.blocks():
            count, small, sum_p = _unpacked(answer[part])
            sums = np.stack([*small, sum_p], 1).astype(np.float64)
            contexts, length = _run_lengths(b.h[s])
            for i in np.flatnonzero(b.spread[s][np.cumsum(length) - length]):
                sums[i] = self.spread[int(contexts[i])]
            divisor, weight = (np.repeat(x, length) for x in backoff(sums, self.d))
            count = count.astype(np.int64)
            seen = count * np.where(count <= CUT, self.d[np.minimum(count, CUT)], 1.0) / divisor
            logs[s] = np.log10(np.where(count > 0, seen, weight * p[b.w[s]]))
        of_pair = np.empty(len(logs))
        of_pair[b.order] = logs
        starts = np.cumsum(b.lens) - b.lens

        def add(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, starts)

        return pd.DataFrame(
            {
                "doc_id": pd.array(b.doc_ids, "Int64"), "held_out": b.held, "n_tokens": b.lens,
                "n_known": add((b.c > 0).astype(np.int64)[b.tokens]), "train_tokens": self.words.n,
                "base_score": add(self.words.base(b.c)[b.tokens]), "score": add(of_pair[b.which]),
            }
        )


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame) -> DataFrame:
    """SCORED columns for each row of (doc_id, text, held_out); the others are learned from.

    Texts are lower-cased (A-Z), words are runs without ASCII blanks, and each text ends with one
    more token. Null texts count as empty. Without training rows every probability is 1.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    batches = batched(docs, parts)
    words = numbered(batches, parts)
    unigrams = Unigrams.of(words)
    answers = answered(asked(batches, words, unigrams.n, parts), unigrams, parts)
    of_counts, spread = np.zeros(CUT + 2, np.int64), {}
    for r in answers.where("batch is null").select("payload").toLocalIterator():
        counts, ids, sums = _unpacked(r["payload"])
        of_counts += counts
        for i, s in zip(ids.tolist(), sums, strict=True):
            spread[i] = spread.get(i, 0) + s
    model = Scores(unigrams, discounts(of_counts.tolist()), spread, parts)

    def run(packed: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        numbers, replies = mine[mine["of_words"]], mine[~mine["of_words"]]
        found = [model.rows(x, numbers, replies) for x in packed["payload"]]
        return pd.concat(found) if found else pd.DataFrame(columns=[x.split()[0] for x in SCORED.split(", ")])

    both = answers.withColumn("of_words", F.lit(False)).unionByName(words.withColumn("of_words", F.lit(True)))
    both = both.where("batch is not null")
    return batches.select("batch", "payload").groupBy("batch").cogroup(both.groupBy("batch")).applyInPandas(run, SCORED)


def op2_katz_backoff(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return scores(docs.select("doc_id", "text", (fold(5) == 1).alias("held_out")))
