"""Alignment of two tokenizers over the same bytes, by the spans that the tokenizers report.

A is a byte-level BPE of ``tokenizers`` (character offsets), B a ``sentencepiece`` model (byte spans
of its proto). A span's end is a coarse cut where the next token starts there; tokens that share a
character, and byte-fallback tokens, are cut by their decoded bytes. Groups are what lies between
two byte offsets where tokens of both end; a link is a pair of tokens that end together.

Text is encoded in segments: a single blank or newline between two other characters ends a token of
A (a pre-token starts there) and of B (no piece holds a blank after another character, a newline is a
byte token), so a segment has the same tokens alone as in its text. Segments repeat, so each is
encoded once per batch or two, side by side with others. Links are counted per batch of documents; a batch asks for the corpus-wide
counts of its distinct pairs, a join that Spark may spill, and adds them up per document.

Defined cases: null or empty texts, and texts whose joined tokens are not space + text (U+2581 in a
text, for example), have no tokens: zeros and an empty ``groups_sha256``. Repeated rows and rows
without doc_id get a row each. No text is shortened: very long texts go through batches in parts.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admeter.llm.common import merge_settings, partitions, scratch, table
from admeter.sources.shared import keep

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A segment ends before a single blank or newline between two characters that are no white space.
BOUNDARY = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Characters that are split at a time, and segments that are encoded at a time, behind a segment of no interest.
STRETCH, CHUNK, SENTINEL = 1 << 20, 2048, " a"
#: A batch of documents ends with this many characters or this many known segments.
BATCH, KNOWN = 16 << 20, 300_000
#: A pair of ids as one number: A's id times this, plus B's.
PAIR = 1 << 32
#: B's blank.
BLANK = "▁"

MARKED = (
    "batch long, kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, codes binary, starts binary, links binary, pairs array<long>, counts array<long>"
)
RESULT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level() -> dict[str, int]:
    """The byte of each character in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spans:
    """Both tokenizers, and what is known of each segment."""

    def __init__(self, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        byte = byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in piece)
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.fallback = np.array([self.b.is_byte(i) for i in range(self.b.get_piece_size())])
        self.bytes_b = [bytes([int(p[3:5], 16)]) if f else p.replace(BLANK, " ").encode() for p, f in zip(pieces, self.fallback, strict=True)]
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups = array("q"), array("q"), array("q")
        self.groups: list[str] = []
        self.starts, self.links = array("q", [0]), array("q")

    def spans_a(self, text: str, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and byte ends of A's tokens; ``chars`` has the byte offset of each character and of the end."""
        enc = self.a.encode(text, add_special_tokens=False)
        ids, offsets = np.array(enc.ids, np.int64), np.array(enc.offsets, np.int64).reshape(-1, 2)
        decoded = np.cumsum(self.size_a[ids])
        # where the next token starts with the character after, the offset is the cut; else both share a character
        whole = np.append(offsets[1:, 0], len(chars)) >= offsets[:, 1]
        ends = np.where(whole, chars[offsets[:, 1]], decoded)
        return (ids, ends) if (ends == decoded).all() else None

    def spans_b(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and byte ends of B's tokens in a text that starts with the blank that B adds."""
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        found = np.array([(p.id, p.end) for p in pieces], np.int64).reshape(-1, 2)
        ids = found[:, 0]
        decoded = np.cumsum(self.size_b[ids])
        ends = np.where(self.fallback[ids], decoded, found[:, 1] + 1)  # a byte token's span may be its character's
        return (ids, ends) if (ends == decoded).all() else None

    def learn(self, plain: list[str], odd: list[str]) -> None:
        """Encodes new segments; ``plain`` ones can stand side by side, so many share one text."""
        for k in range(0, len(plain), CHUNK):
            self.add(plain[k : k + CHUNK], SENTINEL)
        for s in odd:
            self.add([s], "" if len(s) < 2 or s[1].isspace() else SENTINEL)

    def add(self, segments: list[str], front: str) -> None:
        text = front + "".join(segments)
        data = text.encode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        a, b = self.spans_a(text, chars), self.spans_b(text)
        whole = (
            a is not None
            and b is not None
            and b"".join(map(self.bytes_a.__getitem__, a[0].tolist())) == data == b"".join(map(self.bytes_b.__getitem__, b[0].tolist()))
        )
        if not whole and len(segments) > 1:  # some segment is not what its tokens say
            for s in segments:
                self.add([s], front)
            return
        if not whole:
            self.index[segments[0]] = len(self.groups)
            for x, v in ((self.n_a, -1), (self.n_b, 0), (self.n_groups, 0), (self.starts, len(self.links))):
                x.append(v)
            self.groups.append("")
            return
        (ids_a, ends_a), (ids_b, ends_b) = a, b
        borders = chars[np.cumsum([len(front), *map(len, segments)])]  # where segments begin and end
        at_a, at_b = (np.searchsorted(e, borders, "right") for e in (ends_a, ends_b))
        near = np.minimum(np.searchsorted(ends_a, ends_b), len(ends_a) - 1)
        in_b = np.flatnonzero(ends_a[near] == ends_b)
        in_a = near[in_b]
        cuts = np.searchsorted(ends_b[in_b], borders, "right")
        left, right = ids_a.tolist(), ids_b.tolist()
        groups = [f"{x}|{y}" for x, y in zip(ids_a[in_a].tolist(), ids_b[in_b].tolist(), strict=True)]
        first_a, first_b = (np.concatenate([[0], x[:-1] + 1]) for x in (in_a, in_b))
        several = np.flatnonzero((in_a > first_a) | (in_b > first_b))
        spans = zip(several.tolist(), *(x[several].tolist() for x in (first_a, in_a + 1, first_b, in_b + 1)), strict=True)
        for k, i0, i, j0, j in spans:
            groups[k] = f"{','.join(map(str, left[i0:i]))}|{','.join(map(str, right[j0:j]))}"
        known = len(self.groups)
        self.index.update(zip(segments, range(known, known + len(segments)), strict=True))
        where = cuts.tolist()
        self.groups += [";".join(groups[x:y]) for x, y in zip(where, where[1:], strict=False)]
        self.n_a.frombytes(np.diff(at_a).astype(np.int64).tobytes())
        self.n_b.frombytes(np.diff(at_b).astype(np.int64).tobytes())
        self.n_groups.frombytes(np.diff(cuts).astype(np.int64).tobytes())
        self.starts.frombytes((len(self.links) + cuts[1:] - cuts[0]).astype(np.int64).tobytes())
        self.links.frombytes((ids_a[in_a] * PAIR + ids_b[in_b])[cuts[0] :].tobytes())

    def codes(self, stretches: list[str]) -> list[np.ndarray]:
        """The numbers of the segments of each stretch."""
        parts = [BOUNDARY.split(s) for s in stretches]
        new = set(chain.from_iterable(parts)).difference(self.index)
        # only the ends of a text may have white space beside their border
        ends = {s for p in parts for s in (p[0], p[-1]) if len(s) < 2 or s[1].isspace() or s[-1].isspace()}
        self.learn(list(new - ends), list(new & ends))
        get = self.index.__getitem__
        return [np.fromiter(map(get, p), np.int64, len(p)) for p in parts]


@lru_cache(maxsize=1)
def spans_of(file_a: str, file_b: str) -> Spans:
    """The tokenizers of a worker, with the segments that its earlier tasks have met."""
    return Spans(file_a, file_b)


def stretches(text: str) -> Iterator[str]:
    """Space + text in parts of about ``STRETCH`` characters, each ending where a segment does."""
    text, at = " " + text, 0
    while at < len(text):
        cut = BOUNDARY.search(text, at + STRETCH) if len(text) > at + STRETCH else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Batches:
    """Collects documents' segments and turns them into rows of ``MARKED``."""

    def __init__(self, spans: Spans):
        self.spans, self.rows, self.out = spans, 0, []
        self.number = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
        self.open()

    def open(self) -> None:
        self.size, self.parts = 0, []

    def row(self, **values) -> None:
        self.out.append(dict.fromkeys((c.split()[0] for c in MARKED.split(", "))) | {"batch": self.number} | values)

    def close(self) -> None:
        """Rows of the batch: its pairs and segments, then what each document has in it."""
        if self.parts:
            known = self.spans
            used, local = np.unique(np.concatenate([c for _, c in self.parts]), return_inverse=True)
            often = np.bincount(local, minlength=len(used))
            begin = np.frombuffer(known.starts, np.int64)
            n = begin[used + 1] - begin[used]
            starts = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(begin[used] - starts[:-1], n) + np.arange(starts[-1])
            pairs, links = np.unique(np.frombuffer(known.links, np.int64)[at] if len(at) else np.empty(0, np.int64), return_inverse=True)
            counts = np.bincount(links, np.repeat(often, n), len(pairs)).astype(np.int64)
            starts, links = starts.astype(np.int32).tobytes(), links.astype(np.int32).tobytes()
            self.row(kind=0, pairs=pairs, counts=counts, starts=starts, links=links)
            ends = np.cumsum([len(c) for _, c in self.parts])
            for (values, c), end in zip(self.parts, ends, strict=True):
                self.row(kind=2, codes=local[end - len(c) : end].astype(np.int32).tobytes(), **values)
        self.number += 1
        self.open()
        if len(self.spans.index) > KNOWN:
            self.spans.clear()

    def full(self) -> None:
        if self.size >= BATCH or len(self.spans.index) > KNOWN:
            self.close()

    def document(self, doc_id: int | None, codes: np.ndarray, row: int) -> None:
        """A document, or a part of one, whose segments are all known."""
        known = self.spans
        a = np.frombuffer(known.n_a, np.int64)[codes]
        if a.min() < 0:
            return self.nothing(doc_id, row)
        begin = np.frombuffer(known.starts, np.int64)
        text = ";".join(map(known.groups.__getitem__, codes.tolist()))
        self.parts.append(
            (
                {
                    "row": row, "doc_id": doc_id, "n_a": int(a.sum()), "n_b": int(np.frombuffer(known.n_b, np.int64)[codes].sum()),
                    "n_groups": int(np.frombuffer(known.n_groups, np.int64)[codes].sum()),
                    "n_links": int((begin[codes + 1] - begin[codes]).sum()),
                    "groups_sha256": hashlib.sha256(text.encode()).hexdigest(),
                },
                codes,
            )
        )

    def nothing(self, doc_id: int | None, row: int) -> None:
        self.row(kind=2, row=row, doc_id=doc_id, n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="", codes=b"")

    def long_document(self, doc_id: int | None, text: str, row: int) -> None:
        """A text of several stretches: looked at as a whole first, then added in parts."""
        for s in stretches(text):
            codes = self.spans.codes([s])[0]
            if np.frombuffer(self.spans.n_a, np.int64)[codes].min() < 0:
                return self.nothing(doc_id, row)
            self.full()
        digest, glue = hashlib.sha256(), b""
        for s in stretches(text):
            codes = self.spans.codes([s])[0]
            digest.update(glue)
            digest.update(";".join(map(self.spans.groups.__getitem__, codes.tolist())).encode())
            self.document(doc_id, codes, row)
            self.parts[-1][0]["groups_sha256"] = None
            glue = b";"
            self.size += len(s)
            self.full()
        self.row(kind=2, row=row, doc_id=doc_id, n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256=digest.hexdigest(), codes=b"")

    def documents(self, ids: list, texts: list) -> None:
        held: list[tuple] = []
        size = 0

        def flush() -> None:
            nonlocal size
            found = self.spans.codes([" " + t for _, t, _ in held])
            for (doc_id, t, row), codes in zip(held, found, strict=True):
                self.document(doc_id, codes, row)
                self.size += len(t)
            held.clear()
            size = 0
            self.full()

        for doc_id, text in zip(ids, texts, strict=True):
            doc_id = int(doc_id) if isinstance(doc_id, str) else None
            row = self.base + self.rows
            self.rows += 1
            if not text:
                self.nothing(doc_id, row)
            elif len(text) > STRETCH:
                if held:
                    flush()
                self.long_document(doc_id, text, row)
            else:
                held.append((doc_id, text, row))
                size += len(text)
                if size >= STRETCH:
                    flush()
        if held:
            flush()

    @property
    def base(self) -> int:
        return self.number >> 32 << 32

    def taken(self) -> Iterator[pd.DataFrame]:
        out, self.out = self.out, []
        for k in range(0, len(out), 500):
            yield pd.DataFrame(out[k : k + 500], columns=[c.split()[0] for c in MARKED.split(", ")])


def marked(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """Rows of ``MARKED``: kind 0 has a batch's pairs and segments, kind 2 a document's part in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = Batches(spans_of(path_of(file_a), path_of(file_b)))
        for pdf in frames:
            batches.documents(pdf["doc_id"].tolist(), pdf["text"].tolist())
            yield from batches.taken()
        batches.close()
        yield from batches.taken()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text, null stays apart from numbers
    return rows.mapInPandas(run, MARKED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, total, top (no pair with the same B id has more) from the counts of the batches."""
    each = rows.where("kind = 0").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    totals = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total"))
    b = F.col("pair") % PAIR
    # at most one row per id of B's vocabulary
    best = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    return totals.join(F.broadcast(best), b == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("top"))


def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts and best links of each document, from rows sorted by (batch, kind, pos)."""
    batch, sums, tops = None, None, None
    starts = links = None
    total: list[np.ndarray] = []
    top: list[np.ndarray] = []
    for pdf in frames:
        out = []
        for (b, kind), g in pdf.groupby(["batch", "kind"], sort=True):
            if b != batch:
                batch, sums, starts, links, total, top = b, None, None, None, [], []
            if kind == 0:
                starts, links = (np.frombuffer(g[c].iloc[0], np.int32) for c in ("starts", "links"))
            elif kind == 1:
                total.append(g["total"].to_numpy(np.int64))
                top.append(g["top"].to_numpy(np.int64))
            else:
                if sums is None and starts is not None:
                    per = [np.concatenate(x)[links] if x else np.empty(0, np.int64) for x in (total, top)]
                    sums, tops = (np.diff(np.concatenate([[0], np.cumsum(x)])[starts]) for x in per)
                for r in g.itertuples(index=False):
                    codes = np.frombuffer(r.codes, np.int32)
                    best, count = (int(x[codes].sum()) if len(codes) else 0 for x in (tops, sums))
                    out.append((r.row, r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, best, count, r.groups_sha256))
        if out:
            done = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield done.astype({c: "Int64" for c in done.columns if c != "groups_sha256"})


def aligned(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    spark = docs.sparkSession
    with scratch(spark) as held:
        with merge_settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}):
            rows = held(marked(docs, file_a, file_b), "spans")
        counts = held(pair_counts(rows), "spans-counts")
        asked = rows.where("kind = 0").select("batch", F.posexplode("pairs").alias("pos", "pair"))
        answers = asked.join(counts, "pair").select("batch", F.lit(1).alias("kind"), "pos", "total", F.col("top").cast("int").alias("top"))
        mine = rows.drop("pairs", "counts").withColumn("pos", F.lit(0))
        both = mine.unionByName(answers, allowMissingColumns=True)
        both = both.repartition(partitions(spark), "batch").sortWithinPartitions("batch", "kind", "pos")
        with merge_settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}):
            done = held(both.mapInPandas(added, RESULT), "spans-parts")
        sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        result = done.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256"))
        return keep(result.drop("row"), "aligned")


def op12_token_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment of every document's tokens; see the module for nulls, odd texts and repeated rows."""
    return aligned(table(spark, sf, "documents"))
