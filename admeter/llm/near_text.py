"""Near-duplicate texts by MinHash and a multi-index Hamming join.

A document's word shingles give a signature of POSITIONS values of 16 bits. Pairs whose
signatures differ in at most DISTANCE positions are found exactly: the signature is split into
CHUNKS chunks, and by the pigeonhole principle one chunk of such a pair differs in at most
DISTANCE // CHUNKS = 1 position. All chunk errors are enumerated as the keys that leave one
position of a chunk out, and equal keys meet. Candidates within the distance are confirmed on the
full shingle sets. (At Jaccard 0.8 a pair exceeds the distance with a chance of about 1e-4.)

Documents with equal sets are joined first; from there on a numbered set is the member of buckets
and families, so a doc_id that stands on several texts has each of them compared. Pairs never leave
a task: each bucket (large ones in tiles of bounded size) gives a forest over its candidates, the
components of these forests are families, and the tiles of a family give a forest over its
confirmed links. So classes are those of all confirmed links, at one row per set and tile. Sets
become doc_ids only after the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admeter.llm.common import table
from admeter.llm.components import components
from admeter.llm.tiles import Group, held_batches, linked, tiled
from admeter.llm.words import word_hashes
from admeter.sources.shared import keep

WORDS = 5
SIMILARITY = 80
POSITIONS, CHUNKS, DISTANCE = 32, 8, 15
WIDE = POSITIONS // CHUNKS
#: Bytes of text hashed at a time.
STRIDE = 1 << 20
#: Rows of a bucket and of a family in one tile, and shingles in a tile of a family.
BUCKET_TILE, TILE, TILE_SHINGLES = 1_500, 600, 4_000_000
#: Columns of a membership matrix at a time.
MATRIX = 4_096

# Constants of the splitmix64 mixing step, fixed values.
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(11)
_FLIP = _RNG.integers(0, 2**63, POSITIONS, dtype=np.uint64) << np.uint64(1)
_TIMES = _RNG.integers(0, 2**63, POSITIONS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than one make one shingle."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    width = min(words, n)
    total = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        total = total * _BASE + h[i : n - width + 1 + i]
    return np.unique(_mixed(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """POSITIONS values of 16 bits for each set (none of them empty)."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    out = np.empty((len(sets), POSITIONS), np.uint16)
    for k in range(POSITIONS):
        least = np.minimum.reduceat((flat ^ _FLIP[k]) * _TIMES[k], starts)
        out[:, k] = (least >> np.uint64(16)).astype(np.uint16)
    return out


def _parts(texts: list[bytes]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STRIDE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the set, signature.

    A null text has an empty set and no signature.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if t is not None else b"" for t in pdf["text"]]
            counts, digests, marks = [], [], []
            for part in _parts(texts):
                sets = [shingles(t, words) for t in texts[part]]
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                for s in sets:
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    marks.append(next(rows).tobytes() if len(s) else None)
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"], "h": pdf["h"], "n_shingles": counts, "digest": digests,
                    "signature": marks,
                }
            )

    text = F.col("text").cast("binary")
    # as text, since pandas would round large numbers where a batch holds a null
    doc_id = F.col("doc_id").cast("long").cast("string").alias("doc_id")
    rows = docs.select(doc_id, F.xxhash64(text).alias("h"), text.alias("text"))
    schema = "doc_id string, h long, n_shingles long, digest binary, signature binary"
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def chunk_keys(signature: Column) -> Column:
    """Array of keys: each chunk with each of its positions left out."""
    out = []
    for c in range(CHUNKS):
        values = [F.substring(signature, 2 * (c * WIDE + i) + 1, 2) for i in range(WIDE)]
        for gone in range(WIDE):
            rest = [v for i, v in enumerate(values) if i != gone]
            out.append(F.xxhash64(F.lit(c * WIDE + gone), *rest))
    return F.array(*out)


def distance(a: Column, b: Column) -> Column:
    """Number of positions in which two signatures differ."""
    out = F.lit(0)
    for i in range(POSITIONS):
        out = out + (F.substring(a, 2 * i + 1, 2) != F.substring(b, 2 * i + 1, 2)).cast("int")
    return out


class Join:
    """The links between the texts of one table that have different shingle sets."""

    def __init__(self, docs: DataFrame, words: int, similarity: int):
        self.words, self.similarity = words, similarity
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        # documents' texts are wide: keep Arrow batches small
        with held_batches(docs, 2000):
            self.signed = keep(signed(docs, words), "near-signed")
        some = self.signed.where("n_shingles > 0 and doc_id is not null")
        # one row for each set: its number, the smallest doc_id and the hash of a text of that one
        one = some.groupBy("digest", "n_shingles").agg(
            F.min(F.struct("doc_id", "h")).alias("of"), F.first("signature").alias("signature")
        )
        self.classes = keep(
            one.select(
                "digest", "n_shingles", F.monotonically_increasing_id().alias("set"),
                F.col("of.doc_id").alias("doc_id"), F.col("of.h").alias("h"), "signature",
            ),
            "near-classes",
        )

    def buckets(self) -> DataFrame:
        """key, id (of a set), n of all buckets with two sets or more."""
        rows = self.classes.select(
            F.explode(chunk_keys(F.col("signature"))).alias("key"),
            F.col("set").alias("id"), F.col("n_shingles").alias("n"),
        )
        rows = keep(rows, "near-keys")
        shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        shared = shared.where("low < high").select("key")
        return keep(rows.join(shared, "key"), "near-buckets")

    def candidates(self) -> DataFrame:
        """(a, b): connects all pairs of sets of a bucket, near by signature and of fitting sizes."""
        limit, similarity = DISTANCE, self.similarity

        def near(g: Group) -> np.ndarray:
            marks = np.frombuffer(b"".join(g["signature"]), np.uint16).reshape(-1, POSITIONS)
            n = g["n"]
            close = 100 * np.minimum.outer(n, n) >= similarity * np.maximum.outer(n, n)
            apart = np.zeros(close.shape, np.int16)
            for k in range(POSITIONS):
                apart += marks[:, None, k] != marks[None, :, k]
            return close & (apart <= limit)

        rows = self.buckets().join(self.classes.select(F.col("set").alias("id"), "signature"), "id")
        with held_batches(rows, 4000):
            pairs = linked(tiled(rows, "key", "id", BUCKET_TILE), ["key", "tile"], near)
            return keep(pairs.distinct(), "near-candidates")

    def links(self) -> DataFrame:
        """(a, b): connects the sets that all confirmed links connect.

        Sets that candidates connect form a family; in its tiles all of them are compared in full
        by a product of membership matrices.
        """
        words, similarity = self.words, self.similarity

        def near(g: Group) -> np.ndarray:
            sets = [shingles(t, words) for t in g["text"]]
            size = np.array(list(map(len, sets)))
            both = intersections(sets)
            return 100 * both >= similarity * (size[:, None] + size[None, :] - both)

        family = components(self.candidates()).join(self.classes, F.col("node") == F.col("set"))
        family = family.select("component", F.col("set").alias("id"), F.col("n_shingles").alias("n"), "doc_id", "h")
        family = keep(family, "near-families")
        rows = tiled(family, "component", "id", TILE, "n", TILE_SHINGLES)
        text = F.col("text").cast("binary")
        texts = self.texts.where("doc_id is not null and text is not null")
        texts = texts.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
        # the same plan at every size: a broadcast of the smaller side would not last
        rows = rows.drop("n").join(texts.hint("merge"), ["doc_id", "h"]).drop("doc_id", "h")
        with held_batches(rows, 256):
            return keep(linked(rows, ["component", "tile"], near).distinct(), "near-links")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets, exactly."""
    m = len(sets)
    if m <= 4:
        out = np.zeros((m, m), np.int64)
        for i in range(m):
            out[i, i] = len(sets[i])
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), list(map(len, sets)))
    shared = count > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, m), np.float64)
    for lo in range(0, int(shared.sum()), MATRIX):
        a, b = np.searchsorted(column, [lo, lo + MATRIX])
        block = np.zeros((m, MATRIX), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        out += block @ block.T
    out = out.astype(np.int64)
    np.fill_diagonal(out, list(map(len, sets)))
    return out


def classes(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Texts are lower-cased (A-Z) and split at ASCII blanks. Null and empty texts have no shingles
    and are linked with nothing. A row without doc_id cannot be named by others: it has its
    count, no component, and is kept. Rows of one doc_id are one document; each is returned.
    """
    join = Join(docs, words, similarity)
    part = components(join.links())
    sets = join.classes.select("digest", "n_shingles", "set", F.col("doc_id").alias("id"))
    # a class is named by the smallest doc_id of its sets
    least = part.join(sets, F.col("node") == F.col("set")).groupBy("component").agg(F.min("id").alias("low"))
    part = part.join(least, "component").select("node", "low")
    near = sets.join(part, F.col("set") == F.col("node"), "left")
    near = near.select("digest", "n_shingles", F.coalesce("low", "id").alias("own"))
    rows = join.signed.select("doc_id", "n_shingles", "digest").join(near, ["digest", "n_shingles"], "left")
    own = F.coalesce("own", "doc_id")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    # rows of one doc_id with different texts connect their classes
    odd = rows.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"))
    odd = keep(odd.where("low < high").select(F.col("doc_id").alias("of"), "low"), "near-odd")
    if not odd.isEmpty():
        met = rows.join(odd, F.col("doc_id") == F.col("of")).select("low", "component_id").distinct()
        more = components(met, "low", "component_id").withColumnsRenamed({"component": "lower"})
        rows = rows.join(more, rows["component_id"] == more["node"], "left")
        rows = rows.select("doc_id", "n_shingles", F.coalesce("lower", "component_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return rows.withColumn("kept", kept)


def op8_minhash_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return classes(table(spark, sf, "documents").select("doc_id", "text"), words=4)
