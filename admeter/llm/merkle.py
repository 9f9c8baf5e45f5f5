"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

A text is cut into paragraphs (lines) and each paragraph into pieces where its content says so: after
the marks that end a sentence and after words that end in certain letters, in steps of at most 48
characters, so that the pieces put together are the text and pieces line up again after an insertion
or deletion. A paragraph's digest is over
its pieces' hashes, a section (eight paragraphs) is over its paragraphs' digests, and the root is
SHA-256 over the sections and the text's length. Equal roots mean equal texts; where roots
differ, ``changed_paragraphs`` walks down from differing sections only. Likeness is Dice's
coefficient over the distinct pieces (1 for two empty texts).

The fingerprint as text: root, then each section's digest with its paragraphs' digests and the
sorted distinct piece hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from admeter.llm.common import boundaries, partitions, range_of, table, text_or_empty

#: Characters of a piece, at most (and the sentence's end marks or blanks).
PIECE = 48
#: Paragraphs in a section.
SECTION = 8
#: A word that ends in one of these ends a piece: about a third of all words in many languages.
ENDS = "aeouyéä02468"
PIECES = r"(?s).{0,%d}?(?:[.!?]++\s*+|[%s]\s++)|.{1,%d}" % (PIECE - 1, ENDS, PIECE)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def tree(text: Column) -> Column:
    """Struct (root, sections, leaves): sections are structs (digest, paragraphs), paragraphs digests."""
    lines = F.split(text, "\n", -1)

    def paragraph(p: Column) -> Column:
        hashes = F.transform(F.regexp_extract_all(p, F.lit(PIECES), F.lit(0)), lambda x: F.xxhash64(x))
        return F.struct(F.xxhash64(hashes).alias("digest"), hashes.alias("leaves"))

    def section(ps: Column) -> Column:
        return F.struct(F.xxhash64(ps).alias("digest"), ps.alias("paragraphs"))

    def grouped(ps: Column) -> Column:
        digests = F.transform(ps, lambda p: p["digest"])
        starts = F.sequence(F.lit(1), F.size(ps), F.lit(SECTION))
        return F.struct(
            F.transform(starts, lambda i: section(F.slice(digests, i, SECTION))).alias("sections"),
            F.array_distinct(F.flatten(F.transform(ps, lambda p: p["leaves"]))).alias("leaves"),
        )

    def rooted(g: Column) -> Column:
        top = F.concat_ws(",", F.transform(g["sections"], lambda s: _hex(s["digest"])))
        # the text's own digest beside the sections' keeps roots equal for equal texts only
        root = F.sha2(F.concat_ws(":", F.sha2(text, 256), top), 256)
        return F.struct(
            root.alias("root"), g["sections"].alias("sections"),
            F.array_sort(g["leaves"]).alias("leaves"),
        )

    # one-element arrays bind a value to a name, so that it is computed once
    parts = F.array(F.transform(lines, paragraph))
    return F.transform(F.transform(parts, grouped), rooted)[0]


def encoded(t: Column) -> Column:
    """The fingerprint of a tree as one string."""
    sections = F.transform(
        t["sections"],
        lambda s: F.concat(
            _hex(s["digest"]), F.lit("="),
            F.concat_ws("+", F.transform(s["paragraphs"], lambda p: _hex(p))),
        ),
    )
    leaves = F.transform(t["leaves"], lambda x: _hex(x))
    return F.concat_ws("|", t["root"], F.concat_ws(";", sections), F.concat_ws(",", leaves))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal pieces of two trees, 0 to 1."""
    total = F.size(a["leaves"]) + F.size(b["leaves"])
    common = F.size(F.array_intersect(a["leaves"], b["leaves"]))
    return F.when(a["root"] == b["root"], 1.0).when(total == 0, 1.0).otherwise(2.0 * common / total)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``a`` in sections that differ and that ``b`` lacks there."""
    numbers = F.sequence(F.lit(1), F.size(a["sections"]))
    differing = F.filter(
        numbers,
        lambda i: ~F.coalesce(
            F.get(a["sections"], i - 1)["digest"] == F.get(b["sections"], i - 1)["digest"], F.lit(False)
        ),
    )

    def within(i: Column) -> Column:
        mine = F.get(a["sections"], i - 1)["paragraphs"]
        theirs = F.coalesce(
            F.get(b["sections"], i - 1)["paragraphs"], F.array().cast("array<bigint>")
        )
        at = F.sequence(F.lit(0), F.size(mine) - 1)
        odd = F.filter(at, lambda k: ~F.array_contains(theirs, F.get(mine, k)))
        return F.transform(odd, lambda k: (i - 1) * SECTION + k)

    return F.flatten(F.transform(differing, within))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next row by doc_id, after the last the first.

    Rows are dealt by ranges of doc_id; each range also gets a copy of the first row of the next
    one, so a window inside the range is enough. Nulls come first, rows of one doc_id in the
    order of their text; a null text counts as empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    bounds = boundaries(rows, "doc_id", 4 * partitions(docs.sparkSession))
    rows = rows.withColumn("part", range_of("doc_id", bounds))
    first = F.min(F.struct(F.col("doc_id"), "text")).alias("first")
    heads = rows.groupBy("part").agg(first)
    # one row per range from here on
    line = Window.orderBy("part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prior = F.coalesce(F.lag("part").over(line), F.max("part").over(whole))
    # the wrap-around copy closes the last range, which also is the first when there is one only
    closing = heads.select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.text").alias("text"),
        prior.alias("part"), F.lit(1).alias("closing"),
    )
    both = rows.withColumn("closing", F.lit(0)).unionByName(closing)
    inside = Window.partitionBy("part").orderBy("closing", "doc_id", "text")
    return both.withColumn("next_text", F.lead("text").over(inside)).where("closing = 0").drop(
        "part", "closing"
    )


def edited(text: Column, following: Column) -> Column:
    """The last half of ``text`` (floor, code points) replaced by the front of ``following``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def op1_merkle_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are taken whole; null counts as the empty text, which has a fingerprint as well.

    ``edited_paragraphs`` are the numbers of the paragraphs that the edit changed, found by going
    down from the sections whose digests differ.
    """
    rows = with_next(table(spark, sf, "documents"))
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("next_text")))
    names = {"own": "text", "other": "edit", "after": "next_text"}
    rows = rows.withColumns({k: tree(F.col(v)) for k, v in names.items()})
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edit"), 256).alias("edited_sha256"),
        encoded(F.col("own")).alias("fingerprint"),
        encoded(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
        changed_paragraphs(F.col("own"), F.col("other")).alias("edited_paragraphs"),
    )
