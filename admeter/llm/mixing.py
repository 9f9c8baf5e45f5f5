"""Mixing sources to target weights in fixed-length blocks of words.

The words of a source, in the order of doc_id, form one stream that is cut into blocks. A source
fills as many slots as its target asks for. Every slot goes to an output shard by an independent
uniform draw, so that the counts a source has in the shards are multinomial while its total meets
the target. A slot's number within its source passes through a pseudorandom permutation of the
source's block numbers (swap-or-not rounds, one permutation per pass over the source), which
names the block; blocks and documents then meet in a join on (source, block), which moves the words
of each block to its slots. The last, shorter block ends each pass, and the last slot may take only
the front of its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from admeter.llm.common import WORD, boundaries, merge_settings, partitions, range_of, table, text_or_empty
from admeter.sources.shared import keep, new_path

WEIGHTS = (5, 2, 1)
#: A source is used at most this often.
REPEATS = 3
#: Words in a block.
BLOCK = 64
OUTPUT_SHARDS = 64
SEED = 20
ROUNDS = 24
#: Blocks made by one row of the first expansion.
CHUNK = 65_536


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, words of the whole text (null: 0), a hash that orders ties, and ``more``."""
    return docs.select(
        *more,
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("h"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """source, idx, source_size, target (double), take (words): one row per source.

    Weights repeat over the sources by code point, null last. A target is min(cap, level *
    weight); the level is the largest that any source reaches when sources are capped in the
    order of cap / weight, so the targets add up to all sizes. These windows see one row per
    source, not the documents.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod("idx", F.lit(len(WEIGHTS))) + 1)
    rows = sums.withColumn("idx", n).withColumn("weight", weight)
    rows = rows.withColumn("cap", (F.col("source_size") * REPEATS).cast("double"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - before) / rest)
    level = F.max("level").over(every)
    target = F.least("cap", F.greatest(level * F.col("weight"), F.lit(0.0)))
    rows = rows.withColumn("target", target)
    return rows.select(
        "source", "idx", "source_size", "target", F.round("target").cast("long").alias("take")
    )


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Image of ``x`` under a pseudorandom permutation of 0 .. n-1 chosen by ``key``: swap-or-not rounds."""

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *key, r), n) - at, n)
        coin = F.pmod(F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(at, partner)), F.lit(2))
        return F.when(coin == 0, at).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def slots(ranges: DataFrame, block: int = BLOCK, shards: int = OUTPUT_SHARDS) -> DataFrame:
    """One row per slot and range that holds words of its block: idx, part, shard, slot, block, n_words, pass.

    ``ranges`` has idx, part, start and s (words of the source before the range, and in it). Each of
    its blocks looks up its slot: the rounds of ``permuted`` undo themselves, so in reverse order
    they lead from the block to the number that it is the image of. One round is one projection;
    what it takes from source, pass and round alone comes with the range.
    """
    size, take = F.col("source_size"), F.col("take")
    rows = ranges.where((size > 0) & (take > 0) & (F.col("s") > 0)).select(
        "idx", "part", "start", "s", size.alias("size"), F.floor(size / block).alias("full"),
        F.pmod(size, F.lit(block)).alias("tail"), F.floor(take / size).alias("passes"), F.pmod(take, size).alias("rem"),
    )
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), "passes")))
    n = F.greatest("full", F.lit(1))
    keys = F.transform(
        F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.pmod(F.xxhash64(F.lit(SEED), "idx", "pass", r), n)
    )
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("s") - 1) / block)
    chunk = F.explode(F.sequence(F.floor(first / CHUNK), F.floor(last / CHUNK)))
    rows = rows.select("*", first.alias("first"), last.alias("last"), chunk.alias("chunk"))
    rows = rows.repartition(partitions(ranges.sparkSession), "idx", "part", "pass", "chunk").withColumn("keys", keys)
    low, high = F.greatest("first", F.col("chunk") * CHUNK), F.least("last", (F.col("chunk") + 1) * CHUNK - 1)
    rows = rows.withColumn("block", F.explode(F.sequence(low, high))).withColumn("at", F.col("block"))
    for r in range(ROUNDS, 0, -1):
        at, partner = F.col("at"), F.col("partner")
        rows = rows.withColumn("partner", F.pmod(F.element_at("keys", r) - at, n))
        coin = F.pmod(F.xxhash64(F.lit(SEED + 1), "idx", "pass", F.lit(r), F.greatest(at, partner)), F.lit(2))
        rows = rows.withColumn("at", F.when(coin == 0, at).otherwise(partner))
    full = F.col("full")
    rows = rows.withColumn("at", F.when(F.col("block") < full, F.col("at")).otherwise(full))
    room = F.when(F.col("block") < full, F.lit(block).cast("long")).otherwise(F.col("tail"))
    left = F.when(F.col("pass") < F.col("passes"), room).otherwise(F.col("rem") - F.col("at") * block)
    in_pass = full + (F.col("tail") > 0).cast("long")
    number = (F.col("pass") * in_pass + F.col("at")).alias("slot")
    # a filter on what a generator gives is not pushed into the rounds, where it would be written out
    made = F.inline(F.array(F.struct(number, F.least(room, left).alias("n_words"))))
    rows = rows.select("idx", "part", "block", "pass", made)
    shard = F.pmod(F.xxhash64(F.lit(SEED + 2), "idx", "slot"), F.lit(shards)).cast("int").alias("shard")
    return rows.where("n_words > 0").select("*", shard)


def cuts_of(sizes: DataFrame) -> list:
    """Borders of the ranges of doc_id that ``placed`` works in."""
    return boundaries(sizes, "doc_id", partitions(sizes.sparkSession))


def named(rows: DataFrame, sources: DataFrame, cuts: list) -> DataFrame:
    """Adds part, the range of doc_id, and idx, the number of the source."""
    names = sources.select(F.col("source").alias("name"), "idx")
    rows = rows.withColumn("part", range_of("doc_id", cuts))
    return rows.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name")


def ranges_of(sizes: DataFrame, sources: DataFrame, cuts: list) -> DataFrame:
    """idx, part, s (words), start (words of the source before), source_size, take: a row per source and range."""
    sums = named(sizes, sources, cuts).groupBy("idx", "part").agg(F.sum("size").alias("s"))
    earlier = Window.partitionBy("idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    return sums.join(sources.select("idx", "source_size", "take"), "idx")


def placed(rows: DataFrame, sources: DataFrame, cuts: list, ranges: DataFrame) -> DataFrame:
    """Adds idx, a row's key (part, rn), off, the words of the source before the document, and start and s.

    Prefix sums run inside ranges of doc_id, so that a hot source is spread over many tasks;
    what lies before a range comes from the sums of the ranges.
    """
    inside = Window.partitionBy("idx", "part").orderBy("doc_id", "h", "size")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = named(rows, sources, cuts).withColumn("rn", F.row_number().over(inside)).withColumn("inner", before)
    rows = rows.join(ranges.select("idx", "part", "start", "s"), ["idx", "part"])
    return rows.withColumn("off", F.col("start") + F.col("inner")).drop("inner")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents cut at block borders: block and the words [lo, hi) of it. Empty ones have none."""
    off, end = F.col("off"), F.col("off") + F.col("size")
    b = F.explode(F.sequence(F.floor(off / block), F.floor((end - 1) / block)))
    rows = rows.where("size > 0").withColumn("block", b)
    start = F.col("block") * block
    return rows.withColumn("lo", F.greatest(off, start) - start).withColumn(
        "hi", F.least(end, start + block) - start
    )


def worded(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The cuts of ``pieces`` with their words, joined by single blanks; a text is split once.

    ``inner`` says that the whole block lies in the range of the row.
    """
    off, end = F.col("off"), F.col("off") + F.col("size")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    numbers = F.sequence(F.floor(off / block), F.floor((end - 1) / block))

    def piece(w: Column, b: Column) -> Column:
        start = b * block
        lo, hi = F.greatest(off, start), F.least(end, start + block)
        mine = F.slice(w, (lo - off + 1).cast("int"), (hi - lo).cast("int"))
        return F.struct(
            b.alias("block"), (lo - start).alias("lo"), (hi - start).alias("hi"),
            F.array_join(mine, " ").alias("words"),
        )

    # a one-element array binds the words to a name, so that they are computed once
    every = F.flatten(F.transform(F.array(words), lambda w: F.transform(numbers, lambda b: piece(w, b))))
    first, after = F.col("start"), F.col("start") + F.col("s")
    rows = rows.where("size > 0").select("idx", "part", "rn", "doc_id", first.alias("first"), after.alias("after"), F.explode(every).alias("p"))
    inner = (F.col("p.block") * block >= F.col("first")) & ((F.col("p.block") + 1) * block <= F.col("after"))
    return rows.select("idx", "part", "rn", "doc_id", "p.*", inner.alias("inner"))


def _blocks(docs: DataFrame, sizes: DataFrame, sources: DataFrame, cuts: list, ranges: DataFrame) -> DataFrame:
    """``mixed_blocks`` and, as ``pieces``, the row (part, rn) and number of words of each document.

    A text is dealt once, by source and range of doc_id; it is cut there and meets the slots of the
    range. Only blocks that reach over a border of ranges are put together in a further shuffle.
    """
    spark = docs.sparkSession
    rows = worded(placed(sized(docs, text_or_empty().alias("text")), sources, cuts, ranges))
    n = F.least("hi", "n_words") - F.col("lo")
    front = F.call_function("substring_index", "words", F.lit(" "), n.cast("int"))
    words = F.when(F.col("hi") <= F.col("n_words"), F.col("words")).otherwise(front)
    one = F.struct("lo", n.alias("n"), "doc_id", "part", "rn", words.alias("words"))
    every = F.sort_array(F.collect_list(one)).alias("p")
    slot = ["idx", "block", "slot", "shard", "n_words"]
    # rows dealt by (idx, part) may stay where they are for joins and groups by more columns
    with merge_settings(spark, **{"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        # the same plan at every size: slots would not stay small enough to be broadcast
        rows = slots(ranges).join(rows.hint("merge"), ["idx", "part", "block"]).where("lo < n_words")
        inner = rows.where("inner").groupBy(*slot, "part").agg(every).drop("part")
        across = rows.where("not inner").groupBy(*slot).agg(every)
        rows = inner.unionByName(across)
        rows = rows.join(sources.select("idx", "source"), "idx").select(
            "shard", "slot", "source", "idx", "block", "n_words",
            F.array_join("p.words", " ").alias("words"), F.col("p.doc_id").alias("doc_ids"),
            F.transform("p", lambda x: F.struct(x["part"], x["rn"], x["n"])).alias("pieces"),
        )
        path = new_path(spark, "mix-blocks")
        rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """shard, slot (within its source), source, block, n_words, words, doc_ids: a row per slot.

    ``words`` are the block's words joined by single blanks, ``doc_ids`` the documents they come
    from, in order.
    """
    sizes = keep(sized(docs), "mix-sizes")
    sources = keep(targets(sizes), "mix-sources")
    cuts = cuts_of(sizes)
    ranges = keep(ranges_of(sizes, sources, cuts), "mix-ranges")
    return _blocks(docs, sizes, sources, cuts, ranges).drop("idx", "pieces")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; taken is counted in the mixed blocks.

    Null and empty texts have size 0 and are never taken; a null source is a source. Repeated
    rows are documents of their own. Targets of sources without words are 0.
    """
    sizes = keep(sized(docs), "mix-sizes")
    sources = keep(targets(sizes), "mix-sources")
    cuts = cuts_of(sizes)
    key = ["idx", "part", "rn"]
    ranges = keep(ranges_of(sizes, sources, cuts), "mix-ranges")
    rows = keep(placed(sizes, sources, cuts, ranges).select(*key, "doc_id", "size"), "mix-rows")
    used = _blocks(docs, sizes, sources, cuts, ranges).select("idx", F.explode("pieces").alias("p"))
    taken = used.select("idx", "p.*").groupBy(*key).agg(F.sum("n").alias("taken"))
    return (
        rows.join(taken, key, "left")
        .join(sources.select("idx", "source_size", "target"), "idx")
        .select(
            "doc_id", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    Every pass over a source gives the words of its drawn blocks: a document whose words are all
    drawn unchanged, of others what is drawn, in order and joined by single blanks (n_chars counts
    anew).
    Documents of which nothing is drawn are not in it, so empty ones never are.
    """
    names = docs.columns
    sizes = keep(sized(docs, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")), "mix-docs")
    sources = keep(targets(sizes.drop("row")), "mix-sources")
    borders = cuts_of(sizes)
    ranges = keep(ranges_of(sizes, sources, borders), "mix-ranges")
    rows = keep(placed(sizes, sources, borders, ranges).drop("start", "s"), "mix-rows")
    key = ["idx", "part", "rn"]
    drawn = slots(ranges).select("idx", "part", "block", "pass", "n_words")
    # sources are few rows before they are expanded: without the hint the slots would be broadcast at every size
    cuts = pieces(rows.select(*key, "off", "size")).hint("merge").join(drawn, ["idx", "part", "block"])
    cuts = cuts.withColumn("hi", F.least("hi", "n_words")).where("hi > lo")
    start = F.col("block") * BLOCK + F.col("lo") - F.col("off")
    n = F.col("hi") - F.col("lo")
    span = F.struct(start.cast("int").alias("at"), n.cast("int").alias("n"))
    spans = cuts.groupBy(*key, "pass").agg(F.sort_array(F.collect_list(span)).alias("spans"), F.sum(n).alias("n"))
    draws = spans.groupBy(*key).agg(F.collect_list(F.struct("spans", "n")).alias("draws"))
    text, size = F.col("row.text"), F.col("size")
    some = F.exists("draws", lambda d: d["n"] < size)
    words = F.when(some, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))

    def drawn_text(w: Column, d: Column) -> Column:
        part = F.flatten(F.transform(d["spans"], lambda s: F.slice(w, s["at"] + 1, s["n"])))
        return F.when(d["n"] == size, text).otherwise(F.array_join(part, " "))

    every = F.flatten(F.transform(F.array(words), lambda w: F.transform("draws", lambda d: drawn_text(w, d))))
    out = rows.join(draws, key).select("row", F.explode(every).alias("taken"))
    new = {"text": F.col("taken"), "n_chars": F.char_length("taken").cast("long")}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def op5_mixed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"))
