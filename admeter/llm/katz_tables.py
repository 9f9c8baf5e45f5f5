"""A Katz model of any order as stored tables, and the scores that it gives to any texts.

``fit`` counts the n-grams of a corpus and writes, under one folder, for every order k

- ``ngrams/order=k``: context, word, count and p, the discounted probability of the word there;
- ``contexts/order=k``: context and weight, what the next lower order is multiplied with;

both in folders by a hash of the context, and ``totals`` (discounts, tokens) last: a folder without
it is no model. Discounts are those of ``katz``. An n-gram's shorter ones were seen with it, so
the mass that a weight divides by is a sum of stored p of the order below, and every context's
probabilities add up to 1 over the training words and one unknown.

``Model.score`` asks each distinct n-gram of the texts once: p is the stored one where the n-gram
was seen, else weight times p of the n-gram without its first word, down to single words. Counting,
weights and scores are grouping and joins; a key's rows in a join are at most the vocabulary. Words
are known by 64-bit hashes.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admeter.llm.common import WORD, scratch, text_or_empty
from admeter.llm.katz import CUT, discounts

ORDER = 3
#: Folders that each table is partitioned into by context.
BUCKETS = 16
#: Stands before a text and after it; no word holds a blank or is empty.
START, END = " ", ""


def _names(k: int) -> list[str]:
    return [f"g{i}" for i in range(1, k + 1)]


def _context(words: list[str]) -> Column:
    return F.xxhash64(*words) if words else F.lit(0).cast("long")


def grams(docs: DataFrame, order: int, keys: list[str]) -> DataFrame:
    """``keys`` and g1 to g``order``, hashes of a token (last) and those before it; a row per token.

    Texts are lower-cased (A-Z) and end with one more token; a null text counts as empty.
    """
    lower = F.translate(text_or_empty(), string.ascii_uppercase, string.ascii_lowercase)
    words = F.transform(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    start = F.array_repeat(F.xxhash64(F.lit(START)), order - 1)
    rows = docs.select(*keys, F.concat(start, words, F.array(F.xxhash64(F.lit(END)))).alias("__w"))
    n = F.size("__w") - (order - 1)
    sides = [F.slice("__w", i + 1, n).alias(g) for i, g in enumerate(_names(order))]
    return rows.select(*keys, F.inline(F.arrays_zip(*sides)).alias(*_names(order)))


def _discounted(d: list[float]) -> Column:
    factor = F.element_at(F.array(*map(F.lit, d[1:])), F.least("count", F.lit(CUT)).cast("int"))
    return F.col("count") * F.when(F.col("count") <= CUT, factor).otherwise(1.0)


def _discounts(counts: DataFrame) -> list[float]:
    """From the counts of counts, a handful of rows."""
    found = counts.where(F.col("count") <= CUT + 1).groupBy("count").agg(F.count("*").alias("n")).collect()
    of_counts = {r["count"]: r["n"] for r in found}
    return discounts([of_counts.get(r, 0) for r in range(CUT + 2)]).tolist()


def _weights(seen: DataFrame, d: list[float]) -> DataFrame:
    """context, divisor of its counts, weight of words not seen there; from rows with ``lower`` p."""
    sums = seen.groupBy("context").agg(
        F.sum("count").alias("total"), F.sum(_discounted(d)).alias("mass"), (1 - F.sum("lower")).alias("rest")
    )
    full = F.col("rest") <= 1e-12  # every word was seen here
    divisor = F.when(full, F.col("mass")).when(F.col("mass") < F.col("total"), F.col("total")).otherwise(F.col("total") + 1)
    weight = F.when(full, 0.0).otherwise((1 - F.col("mass") / F.col("divisor")) / F.col("rest"))
    return sums.withColumn("divisor", divisor.cast("double")).select("context", "divisor", weight.alias("weight"))


def _stored(rows: DataFrame, path: str, salt: str) -> None:
    """Rows in ``BUCKETS`` folders by context; a context's rows may lie in several files."""
    bucket = F.pmod(F.col("context"), F.lit(BUCKETS)).cast("int")
    rows = rows.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.col(salt), F.lit(8)))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class Model:
    """The tables under ``root``."""

    spark: SparkSession
    root: str

    def totals(self) -> list:
        """One row per order: tokens, distinct n-grams, discounts, p of an unknown word (order 1)."""
        return self.spark.read.parquet(f"{self.root}/totals").orderBy("order").collect()

    def ngrams(self, k: int) -> DataFrame:
        schema = "context long, word long, count long, p double, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/ngrams/order={k}")

    def contexts(self, k: int) -> DataFrame:
        return self.spark.read.schema("context long, weight double, bucket int").parquet(f"{self.root}/contexts/order={k}")

    def probabilities(self, asked: DataFrame, k: int, unknown: float) -> DataFrame:
        """g1 to gk and p of distinct k-grams, by way of their distinct shorter ones."""
        names = _names(k)
        rows = asked.withColumn("context", _context(names[:-1])).withColumn("word", F.col(names[-1]))
        rows = rows.join(self.ngrams(k).select("context", "word", F.col("p").alias("seen")), ["context", "word"], "left")
        if k == 1:
            return rows.select(*names, F.coalesce("seen", F.lit(unknown)).alias("p"))
        shorter = asked.select(*[F.col(g).alias(h) for g, h in zip(names[1:], names, strict=False)]).distinct()
        lower = self.probabilities(shorter, k - 1, unknown)
        lower = lower.select(*[F.col(h).alias(g) for g, h in zip(names[1:], names, strict=False)], F.col("p").alias("lower"))
        rows = rows.join(lower, names[1:]).join(self.contexts(k).select("context", "weight"), "context", "left")
        p = F.coalesce("seen", F.coalesce("weight", F.lit(1.0)) * F.col("lower"))
        return rows.select(*names, p.alias("p"))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, score (log10 of the text's probability) for each row of (doc_id, text).

        The texts need not be those of the corpus. Null doc_ids and repeated rows come back as
        they are; a null text is an empty one, whose only token is its end. A model of no text
        gives every probability as 1.
        """
        totals = self.totals()
        order, unknown = len(totals), totals[0]["unknown"]
        keys, names = ["doc_id", "one", "two", "times"], _names(len(totals))
        hashes = [F.xxhash64("text").alias("one"), F.xxhash64(F.lit("two"), "text").alias("two")]
        once = docs.select("doc_id", "text", *hashes).groupBy("doc_id", "one", "two")
        once = once.agg(F.min("text").alias("text"), F.count("*").alias("times"))
        held = grams(once, order, keys).groupBy(*keys, *names).agg(F.count("*").alias("c"))
        p = self.probabilities(held.select(*names).distinct(), order, unknown)
        sums = held.join(p, names).groupBy(*keys).agg(
            F.sum("c").alias("n_tokens"), F.sum(F.col("c") * F.log10("p")).alias("score")
        )
        return sums.select("doc_id", "n_tokens", "score", F.explode(F.sequence(F.lit(1), "times")).alias("__i")).drop("__i")


def fit(docs: DataFrame, root: str, order: int = ORDER) -> Model:
    """Write the model of the texts of ``docs`` to ``root``; its longest n-grams have ``order`` words."""
    if order < 1:
        raise ValueError("order must be at least 1")
    spark, counts, totals = docs.sparkSession, {}, []
    with scratch(spark) as held:
        counts[order] = held(grams(docs, order, []).groupBy(*_names(order)).agg(F.count("*").alias("count")), "katz-counts")
        for k in range(order - 1, 0, -1):
            shorter = [F.col(f"g{i + 1}").alias(f"g{i}") for i in range(1, k + 1)]
            rows = counts[k + 1].select(*shorter, "count").groupBy(*_names(k)).agg(F.sum("count").alias("count"))
            counts[k] = held(rows, "katz-counts")
        for k in range(1, order + 1):
            names, d = _names(k), _discounts(counts[k])
            sums = counts[k].agg(F.sum("count").alias("n"), F.count("*").alias("v"), F.sum(_discounted(d)).alias("mass")).first()
            n, mass = sums["n"] or 0, sums["mass"] or 0.0
            rows = counts[k].withColumn("context", _context(names[:-1])).withColumn("word", F.col(names[-1]))
            unknown = None
            if k == 1:
                over = float(n) if mass < n else n + 1.0
                unknown = 1 - mass / over if n else 1.0
                rows = rows.withColumn("divisor", F.lit(over))
            else:
                below = Model(spark, root).ngrams(k - 1)
                below = below.select(F.col("context").alias("tail"), "word", F.col("p").alias("lower"))
                seen = rows.withColumn("tail", _context(names[1:-1])).join(below, ["tail", "word"])
                weights = held(_weights(seen, d), "katz-weights")
                _stored(weights.drop("divisor"), f"{root}/contexts/order={k}", "context")
                rows = rows.join(weights, "context")
            p = (_discounted(d) / F.col("divisor")).alias("p")
            _stored(rows.select("context", "word", "count", p), f"{root}/ngrams/order={k}", "word")
            totals.append((k, n, sums["v"], d, unknown))
        schema = "order int, tokens long, ngrams long, discounts array<double>, unknown double"
        spark.createDataFrame(totals, schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/totals")
    return Model(spark, root)
