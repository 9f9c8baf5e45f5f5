"""Token totals by source, language and tokenizer version, kept current by signed deltas.

A batch of changes becomes one small folder of summed deltas under the store. Its name is the
batch's id and Spark's success marker commits it, so a batch that is delivered again, or that is
run again after a crash, counts once. Totals are the sum over committed folders; ``compact``
folds them into one base that remembers the ids it holds. One writer at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admeter.llm.common import WORD, table, text_or_empty
from admeter.sources.shared import delete, keep, new_path

KEYS = ["source", "lang", "tokenizer"]
#: A finer count: ASCII letter runs, single digits, every other character by itself.
PIECE = r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (op, source, lang, tokenizer, n_tokens, old_n_tokens).

    An insert adds n_tokens, a delete takes old_n_tokens away, a revision swaps one for the
    other. Null counts are 0, null keys are groups of their own, unknown ops change nothing.
    """
    new, old = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_tokens", "old_n_tokens"))
    op = F.col("op")
    return changes.groupBy(*KEYS).agg(
        F.sum(F.when(op == INSERT, 1).when(op == DELETE, -1).otherwise(0)).alias("n_docs"),
        F.sum(
            F.when(op == INSERT, new).when(op == DELETE, -old).when(op == REVISE, new - old).otherwise(0)
        ).alias("n_tokens"),
    )


class Store:
    """The folder of a rollup."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[str]:
        path, fs = self._path(kind)
        if not fs.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        done = []
        for n in names:
            mark, _ = self._path(f"{kind}/{n}/_SUCCESS")
            if fs.exists(mark):
                done.append(n)
        return done

    def _base(self) -> tuple[str | None, set[str]]:
        bases = self._committed("base")
        if not bases:
            return None, set()
        ids = self.spark.read.parquet(f"{self.root}/base/{bases[-1]}").where("batch is not null")
        return bases[-1], {r["batch"] for r in ids.select("batch").collect()}

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if its id had been committed before.

        The id names a folder: letters, digits, ``.``, ``_`` and ``-``, neither dot nor underscore first.
        """
        if not re.fullmatch(r"[A-Za-z0-9-][A-Za-z0-9._-]*", batch):
            raise ValueError(f"a batch id names a folder: {batch!r}")
        if batch in self._base()[1] or batch in self._committed("delta"):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.root}/delta/{batch}")
        return True

    def totals(self) -> DataFrame:
        """Totals of every key that has documents or tokens."""
        base, held = self._base()
        parts = [f"{self.root}/delta/{b}" for b in self._committed("delta") if b not in held]
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        rows = self.spark.createDataFrame([], schema)
        if parts:
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(*parts))
        if base:
            kept = self.spark.read.parquet(f"{self.root}/base/{base}").where("batch is null")
            rows = rows.unionByName(kept.drop("batch"))
        sums = rows.groupBy(*KEYS).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
        )
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """One base in place of all committed deltas; a crash leaves the old state in force."""
        base, held = self._base()
        batches = self._committed("delta")
        ids = sorted(held | set(batches))
        if not ids:
            return
        number = int(base or 0) + 1
        names = self.spark.createDataFrame([(i,) for i in ids], "batch string")
        rows = self.totals().withColumn("batch", F.lit(None).cast("string"))
        rows.unionByName(names, allowMissingColumns=True).write.mode("overwrite").parquet(
            f"{self.root}/base/{number:08d}"
        )
        for b in batches:
            delete(self.spark, f"{self.root}/delta/{b}")
        # the base before this one stays for readers that are still at it
        for b in self._committed("base")[:-2]:
            delete(self.spark, f"{self.root}/base/{b}")


def counted(docs: DataFrame) -> DataFrame:
    """Keys and both counts of each document; null text has no tokens. No text is kept."""
    t = text_or_empty()
    return docs.select(
        "doc_id", "source", "lang", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"),
        F.regexp_count(t, F.lit(PIECE)).cast("long").alias("pieces"),
        F.sha2(F.col("text"), 256).alias("sha"),
    )


def changes(rows: DataFrame, op: str, tokenizer: str, new: str | None, old: str | None) -> DataFrame:
    count = [F.col(c) if c else F.lit(None).cast("long") for c in (new, old)]
    return rows.select(
        F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"),
        count[0].alias("n_tokens"), count[1].alias("old_n_tokens"),
    )


def op10_token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """All documents arrive under two tokenizers, one with character counts at first.

    Its counts are then revised, later copies of a text (not its smallest doc_id) are deleted,
    and two of the batches are delivered once more.
    """
    rows = keep(counted(table(spark, sf, "documents")), "rollup-docs")
    first = rows.where("sha is not null").groupBy("sha").agg(F.min("doc_id").alias("first"))
    # all but the smallest doc_id; by text and doc_id, so that the copies of one text are spread
    first = first.select("sha", F.col("first").alias("doc_id"))
    copies = rows.where("sha is not null and doc_id is not null").join(first, ["sha", "doc_id"], "left_anti")
    gone = changes(copies, DELETE, "words", None, "words").unionByName(
        changes(copies, DELETE, "pieces", None, "pieces")
    )
    store = Store(spark, new_path(spark, "rollup"))
    words = changes(rows, INSERT, "words", "words", None)
    revised = changes(rows, REVISE, "pieces", "pieces", "n_chars")
    store.apply("1-words", words)
    store.apply("2-pieces", changes(rows, INSERT, "pieces", "n_chars", None))
    store.apply("3-recount", revised)
    store.compact()
    store.apply("4-copies", gone)
    store.apply("3-recount", revised)
    store.apply("1-words", words)
    return store.totals()


OP10_SQL = r"""
WITH d AS (
  SELECT source, lang, text, doc_id, min(doc_id) OVER (PARTITION BY text) AS first,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]')) AS pieces
  FROM documents),
kept AS (SELECT * FROM d WHERE text IS NULL OR doc_id IS NULL OR doc_id <= first)
SELECT source, lang, 'words' AS tokenizer, count(*) AS n_docs, CAST(sum(words) AS BIGINT) AS n_tokens
FROM kept GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces', count(*), CAST(sum(pieces) AS BIGINT) FROM kept GROUP BY source, lang
"""
