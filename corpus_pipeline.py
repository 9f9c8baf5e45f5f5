"""A training-data pipeline over ``documents``: stages in order, each on what the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written and read again as the next one's
docs. All but the last return the columns of documents, so columns beside them pass through. Rows
may hold nulls anywhere: a null text counts as empty, a row without doc_id is never a copy of
another. Stages over no rows return none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admeter.llm import bpe, language, mixing, near_text, quality_rules
from admeter.llm.common import table
from admeter.sources.shared import keep

#: Predictions below this are no language (mixed or unreadable texts).
LEAST_LANGUAGE_SCORE = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be of quality 1; all, if no rule could be learned.

    That is so with fewer than 40 usable labels, with labels of one value only, or where no rule
    tells them apart: a base rate alone says nothing about a document.
    """
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    if not model.rules:
        return docs
    rows = docs.withColumn("__stats", quality_rules.stats_of(F.col("text")))
    return rows.where(model.score("__stats") >= quality_rules.THRESHOLD).drop("__stats")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; if none was labelled, those with a letter."""
    model = language.train(docs)
    if model.families is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.withColumn("__language", language.prediction(model))
    sure = F.col("__language.score") >= LEAST_LANGUAGE_SCORE
    return rows.where((F.col("__language.lang_pred") != language.UNKNOWN) & sure).drop("__language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the smallest doc_id, one row.

    Rows are compared by their texts: unlike texts under one doc_id stay both, equal rows of
    doc_id and text become one (the smallest). Rows without doc_id all stay.
    """
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    rows = docs.withColumn("__own", own)
    ids = rows.select("doc_id", "__own")
    found = near_text.classes(docs.where("doc_id is not null").select(own.alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("node"), "component_id").distinct()
    found = keep(found, "pipeline-classes")
    # only classes of several texts have anything to drop
    several = found.groupBy("component_id").count().where("count > 1").select("component_id")
    members = ids.join(found.join(several, "component_id"), F.col("__own") == F.col("node"))
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    gone = members.join(first, "component_id").where("node <> first.node").select(F.col("node").alias("__gone")).distinct()
    rows = rows.join(gone, F.col("__own") == F.col("__gone"), "left_anti")
    again = ids.where("__own is not null").groupBy("__own").count().where("count > 1")
    again = keep(again.select(F.col("__own").alias("__again")), "pipeline-repeated")
    same = F.col("__own") == F.col("__again")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.join(again, same, "left_semi").groupBy("__own").agg(F.min(F.struct(*columns)).alias("row"))
    return rows.join(again, same, "left_anti").select(*columns).unionByName(once.select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, passages and repeats that the source weights ask for."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digest of the text that the ids decode to."""
    return bpe.encoded(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", quality),
    ("language ID", languages),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: Fitted models and the tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, "pipeline")
    return docs
