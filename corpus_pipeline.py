"""A corpus pipeline: drop toxic documents, keep one of each near-duplicate class, cut repeated passages, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of ``documents``, the last one the packed
pieces; the caller writes each result and hands it to the next stage. Rows may have null and repeated doc_ids and any
other columns; columns other than text and n_chars are handed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.files import drop, whole_row, written
from plumbline.llm.jaccard import classes
from plumbline.llm.mixing import mixed_documents, quality_weights
from plumbline.llm.packing import pack_documents
from plumbline.llm.queries import table, tokenizer_path
from plumbline.llm.repeats import without_repeats
from plumbline.llm.toxicity import fit_toxicity, is_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on labelled ones among them, calls toxic go; null texts stay."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(~is_toxic(model, F.col("text")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents one row stays: that with the least doc_id, null last, ties by a hash of the row.

    Rows without words are linked with nothing and all stay.
    """
    told = classes(docs)
    heads = told.where("class IS NULL OR row_key = head").groupBy("row_key").agg(F.max(F.col("class").isNotNull()).alias("linked"), F.count(F.lit(1)).alias("n"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.select(whole_row(docs.columns).alias("row"), key.alias("row_key")).join(heads, "row_key")
    again = F.col("linked") & (F.col("n") > 1)  # equal rows of one id
    once = rows.where(again).dropDuplicates(["row_key"])
    return rows.where(~again).select("row.*").unionByName(once.select("row.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occurred before are cut.

    A document that lost words is its words left, joined by one space, and n_chars, if there is such a column, their
    length; all other rows stay as they are.
    """
    rows = without_repeats(docs, carry=docs.columns)
    lost, row = F.col("n_removed") > 0, F.col("row")
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    cols = [F.when(lost, new[c].cast(kind)).otherwise(row[c]) if c in new else row[c] for c, kind in docs.dtypes]
    return rows.select(*(c.alias(name) for c, name in zip(cols, docs.columns, strict=True)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs, quality_weights(table(spark, sf_dir, "labels")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; ``ids`` holds each piece's token ids as 32-bit integers."""
    return pack_documents(docs, tokenizer_path(), end_id=0, capacity=1024)


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicate), ("substring dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: No SQL: the severity model and the tokenizer are outside it. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, at = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before:
            drop(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
