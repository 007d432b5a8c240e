"""A training corpus in five stages: rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `docs`. A stage that changes a text sets n_chars, where
there is such a column, to the text's code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import read_table, stash
from panelspark.llm.decontaminate import drop_leaks
from panelspark.llm.jaccard_join import keep_one
from panelspark.llm.line_dedup import dedup_lines
from panelspark.llm.packing import pack
from panelspark.llm.quality_rules import quality


def _with_text(rows: DataFrame, columns: list[str], text: Column, changed: Column) -> DataFrame:
    """`columns` of `doc` in `rows`, with the new text (null stays null) and its length where it changed."""
    own = {c: F.col("doc")[c] for c in columns}
    new = F.when(own["text"].isNotNull(), text)
    put = {"text": new, "n_chars": F.when(changed, F.length(new).cast("long")).otherwise(own["n_chars"])} if "n_chars" in columns else {"text": new}
    return rows.select(*[put.get(c, own[c]).alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail."""
    kept = quality(docs).filter("kept")
    return _with_text(kept, docs.columns, F.col("clean"), ~F.col("clean").eqNullSafe(F.col("doc")["text"]))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them have."""
    return _with_text(dedup_lines(docs), docs.columns, F.col("kept"), F.col("n_dropped") > 0)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Near duplicates and packing are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each result written before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
