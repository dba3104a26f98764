"""A training corpus from raw documents: classify, drop near-duplicates, cut repeated passages, mix sources, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, packing, rule_ensemble, simhash
from tidemark.llm.queries import MIX, RUN_WORDS, table, tokenizer
from tidemark.llm.shared import stage


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, predicts to be good."""
    judged = rule_ensemble.classify(docs, table(spark, sf_dir, "labels"), threshold=0.3, score_col="_tm_score", predicted_col="_tm_predicted")
    return judged.where("_tm_predicted = 1").select(*docs.columns)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id."""
    return simhash.one_of_each(docs, width=5, similarity=0.8)


def line_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of sentences and lines that earlier ones have; those of which nothing is left go. A
    column n_chars, where there is one, follows the text that is cut."""
    cut = line_dedup.dedup(docs, min_words=RUN_WORDS, places_col="_tm_removed").where("size(_tm_removed) = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.size("_tm_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Their weights are of the text alone, in DataFrame operations: a
    stage gives the columns of documents only, and the classifier's score needs Python (see README)."""
    return mixing.mixed_rows(docs, **MIX)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its training sequence and place there."""
    return packing.pack_documents(docs, tokenizer(), end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classified),
    ("near-dedup by shingles", near_deduplicated),
    ("line dedup", line_deduplicated),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: SQL has no rule ensemble; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
