"""Corpus preparation: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept. What a stage decides takes effect: rejected documents go, one document of
each near-duplicate class stays, repeated windows are cut out of the texts,
documents that hold benchmark items go, and the rest is packed.

Defined results, for every stage
  An empty table gives an empty one. Null and empty texts are kept by all stages
  but the classifier, which scores them like any other text; packed, they are the
  end token alone. Columns of ``documents`` keep their values whatever their
  names, but text and n_chars where windows are cut. Rows without an id are
  neither near-duplicates nor cut. Rows that repeat an id are judged by their own
  texts; those that repeat the text too stay or go together. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import decontaminate, ngram_join, packing, quality, substring
from shelfcast.llm.common import read, stored
from shelfcast.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant accepts; it learns from the labelled ones."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates."""
    return ngram_join.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that a document with a smaller id has too.

    ``n_chars``, where there is one, follows the text; all other columns stay.
    """
    cut = substring.cut_texts(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequences."""
    return packing.pack(docs, tokenizer_path(), packing.Capacity(tokens=4096, documents=4096, cost=4096**2))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the hashed join and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
