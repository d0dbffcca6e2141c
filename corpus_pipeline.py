"""Corpus pipeline: five stages over documents, each working on what the one before kept.

All stages decide by row: a row goes for what its own text is, whatever other rows with its doc_id hold, and rows without
doc_id go through all of them. Extra columns stay, whatever their names; very long texts are worked on whole. An empty
table gives an empty result, and empty labels or an empty benchmark reject nothing.

Stages that run Python have the session give workers small Arrow batches (`small_batches`), and it stays so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstone.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from inkstone.llm.common import load, small_batches, staged
from inkstone.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not flag; it is fitted on the labelled rows among docs. Null texts count as empty,
    null languages take the general threshold; rows that repeat are each judged by their own text."""
    small_batches(spark)
    return toxicity.reject_toxic(docs, load(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts (null equals empty), that with the smallest doc_id. Rows that repeat this doc_id with
    the same text all stay, as do rows without doc_id whose text no row with one has."""
    return exact_dedup.exact_dedup(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group linked by a similarity of 0.8 over five-word shingles, that with the smallest doc_id. Five words are
    what stages take by rule; the query of the operator takes two, finds more edited copies, and would here as well.
    Texts without words and rows without doc_id stay."""
    small_batches(spark)
    return near_dedup.near_dedup(docs, words=5, similarity=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window of ten words (or a whole shorter item). Texts without words stay."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, along the curve. Every row is packed, null texts as empty ones; ties on the curve go by
    doc_id, then by ids."""
    small_batches(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
