"""A corpus pipeline of five stages: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of documents. `run` writes every stage's result as Parquet to the shared
folder and reads it again, so a lost executor costs a stage's tasks and no more.

Defined results: rows with a null doc_id can't be told apart by later joins, so the
duplicate and leak stages keep them; rows that share a doc_id stay or go together there; a document
that loses all its words to the passage stage goes; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm.common import dropped, table, written
from driftgrid.llm.decontamination import find_leaks
from driftgrid.llm.near_dedup import near_classes
from driftgrid.llm.packing import pack
from driftgrid.llm.quality_model import learn, score
from driftgrid.llm.substring_dedup import strip_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a score under 0.5 go."""
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.filter("score >= 0.5").select("row.*", "text").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near-duplicates (five-word shingles, 0.8) the least doc_id stays."""
    classes = near_classes(docs.select("doc_id", "text"), shingle=5, percent=80)
    gone = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: words of windows of 35 words found twice go, and documents of which nothing is left."""
    stripped = strip_repeats(docs).filter("n_words = 0 or n_removed < n_words")
    changed = stripped.select("row.*", F.col("kept").alias("text"), "n_removed")
    return changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item go."""
    leaks = find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: sequences of 4096 tokens with the sources in proportion."""
    import public_tokenizers

    return pack(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]
#: SQL has no boosted model, sketch or latent space; tests hold the stages against plain computations on their own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
