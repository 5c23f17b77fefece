"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the
last return the columns of docs as they were, also those whose names the operators use themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verispark.llm._common import fold_of, new_path
from verispark.llm.best_fit_packing import pack_documents
from verispark.llm.decontamination import decontaminate
from verispark.llm.exact_dedup import drop_exact_copies
from verispark.llm.language_id import keep_identified, learn_profiles
from verispark.llm.simhash_dedup import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null and empty texts and those without letters go; a text with letters stays, however long it
    is and even if no profile shares an n-gram with it; where profiles tie the language is the
    smallest, which decides nothing here; repeated rows stay or go together; without a row that has
    a language nothing can be told and all rows go; an empty table stays empty.
    """
    return keep_identified(docs, learn_profiles(docs.where(fold_of("doc_id", 4) != 2)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text.

    Null counts as the empty text, and all empty texts are equal; the text with the most code
    points stays, of ties the smallest id, a null id last; rows that repeat id and text are copies;
    a very long text is one key like any other; an empty table stays empty.
    """
    return drop_exact_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component.

    Null and empty texts have fingerprint zero and are one component; the smallest id stays, a null
    id after all others, of one id the row with the smallest fingerprint and text hash; repeated
    rows are copies; a very long text is hashed in slices; an empty table stays empty.
    """
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts have no words and stay; long texts are scanned whole; a window that several
    items share counts like any other; repeated rows stay or go together; an empty benchmark keeps
    all rows and an empty table stays empty.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences, with columns of its own.

    Null and empty texts are the end id alone; long texts are cut; pieces that tie go in order of
    id, piece and checksum; repeated rows are packed each; an empty table has no pieces.
    """
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the tokenizer or the fingerprints' components; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
