"""The corpus pipeline: stages that each take the documents their predecessor kept. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontamination, mixing, near_duplicates, quality_classifier, queries, token_files, toxicity
from spanloom.llm.common import save, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier, trained on the labelled documents outside its held-out fold, rejects go.

    Null and empty texts are scored like any text; equal texts score alike, so repeated rows stay or go together; a score of just 0.5
    stays. Without labels of both kinds every score is the label's share, an empty table stays empty, and all columns are kept.
    """
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~toxicity.held_out(3, 1))
    return quality_classifier.keep_good(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each class of near duplicates stays: the one with the smallest doc_id, of several with that id the one with the smallest hash of its text.

    Null texts are no duplicates and all stay; equal texts, empty ones too, are one class; of repeated rows one stays.
    """
    return near_duplicates.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go. Null and empty texts hold none, null and empty items are in none; repeated rows go together; an empty benchmark removes nothing."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: sources are mixed to their targets; documents repeat as epochs do, and the one on a source's cut is shortened to the budget.

    Null and empty texts have no words and are not taken; a null source is a source of its own, the last; repeated rows count each.
    """
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the mixed corpus is written as token files in the order of doc_id and text; returned is what they hold. A null text has the end id only; repeated rows are encoded each."""
    return token_files.encode_and_read(docs, queries.tokenizer_path(), queries.END_ID)


STAGES = [("quality", quality), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("tokens", tokenize)]

#: The classifier, weighted sampling and the tokenizer have no SQL form; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
