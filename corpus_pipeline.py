"""The corpus pipeline: five stages over `documents`, each an operator of seamark.llm on all that the stage before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of
documents. `run` writes each stage as Parquet in the shared folder and reads it again as the next one's docs; what a stage wrote for
itself is deleted when it has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamark.llm.bestfit_pack import pack_documents
from seamark.llm.common import kept, read_table, scratch
from seamark.llm.fm_decontam import keep_clean
from seamark.llm.near_dedup import keep_one
from seamark.llm.quality_rank import keep_good
from seamark.llm.secret_ledger import SecretLedger


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. The model is fitted on the labelled rows of what is given.

    Null and empty texts are scored as empty; a null doc_id is never learnt from; repeated rows are scored each; without both
    labels all stay; an empty table gives no rows; other columns stay, whatever their names.
    """
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by sets of five words from 80 % on, the document with the least doc_id stays.

    Null, empty and blank texts are alike with nothing and stay; rows that repeat a doc_id stay or go together; a null doc_id stays;
    an empty table gives no rows; other columns stay, whatever their names.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go.

    Null and empty texts have no words and stay; rows with equal texts stay or go together, whatever their doc_id; an empty
    benchmark or table changes nothing; other columns stay, whatever their names.
    """
    return keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows; all documents stay.

    Null texts stay null, empty ones empty; repeated rows are changed alike; an empty table gives no rows; other columns stay,
    whatever their names.
    """
    return SecretLedger(spark).redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place.

    A null text is empty, a piece of the end id alone; null doc_ids and repeated rows are packed each; an empty table gives no
    rows; other columns are ignored.
    """
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL has neither the classifier nor the tokenizer; the pipeline's test compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
