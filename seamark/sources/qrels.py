"""Retrieval benchmarks as tables: queries, corpus and judgments (query_id, doc_id, rel), and the corpora that a run may use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with a judgment above 0."""
    return queries.join(qrels.where("rel > 0").select("query_id").distinct(), "query_id", "left_semi")


def corpus(docs: DataFrame, qrels: DataFrame, mode: str = "fast", share: float = 0.1, seed: int = 42) -> DataFrame:
    """fast: only judged documents; full: all; sampled: a fixed share (by a hash with the seed) and all judged ones."""
    if mode == "full":
        return docs
    judged = qrels.where("rel > 0").select("doc_id").distinct()
    if mode == "fast":
        return docs.join(judged, "doc_id", "left_semi")
    if mode != "sampled":
        raise ValueError(f"unknown mode {mode}")
    picked = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    marked = docs.join(judged.withColumn("_judged", F.lit(True)), "doc_id", "left")
    return marked.where(picked | F.col("_judged")).drop("_judged")


def self_retrieval(docs: DataFrame, text: str = "text", least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) in which each text of more than `least` characters looks for its own document."""
    some = docs.where(F.length(text) > least)
    return some.select(F.col("doc_id").alias("query_id"), F.col(text).alias("query")), some.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(1).alias("rel"))
