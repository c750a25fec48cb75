"""The test tables as the engine's own: chunks, queries, judgments."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import StoredIndex, document_tokens, placed_postings
from ..shared import file_system, local_rows, new_folder

#: Queries are all vectors whose id is divisible by 50, against all rows.
EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("doc_id") % 4 == 0, "pkg/").when(F.col("doc_id") % 4 == 1, "docs/examples/").when(F.col("doc_id") % 4 == 2, ".worktrees/b/pkg/").otherwise(""), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, "_test.go").otherwise(".go"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("file_path"), "text", "source", "lang")


PATH_SQL = """CASE doc_id % 4 WHEN 0 THEN 'pkg/' WHEN 1 THEN 'docs/examples/' WHEN 2 THEN '.worktrees/b/pkg/' ELSE '' END || source || '/doc_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '_test.go' ELSE '.go' END"""

#: Literal queries of the text examples.
QUERIES = [
    "how does the authentication work", "error handling, logging, and metrics", "how is the", "rate-limit handler", "What is the Store interface?",
    "example usage of the client", "how to implement a parser", "what does this repo do", "show me the (config) loader", "CamelCase func_name 123abc",
    "ting", "the of", "", "x", "overview of the project", "The and attion to thanedble", "define struct fields", "process \"quoted\" words and: colons",
]


def literal_queries(spark: SparkSession) -> DataFrame:
    return local_rows(spark, {"query_id": (list(range(len(QUERIES))), pa.int64()), "query": (QUERIES, pa.string())})


_INDEXES: dict[tuple, StoredIndex] = {}


def kept_index(spark: SparkSession, sf_dir: str, name: str, tokens: Callable[[], DataFrame]) -> StoredIndex:
    """Kept postings of (id, tokens) made from `documents`. Written once for a session and a state of the table, then read."""
    fs, at = file_system(spark, f"{sf_dir}/documents.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, name, fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime())
    if key not in _INDEXES:
        made, path = tokens(), new_folder(spark, "text-index")
        placed_postings(made).repartitionByRange(F.col("term")).sortWithinPartitions("term").write.parquet(f"{path}/postings")
        made.select("id", F.size("tokens").cast("long").alias("dl")).write.parquet(f"{path}/lengths")
        _INDEXES[key] = StoredIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))
    return _INDEXES[key]


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer files than the cluster has cores, dealt to all of them."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def text_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The kept postings of `documents` (id: doc_id)."""
    return kept_index(spark, sf_dir, "documents", lambda: document_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", ["text"]))


QUERIES_SQL = "(SELECT CAST(query_id AS BIGINT) AS query_id, query FROM (VALUES " + ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in enumerate(QUERIES)) + ") AS t(query_id, query))"
