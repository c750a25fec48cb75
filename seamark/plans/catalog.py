"""Registered queries over the test tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import eval_queries, text_queries, vector_queries

#: Positions, which SQL gives as BIGINT.
RANKS = ("rank", "rrf_rank", "longest")


def _with_wide_ranks(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: df[c].cast("long") for c in RANKS if c in df.columns})

    return run


_MODULES = [vector_queries, text_queries, eval_queries]
QUERIES = {name: _with_wide_ranks(f) for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "knn_exact"
