"""Results whose line ranges overlap in one file, also across worktree copies, collapse to the best one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

_KEPT = "array<struct<score:double,wt:boolean,id:string,file_path:string,start_line:int,end_line:int>>"


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """More than half of either range of lines (ends included) is shared."""
    shared = F.least(e1, e2) - F.greatest(s1, s2) + 1
    return (shared > 0) & ((shared / (e1 - s1 + 1) > 0.5) | (shared / (e2 - s2 + 1) > 0.5))


def dedup_intervals(results: DataFrame) -> DataFrame:
    """Rows of (query_id, id, file_path, start_line, end_line, score) that stay; lower scores are better.

    Within a query and canonical path rows are taken in order of score, plain copies before worktree copies, then id. A row stays if
    it overlaps no row that stayed and, in a worktree, if no plain copy stayed. The rows of one query and file are few: they are
    some of a query's results.
    """
    row = F.struct(F.col("score").cast("double").alias("score"), P.is_worktree(F.col("file_path")).alias("wt"), F.col("id").cast("string").alias("id"), "file_path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))
    groups = results.groupBy("query_id", P.canonical_path(F.col("file_path")).alias("canonical")).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def step(kept: Column, x: Column) -> Column:
        hit = F.exists(kept, lambda k: overlaps(k["start_line"], k["end_line"], x["start_line"], x["end_line"]))
        shadowed = x["wt"] & F.exists(kept, lambda k: ~k["wt"])
        return F.when(hit | shadowed, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("rows", F.array().cast(_KEPT), step)
    return groups.select("query_id", "canonical", F.explode(kept).alias("r")).select("query_id", "canonical", "r.id", "r.file_path", "r.start_line", "r.end_line", "r.score")
