"""Late interaction: for each query term the best segment of a chunk, averaged over all terms; what isn't above 0 counts 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..functions import vector as V


def maxsim(terms: DataFrame, segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, chunk_id, maxsim). terms: (query_id, term_idx, term_vec); segments: (chunk_id, segment_idx, and segment_vec or
    emb_i8, scale, min); candidates: (query_id, chunk_id). Only the candidates' segments are joined."""
    score = V.dot(F.col("term_vec"), F.col("segment_vec")) if "segment_vec" in segments.columns else Q.mixed_dot(F.col("term_vec"), F.col("emb_i8"), F.col("scale"), F.col("min"))
    n_terms = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    pairs = candidates.join(segments, "chunk_id").join(terms, "query_id")
    best = pairs.withColumn("sim", score).groupBy("query_id", "chunk_id", "term_idx").agg(F.max("sim").alias("best"))
    return best.groupBy("query_id", "chunk_id").agg(F.sum(F.greatest("best", F.lit(0.0))).alias("total")).join(n_terms, "query_id").select("query_id", "chunk_id", (F.col("total") / F.col("n_terms")).alias("maxsim"))


def with_fallback(scored: DataFrame, candidates: DataFrame, make_segments, terms: DataFrame) -> DataFrame:
    """Candidates without stored segments are scored on segments made now by `make_segments`, from (chunk_id) rows; those that have none
    even then score 0."""
    missing = candidates.join(scored.select("chunk_id").distinct(), "chunk_id", "left_anti")
    made = maxsim(terms, make_segments(missing.select("chunk_id").distinct()), missing)
    none = missing.join(made, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit(0.0).alias("maxsim"))
    return scored.unionByName(made).unionByName(none)


def top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("maxsim").desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
