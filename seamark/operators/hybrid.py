"""Distance and BM25 in one score. Semantic candidates lead: a document with only a lexical match is never a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVER, AT_LEAST = 5, 50


def candidates(limit: int) -> int:
    return max(OVER * limit, AT_LEAST)


def combine(semantic: DataFrame, lexical: DataFrame, limit: int, threshold: float, semantic_weight: float = 0.6, bm25_weight: float = 0.4, id_col: str = "id") -> DataFrame:
    """(query_id, id, distance, bm25, score, rank), lower is better; the threshold is on the distance, a missing BM25 is 0."""
    both = semantic.where(F.col("distance") <= threshold).join(lexical, ["query_id", id_col], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    scored = both.withColumn("score", semantic_weight * F.col("distance") + bm25_weight * F.col("bm25"))
    order = Window.partitionBy("query_id").orderBy("score", id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", id_col, "distance", "bm25", "score", "rank")
