"""Weighted reciprocal-rank fusion of vector, cross-encoder and late-interaction signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

RRF_K = 60.0
#: Candidates that late interaction and the cross-encoder look at.
LATE_CANDIDATES, CROSS_CANDIDATES = 50, 20


#: Fixed values, by (hybrid, rerank, late): raw weights of vector, cross-encoder and late interaction.
#: None is the option's own weight; what is left of 1 goes to the vector.
RAW = {
    (False, False, False): (0.4, None, None),
    (True, False, False): (0.4, None, None),
    (False, False, True): (0.5, 0.0, 0.5),
    (True, False, True): (0.75, 0.0, 0.25),
    (False, True, False): (None, None, 0.0),
    (True, True, False): (0.75, 0.25, 0.0),
    (False, True, True): (0.3, 0.4, 0.3),
    (True, True, True): (0.70, 0.05, 0.25),
}
#: Fixed values, by intent: which weight moves, when (if the signal is there; `alone`: if the cross-encoder isn't), by how much, and
#: its bound. The rules cap the vector at 0.6 and lift the cross-encoder to 0.2; both are kept as they are.
SEEKING = (("vector", "always", 0.1, 0.6), ("cross", "rerank", -0.05, 0.2), ("late", "alone", 0.2, 0.5))
MOVES = {"conceptual": SEEKING, "definition": SEEKING, "procedural": (), "example": (("late", "late", 0.1, 0.5), ("cross", "rerank", 0.1, 0.5))}
#: An option's weight where it is 0.
DEFAULTS = {"cross": 0.5, "late": 0.3}


def weights(intent: str, hybrid: bool, rerank: bool, late: bool, rerank_weight: float = 0.5, late_weight: float = 0.3) -> tuple[float, float, float]:
    """(vector, cross-encoder, late interaction), which sum to 1."""
    own = {"cross": rerank_weight or DEFAULTS["cross"], "late": late_weight or DEFAULTS["late"]}
    w = dict(zip(("vector", "cross", "late"), RAW[hybrid, rerank, late], strict=True))
    w |= {k: v for k, v in own.items() if w[k] is None}
    w["vector"] = 1.0 - w["cross"] if w["vector"] is None else w["vector"]
    holds = {"always": True, "rerank": rerank, "late": late, "alone": late and not rerank}
    for name, when, by, bound in MOVES.get(intent, ()):
        if holds[when]:
            w[name] = (max if by < 0 else min)(w[name] + by, bound)
    total = sum(w.values())
    return w["vector"] / total, w["cross"] / total, w["late"] / total


def weight_columns(intent: Column, hybrid: bool, rerank: bool, late: bool, rerank_weight: float = 0.5, late_weight: float = 0.3) -> list[Column]:
    out = []
    for i in range(3):
        c = None
        for name in ("conceptual", "definition", "procedural", "example"):
            value = F.lit(weights(name, hybrid, rerank, late, rerank_weight, late_weight)[i])
            c = F.when(intent == name, value) if c is None else c.when(intent == name, value)
        out.append(c)
    return out


def fuse(rows: DataFrame, hybrid: bool, rerank: bool, late: bool, limit: int | None = None, keep_order: bool = False, rerank_weight: float = 0.5, late_weight: float = 0.3) -> DataFrame:
    """Adds boost, rrf and rrf_rank to rows of (query_id, id, query, file_path, rank, logit, maxsim), and keeps `limit` of each query.

    A missing logit or maxsim adds nothing. Unless `keep_order`, what follows sorts by distance again: fusion decides who stays.
    """
    intent = T.intent(F.col("query"))
    wv, wr, wc = weight_columns(intent, hybrid, rerank, late, rerank_weight, late_weight)
    vector = 1.0 / (RRF_K + F.col("rank"))
    cross = F.coalesce(1.0 / (RRF_K + (1.0 - T.sigmoid(F.col("logit"))) * 100.0 + 1.0), F.lit(0.0))
    inner = F.coalesce(1.0 / (RRF_K + (1.0 - F.col("maxsim")) * 50.0 + 1.0), F.lit(0.0))
    out = rows.withColumn("boost", P.path_boost(F.col("file_path"), intent)).withColumn("rrf", (wv * vector + wr * cross + wc * inner) * F.col("boost"))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.col("rank"))
    out = out.withColumn("rrf_rank", F.row_number().over(order))
    out = out if limit is None else out.where(F.col("rrf_rank") <= limit)
    return out.withColumn("final_order", F.col("rrf_rank").cast("double") if keep_order else F.col("distance"))
