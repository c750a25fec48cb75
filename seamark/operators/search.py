"""The whole search for a table of queries: candidates, late interaction, cross-encoder, fusion, filters, dedup, limit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import dedup, fusion, hybrid, knn, lexical, maxsim, pooling


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    threshold: float = 0.65
    include_tests: bool = False
    deduplicate: bool = True
    boost_impl: float = 0.92
    use_hybrid: bool = False
    semantic_weight: float = 0.6
    bm25_weight: float = 0.4
    use_rerank: bool = False
    use_late: bool = False
    rerank_top_k: int = 30
    rerank_weight: float = 0.5
    late_weight: float = 0.3
    keep_fused_order: bool = False

    @property
    def fetched(self) -> int:
        """Candidates of a query before filters."""
        n = self.limit * (3 if self.include_tests else 5)
        return max(self.rerank_top_k, 3 * self.limit) if self.use_rerank or self.use_late else n


@dataclass
class Index:
    """chunks: (id, file_path, content, start_line, end_line, embedding, is_test); segments, files and postings where they are made.
    `make_segments`: segments for (chunk_id) rows that have none stored."""

    chunks: DataFrame
    segments: DataFrame | None = None
    files: DataFrame | None = None
    postings: lexical.StoredIndex | None = None
    make_segments: Callable[[DataFrame], DataFrame] | None = None

    def lexical(self) -> lexical.StoredIndex | lexical.TextIndex:
        return self.postings or lexical.TextIndex(lexical.document_tokens(self.chunks, "id", ["content", "file_path"]))


def candidates(queries: DataFrame, index: Index, opts: SearchOptions) -> DataFrame:
    """(query_id, id, distance): by file for questions about the repository where files are found, else hybrid or semantic."""
    n = opts.fetched
    semantic = knn.search(queries, index.chunks, hybrid.candidates(n) if opts.use_hybrid else n, opts.threshold)
    out = semantic.select("query_id", "id", "distance")
    if opts.use_hybrid:
        terms = queries.select("query_id", F.explode(T.bare_terms(F.col("query"))).alias("term"))
        scored = hybrid.combine(semantic, lexical.bm25(terms, index.lexical()), n, opts.threshold, opts.semantic_weight, opts.bm25_weight)
        out = scored.select("query_id", "id", F.col("score").alias("distance"))
    if index.files is not None:
        meta = queries.where(T.is_meta_query(F.col("query")))
        found = knn.exact(meta, index.files, n, opts.threshold, row=("file_path", "embedding"))
        by_file = pooling.first_chunks(found, index.chunks.drop("embedding"), n).select("query_id", "id", "distance")
        out = out.join(by_file.select("query_id").distinct(), "query_id", "left_anti").unionByName(by_file)
    return out


def search(queries: DataFrame, index: Index, opts: SearchOptions = SearchOptions(), terms: DataFrame | None = None, reranker=None) -> DataFrame:
    """Results (query_id, rank, file, start, end, score, content, is_test) for queries (query_id, query, embedding), lower scores better.

    `terms` (query_id, term_idx, term_vec) are needed for late interaction, a reranker with `score` for the cross-encoder.
    """
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    rows = candidates(queries, index, opts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= opts.fetched)
    # Contents are joined to what is left at the end, and to the few rows that the cross-encoder reads.
    rows = rows.join(index.chunks.select("id", "file_path", "start_line", "end_line", "is_test"), "id").join(queries.select("query_id", "query"), "query_id")
    late = opts.use_late and terms is not None and index.segments is not None
    cross = opts.use_rerank and reranker is not None
    if late or cross:
        rows = rows.withColumn("maxsim", F.lit(None).cast("double")).withColumn("logit", F.lit(None).cast("double"))
        if late:
            some = rows.where(F.col("rank") <= fusion.LATE_CANDIDATES).select("query_id", F.col("id").alias("chunk_id"))
            scored = maxsim.maxsim(terms, index.segments, some)
            if index.make_segments:
                scored = maxsim.with_fallback(scored, some, index.make_segments, terms)
            scored = scored.withColumnRenamed("chunk_id", "id")
            rows = rows.drop("maxsim").join(scored, ["query_id", "id"], "left")
        if cross:
            by = Window.partitionBy("query_id").orderBy(F.col("maxsim").desc_nulls_last() if late else F.col("rank"), F.col("rank"))
            top = rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= fusion.CROSS_CANDIDATES)
            read = top.select("query_id", "id", "query").join(index.chunks.select("id", "content"), "id").select("query_id", "id", "query", "content")
            logits = reranker.score(read).select("query_id", "id", "logit")
            rows = rows.drop("logit").join(logits, ["query_id", "id"], "left")
        rows = fusion.fuse(rows, opts.use_hybrid, cross, late, opts.limit, opts.keep_fused_order, opts.rerank_weight, opts.late_weight)
        rows = rows.withColumn("score", F.col("final_order"))
    else:
        rows = rows.withColumn("score", F.col("distance"))
    if not opts.include_tests:
        rows = rows.where(~F.col("is_test"))
    if not opts.use_hybrid and 0 < opts.boost_impl < 1:
        rows = rows.withColumn("score", F.when(F.col("is_test"), F.col("score")).otherwise(F.col("score") * opts.boost_impl))
    if opts.deduplicate:
        rows = dedup.dedup_intervals(rows)
    final = Window.partitionBy("query_id").orderBy("score", "id")
    out = rows.select("query_id", "id", "file_path", "start_line", "end_line", "score").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= opts.limit)
    out = out.join(index.chunks.select("id", "content", "is_test"), "id")
    return out.select("query_id", "rank", F.col("file_path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), "score", "content", "is_test")
