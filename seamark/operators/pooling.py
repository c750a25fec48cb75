"""File vectors: means of chunk vectors, and searches at the level of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V


def mean_vectors(chunks: DataFrame, by: str, vec: str, end_line: Column | None = None) -> DataFrame:
    """(by, embedding, chunk_count, total_lines): the unit mean vector; total_lines is the largest end line.

    Elements are summed per position with map-side partial sums, so a file of any number of chunks is no group in one task.
    """
    some = chunks.where(F.col(vec).isNotNull())
    sums = some.select(by, F.posexplode(vec).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"].cast("float")).alias("mean"))
    counts = some.groupBy(by).agg(F.count("*").alias("chunk_count"), F.max(F.lit(None).cast("int") if end_line is None else end_line).alias("total_lines"))
    return mean.join(counts, by).select(by, V.normalise(F.col("mean")).alias("embedding"), "chunk_count", "total_lines")


def first_chunks(files: DataFrame, chunks: DataFrame, limit: int, each: int = 2, readme: int = 3) -> DataFrame:
    """Chunks of ranked files (query_id, file_path, distance, rank): the first few of each, while fewer than 2 * limit came before."""
    n = F.when(F.lower("file_path").endswith("readme.md"), F.lit(readme)).otherwise(F.lit(each))
    picked = files.join(chunks, "file_path").withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy("start_line", "id"))).where(F.col("nth") <= n)
    before = F.coalesce(F.sum(F.lit(1)).over(Window.partitionBy("query_id").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return picked.withColumn("before", before).where(F.col("before") < 2 * limit).drop("before")
