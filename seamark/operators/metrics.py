"""Metrics of ranked lists against graded judgments, for all queries at once.

Input rows are (keys..., rank, rel): rank from 1 within the keys, rel 0 where nothing is judged. `n_relevant` is the number of
judged results above 0 for the keys. One pass over the rows gives all metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import new_folder

#: Tokens that a result of a tool is estimated at.
PER_RESULT = 10


def gain(rel: Column) -> Column:
    return F.when(rel > 0, F.pow(F.lit(2.0), rel) - 1).otherwise(F.lit(0.0))


def discount(rank: Column) -> Column:
    return F.log2(rank + 1.0)


def per_query(rows: DataFrame, keys: list[str], ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """mrr, ap, diversity parts, and for each k: mrr_k, p_k (over min(k, n)), r_k, ap_k, dcg_k, ndcg_k (the ideal is the list itself, re-sorted)."""
    by = Window.partitionBy(*keys)
    hit = (F.col("rel") > 0).cast("int")
    marked = rows.withColumn("hits", F.sum(hit).over(by.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))).withColumn("ideal", F.row_number().over(by.orderBy(F.col("rel").desc(), F.col("rank"))))
    precision = F.when(F.col("rel") > 0, F.col("hits") / F.col("rank")).otherwise(F.lit(0.0))
    n, r = F.count("*"), F.max("n_relevant")
    of = lambda x: F.when(r > 0, x / r).otherwise(F.lit(0.0))
    first = F.min(F.when(F.col("rel") > 0, F.col("rank")))
    out = [F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"), of(F.sum(precision)).alias("ap"), n.alias("n_results")]
    for k in ks:
        top = F.col("rank") <= k
        dcg = F.sum(F.when(top, gain(F.col("rel")) / discount(F.col("rank"))).otherwise(F.lit(0.0)))
        ideal = F.sum(F.when(F.col("ideal") <= k, gain(F.col("rel")) / discount(F.col("ideal"))).otherwise(F.lit(0.0)))
        found = F.sum(F.when(top, hit).otherwise(0))
        out += [
            F.when(first <= k, 1.0 / first).otherwise(F.lit(0.0)).alias(f"mrr_{k}"),
            (found / F.least(n, F.lit(k))).alias(f"p_{k}"),
            of(found.cast("double")).alias(f"r_{k}"),
            of(F.sum(F.when(top, precision).otherwise(F.lit(0.0)))).alias(f"ap_{k}"),
            dcg.alias(f"dcg_{k}"),
            F.when(ideal > 0, dcg / ideal).otherwise(F.lit(0.0)).alias(f"ndcg_{k}"),
        ]
    return marked.groupBy(*keys).agg(*out)


def binary_variants(rows: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The usual definitions: ndcg with gain rel and the ideal of all judgments, precision over k, recall, mrr; any judged result counts."""
    top = F.col("rank") <= k
    rel = F.when(F.col("rel") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r = F.max("n_relevant")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(r, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    dcg = F.sum(F.when(top, rel / discount(F.col("rank"))).otherwise(F.lit(0.0)))
    found = F.sum(F.when(top, rel).otherwise(F.lit(0.0)))
    first = F.min(F.when(F.col("rel") > 0, F.col("rank")))
    return rows.groupBy(*keys).agg(F.when(r > 0, dcg / ideal).otherwise(F.lit(0.0)).alias("ndcg"), (found / k).alias("precision"), F.when(r > 0, found / r).otherwise(F.lit(0.0)).alias("recall"), F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def summary(scores: DataFrame, tool: str, means: list[str], sums: list[str] = ()) -> DataFrame:
    """Means (and sums) of per-query scores for each tool."""
    return scores.groupBy(tool).agg(F.count("*").alias("queries"), *[F.avg(c).alias(f"avg_{c}") for c in means], *[F.sum(c).alias(f"total_{c}") for c in sums])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def diversity(files: Column) -> Column:
    return F.when(F.size(files) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(files)) / F.size(files))


def compare(results: DataFrame, qrels: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(query_id, tool, returned, relevant, found, precision over what was returned, recall, tokens): tools side by side.

    results: (tool, query_id, file); qrels: (query_id, file, rel), of the returned files at least if `totals` (query_id, relevant) are
    given. Output is estimated at PER_RESULT tokens a result.
    """
    good = qrels.where("rel > 0").select("query_id", "file").distinct()
    totals = good.groupBy("query_id").agg(F.count("*").alias("relevant")) if totals is None else totals
    hits = results.select("tool", "query_id", "file").distinct().join(good.withColumn("hit", F.lit(1)), ["query_id", "file"], "left")
    out = hits.groupBy("query_id", "tool").agg(F.count("*").alias("returned"), F.count("hit").alias("found")).join(totals, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    precision = F.col("found") / F.col("returned")
    recall = F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")).otherwise(F.lit(0.0))
    return out.select("query_id", "tool", "returned", "relevant", "found", precision.alias("precision"), recall.alias("recall"), (F.col("returned") * PER_RESULT).alias("tokens"))


def run_dataset(dataset: DataFrame, results: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results by query and tool, summaries by tool) of a dataset that tools have answered.

    dataset: (query_id, query, file, rel) with a row for each judgment; results: (tool, query_id, file, rank); attempts: (tool, query_id,
    attempts), for tools that try one pattern after the other. Tokens: of the query, or of each attempt's command, and of the results.
    """
    judged = dataset.where("file is not null").select("query_id", F.element_at(F.split("file", "/"), -1).alias("base"), "rel").groupBy("query_id", "base").agg(F.max("rel").alias("rel"))
    totals = judged.where("rel > 0").groupBy("query_id").agg(F.count("*").cast("int").alias("n_relevant"))
    rows = results.withColumn("base", F.element_at(F.split("file", "/"), -1)).join(judged, ["query_id", "base"], "left").join(totals, "query_id", "left")
    rows = rows.select("tool", "query_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))
    queries = dataset.select("query_id", "query").distinct()
    asked = queries.join(attempts, "query_id", "left").withColumn("own", T.estimate_tokens(F.col("query")))
    command = T.estimate_tokens(F.lit("rg pattern"))
    m = per_query(rows, ["tool", "query_id"]).join(asked.select("tool", "query_id", F.col("attempts")), ["tool", "query_id"], "left").join(asked.select("query_id", "own").distinct(), "query_id")
    tokens = F.coalesce(F.col("attempts") * command, F.col("own")) + F.col("n_results") * PER_RESULT
    per = m.withColumn("tokens", tokens.cast("long")).drop("own", "attempts")
    return per, summary(per, "tool", ["mrr", "ap", "p_5", "r_5", "ndcg_5", "ndcg_10"], ["tokens"])


def overlap(results: DataFrame, a: str, b: str) -> DataFrame:
    """(query_id, overlap): files that two tools have in common for a query."""
    files = results.select("tool", "query_id", "file").distinct()
    left, right = files.where(F.col("tool") == a), files.where(F.col("tool") == b)
    return left.join(right.select("query_id", "file", F.lit(1).alias("hit")), ["query_id", "file"], "left").groupBy("query_id").agg(F.count("hit").alias("overlap"))


def ranked_in_groups(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, i, n): the place (from 0) of each value in the order of its group, and the group's size; nulls are left out.

    Rows are range-partitioned by group and value and written once in that order; counts of each part of a group give the places. So
    neither a group, however large, nor all groups meet in one task.
    """
    spark = rows.sparkSession
    path = new_folder(spark, "ranked")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = rows.select(F.col(by).alias("by"), F.col(value).alias("value")).where("value is not null")
    some.repartitionByRange(parts, "by", "value").sortWithinPartitions("by", "value").withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    ordered = spark.read.parquet(path).withColumn("part", F.shiftright("at", 33))
    counts = ordered.groupBy("by", "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))  # a group has a row for each of its parts
    w = Window.partitionBy("by")
    before = F.coalesce(F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).withColumn("n", F.sum("here").over(w)).select(F.col("by").alias("g"), F.col("part").alias("p"), "before", "first", "n")
    both = ordered.join(starts, F.col("by").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return both.select(F.col("by").alias(by), F.col("value").alias(value), (F.col("before") + F.col("at") - F.col("first")).alias("i"), "n")


def nearest_rank(rows: DataFrame, by: str, value: str) -> DataFrame:
    """p50 = sorted[n / 2] and p95 = sorted[min(int(0.95 n), n - 1)] of groups of 2 or more, by rank (no group is gathered)."""
    at = ranked_in_groups(rows, by, value)
    middle, high = F.floor(F.col("n") / 2), F.least(F.floor(F.col("n") * F.lit(0.95).cast("double")), F.col("n") - 1)
    some = at.where((F.col("n") >= 2) & ((F.col("i") == middle) | (F.col("i") == high)))
    pick = lambda i: F.max(F.when(F.col("i") == i, F.col(value)))
    return some.groupBy(by).agg(F.max("n").alias("n"), pick(middle).alias("p50"), pick(high).alias("p95"))


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): values at the shares of groups, between two ranks in proportion."""
    at = ranked_in_groups(rows, by, value)
    out, wanted = [], F.lit(False)
    for name, share in shares.items():
        place = (F.col("n") - 1) * F.lit(share).cast("double")
        low, high = F.floor(place), F.ceil(place)
        wanted = wanted | (F.col("i") == low) | (F.col("i") == high)
        a, z = F.max(F.when(F.col("i") == low, F.col(value))), F.max(F.when(F.col("i") == high, F.col(value)))
        out.append((a + (z - a) * F.max(place - low)).alias(name))
    return at.where(wanted).groupBy(by).agg(*out)


def stage_timing(rows: DataFrame, stage: str, value: str, total: str = "total") -> DataFrame:
    """Totals and means by stage, their share of the total stage (else of the sum), and which is the bottleneck (never the total)."""
    sums = rows.groupBy(stage).agg(F.sum(value).alias("total_time"), F.count("*").alias("n")).withColumn("avg_time", F.col("total_time") / F.col("n"))
    whole = sums.agg(F.coalesce(F.max(F.when(F.col(stage) == total, F.col("total_time"))), F.sum("total_time")).alias("whole"), F.max_by(stage, F.when(F.col(stage) != total, F.struct("total_time", stage))).alias("worst"))
    both = sums.join(F.broadcast(whole), F.lit(True))  # one row
    return both.select(stage, "total_time", "n", "avg_time", (F.col("total_time") / F.col("whole") * 100).alias("percent"), (F.col(stage) == F.col("worst")).alias("bottleneck"))
