"""Registered queries: evaluation of ranked lists, timing, result parsing, storage and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import knn, metrics
from ..sources import qrels as C
from ..sources import results as R
from ..shared import new_folder
from ..sources import store as S
from ..streaming import watch
from .tables import PATH_SQL, documents, query_vectors, table, vectors
from .vector_queries import _COS, _Q, r6


def _ranked_rels(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, rank, rel, n_relevant): neighbours judged by label (1) and, of good documents, 2; the query itself is not judged."""
    near = knn.exact(query_vectors(spark, sf), vectors(spark, sf).select("id", "embedding"), 10)
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(1).alias("good"))
    rows = vectors(spark, sf).select("id", "label")
    judged = rows.join(good, "id", "left")
    q = query_vectors(spark, sf).select("query_id", F.col("label").alias("ql"))
    totals = _relevant(q, rows, True)
    rel = F.when((F.col("id") != F.col("query_id")) & (F.col("label") == F.col("ql")), 1 + F.coalesce("good", F.lit(0))).otherwise(0)
    return near.join(judged, "id").join(q, "query_id").join(totals, "query_id", "left").select("query_id", "rank", rel.cast("int").alias("rel"), F.coalesce("n_relevant", F.lit(0)).cast("int").alias("n_relevant"), "label")


def _relevant(q: DataFrame, rows: DataFrame, others_only: bool) -> DataFrame:
    """(query_id, n_relevant): rows of a query's label, counted by label first; without those of the query's own id if `others_only`."""
    counts = rows.groupBy(F.col("label").alias("ql")).agg(F.count("*").alias("n"))
    out = q.join(counts, "ql")
    if others_only:
        own = rows.groupBy(F.col("id").alias("query_id"), F.col("label").alias("ql")).agg(F.count("*").alias("own"))
        out = out.join(own, ["query_id", "ql"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0)))
    return out.select("query_id", F.col("n").alias("n_relevant"))


_RELS = f"""{_Q}, d AS (SELECT query_id, ql, vec_id AS id, label, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d),
tot AS (SELECT query_id, count(*) FILTER (vec_id <> query_id AND label = ql) AS n_relevant FROM q, embeddings GROUP BY query_id),
rels AS (SELECT c.query_id, rank, label, CASE WHEN id <> c.query_id AND label = ql THEN 1 + CASE WHEN quality = 1 THEN 1 ELSE 0 END ELSE 0 END AS rel, n_relevant FROM c JOIN tot ON tot.query_id = c.query_id LEFT JOIN labels ON doc_id = id WHERE rank <= 10)"""


def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.per_query(_ranked_rels(spark, sf), ["query_id"])
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("mrr", "ap", "mrr_5", "p_5", "r_5", "ap_5", "dcg_5", "ndcg_5", "p_10", "r_10", "ap_10", "dcg_10", "ndcg_10")])


def _metric_sql(k: int) -> str:
    return f"""round(coalesce(CASE WHEN min(rank) FILTER (rel > 0) <= {k} THEN 1.0 / min(rank) FILTER (rel > 0) END, 0), 6) AS mrr_{k}, round(count(*) FILTER (rel > 0 AND rank <= {k}) / least(count(*), {k}), 6) AS p_{k},
 round(CASE WHEN max(n_relevant) > 0 THEN count(*) FILTER (rel > 0 AND rank <= {k}) / max(n_relevant) ELSE 0 END, 6) AS r_{k}, round(CASE WHEN max(n_relevant) > 0 THEN coalesce(sum(hits / rank) FILTER (rel > 0 AND rank <= {k}), 0) / max(n_relevant) ELSE 0 END, 6) AS ap_{k},
 round(coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= {k}), 0), 6) AS dcg_{k}, round(CASE WHEN sum(gain / log2(ideal + 1)) FILTER (ideal <= {k}) > 0 THEN sum(gain / log2(rank + 1)) FILTER (rank <= {k}) / sum(gain / log2(ideal + 1)) FILTER (ideal <= {k}) ELSE 0 END, 6) AS ndcg_{k}"""


_MARKED = """h AS (SELECT *, count(*) FILTER (rel > 0) OVER (PARTITION BY query_id ORDER BY rank) AS hits, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal, CASE WHEN rel > 0 THEN pow(2, rel) - 1 ELSE 0 END AS gain FROM rels)"""
_PER_QUERY = f"""SELECT query_id, CAST(round(coalesce(1.0 / min(rank) FILTER (rel > 0), 0), 6) AS DOUBLE) AS mrr, CAST(round(CASE WHEN max(n_relevant) > 0 THEN coalesce(sum(hits / rank) FILTER (rel > 0), 0) / max(n_relevant) ELSE 0 END, 6) AS DOUBLE) AS ap,
 CAST(NULL AS INTEGER) AS unused, {_metric_sql(5)}, {_metric_sql(10)} FROM h GROUP BY query_id"""
IR_METRICS = f"WITH {_RELS}, {_MARKED}, m AS ({_PER_QUERY}) SELECT query_id, mrr, ap, CAST(mrr_5 AS DOUBLE) AS mrr_5, p_5, CAST(r_5 AS DOUBLE) AS r_5, CAST(ap_5 AS DOUBLE) AS ap_5, CAST(dcg_5 AS DOUBLE) AS dcg_5, CAST(ndcg_5 AS DOUBLE) AS ndcg_5, p_10, CAST(r_10 AS DOUBLE) AS r_10, CAST(ap_10 AS DOUBLE) AS ap_10, CAST(dcg_10 AS DOUBLE) AS dcg_10, CAST(ndcg_10 AS DOUBLE) AS ndcg_10 FROM m"


def ir_binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.binary_variants(_ranked_rels(spark, sf), ["query_id"], 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("ndcg", "precision", "recall", "mrr")], F.round(metrics.f1(F.col("precision"), F.col("recall")), 6).alias("f1"))


IR_BINARY = f"""WITH {_RELS}, m AS (SELECT query_id, coalesce(sum(1 / log2(rank + 1)) FILTER (rel > 0), 0) AS dcg, list_sum(list_transform(range(1, CAST(greatest(least(max(n_relevant), 10), 1) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ideal, count(*) FILTER (rel > 0) / 10 AS p,
 CASE WHEN max(n_relevant) > 0 THEN count(*) FILTER (rel > 0) / max(n_relevant) ELSE 0 END AS r, coalesce(1.0 / min(rank) FILTER (rel > 0), 0) AS mrr, max(n_relevant) AS n FROM rels GROUP BY query_id)
SELECT query_id, CAST(round(CASE WHEN n > 0 THEN dcg / ideal ELSE 0 END, 6) AS DOUBLE) AS ndcg, round(p, 6) AS precision, CAST(round(r, 6) AS DOUBLE) AS recall, CAST(round(mrr, 6) AS DOUBLE) AS mrr, CAST(round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS DOUBLE) AS f1 FROM m"""


def tool_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.per_query(_ranked_rels(spark, sf), ["query_id"]).withColumn("tool", F.when(F.col("query_id") % 100 == 0, "a").otherwise("b")).withColumn("tokens", F.col("query_id") + 10)
    s = metrics.summary(m, "tool", ["mrr", "ap", "p_5", "ndcg_10"], ["tokens"])
    return s.select("tool", "queries", "total_tokens", *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in ("mrr", "ap", "p_5", "ndcg_10")])


TOOL_SUMMARY = f"""WITH {_RELS}, {_MARKED}, m AS ({_PER_QUERY.replace('round(', '(').replace(', 6)', ')')})
SELECT CASE WHEN query_id % 100 = 0 THEN 'a' ELSE 'b' END AS tool, count(*) AS queries, CAST(sum(query_id + 10) AS BIGINT) AS total_tokens, round(avg(mrr), 6) AS avg_mrr, round(avg(ap), 6) AS avg_ap, round(avg(p_5), 6) AS avg_p_5, round(avg(ndcg_10), 6) AS avg_ndcg_10 FROM m GROUP BY 1"""


def jaccard_diversity(spark: SparkSession, sf: str) -> DataFrame:
    lists = _ranked_rels(spark, sf).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("files"))
    half = lists.select("query_id", "files", F.slice("files", 1, 5).alias("a"), F.slice("files", 4, 5).alias("b"))
    return half.select("query_id", F.round(metrics.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(metrics.diversity(F.col("files")), 6).alias("diversity"))


JACCARD = f"""WITH {_RELS}, l AS (SELECT query_id, list(label ORDER BY rank) AS f FROM rels GROUP BY query_id)
SELECT query_id, round(len(list_intersect(list_distinct(f[1:5]), list_distinct(f[4:8]))) / len(list_distinct(list_concat(f[1:5], f[4:8]))), 6) AS jaccard, round(len(list_distinct(f)) / len(f), 6) AS diversity FROM l"""


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    means = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    parts = metrics.quantiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return means.join(parts, "event_type").select("event_type", "n", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


LATENCY = "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"


def nearest_rank_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf, "events"), "event_type", "value")


NEAREST_RANK = """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, max(value) FILTER (i = n // 2) AS p50, max(value) FILTER (i = least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1)) AS p95 FROM s WHERE n >= 2 GROUP BY event_type, n"""


def stage_timing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", F.col("event_id").alias("ns"))
    t = metrics.stage_timing(rows, "event_type", "ns")
    return t.select("event_type", "total_time", "n", F.round("avg_time", 6).alias("avg_time"), F.round("percent", 6).alias("percent"), "bottleneck")


STAGE_TIMING = """WITH s AS (SELECT event_type, CAST(sum(event_id) AS BIGINT) AS total_time, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, total_time, n, round(total_time / n, 6) AS avg_time, round(total_time / sum(total_time) OVER () * 100, 6) AS percent, row_number() OVER (ORDER BY total_time DESC, event_type DESC) = 1 AS bottleneck FROM s"""


def token_savings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", T.estimate_tokens(F.col("text")).alias("theirs"), F.least(T.estimate_tokens(F.col("text")), F.lit(300)).alias("ours"))
    g = d.groupBy("source").agg(F.sum("theirs").alias("theirs"), F.sum("ours").alias("ours"), F.sum((F.col("ours") < F.col("theirs")).cast("int")).alias("wins"))
    return g.select("source", "wins", F.round((F.col("theirs") - F.col("ours")) / F.col("theirs") * 100, 6).alias("saved"))


TOKEN_SAVINGS = """WITH d AS (SELECT source, greatest(strlen(text) // 4, CAST(floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * CAST(1.3 AS DOUBLE)) AS BIGINT)) AS t FROM documents)
SELECT source, CAST(sum(CASE WHEN t > 300 THEN 1 ELSE 0 END) AS BIGINT) AS wins, round((sum(t) - sum(least(t, 300))) / sum(t) * 100, 6) AS saved FROM d GROUP BY source"""


def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    line = F.when(F.col("doc_id") % 3 == 0, F.concat("file_path", F.lit(":10-20"))).when(F.col("doc_id") % 3 == 1, F.concat("file_path", F.lit(":123: some: content"))).otherwise(F.concat(F.lit("C:\\x\\"), "file_path", F.lit(":7-9")))
    rows = d.select(F.pmod(F.col("doc_id"), F.lit(7)).alias("query_id"), F.col("doc_id").alias("line_no"), F.concat(F.lit("\x1b[32m"), F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(line, r"doc_\d+", "doc_x")).otherwise(line), F.lit("\x1b[0m")).alias("line"))
    return R.parse_lines(rows)


RESULT_LINES = f"""WITH d AS (SELECT doc_id, {PATH_SQL} AS p FROM documents), f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'C:\\x\\' || p ELSE p END AS p FROM d), g AS (SELECT doc_id % 7 AS query_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(p, 'doc_\\d+', 'doc_x') ELSE p END AS file FROM f),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, string_split(file, '/')[-1] ORDER BY doc_id) AS n FROM g)
SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM u WHERE n = 1"""


def result_ranges(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(R.line_range(F.col("text"), F.lit(2), F.lit(3)), 256).alias("part"), R.sanitise_id(F.concat_ws("/", "source", "lang")).alias("safe_id"), F.size(S.context_lines(F.col("text"))).alias("shown"), F.sha2(F.array_join(S.context_lines(F.col("text"), 2), "\n"), 256).alias("context"))


RESULT_RANGES = """WITH s AS (SELECT *, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, sha256(array_to_string(l[2:3], chr(10))) AS part, regexp_replace(source || '/' || lang, '[^A-Za-z0-9_-]', '_', 'g') AS safe_id, CAST(least(len(l), 5) AS INTEGER) AS shown,
 sha256(array_to_string(list_transform(l[1:2], lambda x: CASE WHEN strlen(x) > 80 THEN x[1:77] || '...' ELSE x END), chr(10))) AS context FROM s"""


def grep_baseline(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    patterns = b.select(F.col("item_id").alias("query_id"), F.posexplode(T.pattern_words(F.col("text"))).alias("ord", "pattern"))
    files = table(spark, sf, "documents").select(F.format_string("%08d", "doc_id").alias("file_path"), F.col("text").alias("content"))
    return R.grep(files, patterns, 10).drop("ord")


GREP = """WITH w AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(text, '[ ?.,;]+'), lambda w: strlen(w) >= 3) AS w FROM benchmark), p AS (SELECT query_id, i AS ord, w[i] AS pattern FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
h AS (SELECT query_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS file_path, min(ord) AS ord FROM p JOIN documents ON regexp_matches(text, pattern) GROUP BY query_id, doc_id),
b AS (SELECT *, coalesce(sum(1) OVER (PARTITION BY query_id ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, file_path) AS rank FROM b WHERE before < 10)
SELECT query_id, file_path, rank FROM r WHERE rank <= 10"""


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).join(vectors(spark, sf).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return d.agg(F.countDistinct("source").alias("files"), F.count("*").alias("chunks"), F.count("embedding").alias("vectors"), F.count_if(P.is_test_file(F.col("file_path"))).alias("tests"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


INDEX_STATS = f"""WITH d AS (SELECT *, {PATH_SQL} AS p FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
SELECT count(DISTINCT source) AS files, count(*) AS chunks, count(embedding) AS vectors, count(*) FILTER ({" OR ".join(f"ends_with(lower(p), '{x}')" for x in P.TEST_SUFFIXES)}) AS tests, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM d"""


def upsert_delete(spark: SparkSession, sf: str) -> DataFrame:
    """What a store holds after new versions of every tenth document took the place of old ones and every seventh source was deleted."""
    d = table(spark, sf, "documents")

    def chunks(rows: DataFrame, text: Column) -> DataFrame:
        v = F.array(F.lit(1.0), F.col("doc_id").cast("double")).cast("array<float>")
        path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
        return rows.select(F.col("doc_id").cast("string").alias("id"), path.alias("file_path"), text.alias("content"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), v.alias("embedding"), F.create_map(F.lit("source"), "source").alias("metadata"), F.lit(False).alias("is_test"))

    store = S.Store(spark, new_folder(spark, "store"))
    store.upsert_chunks(chunks(d, F.col("text")))
    store.upsert_chunks(chunks(d.where("doc_id % 10 = 0"), F.concat(F.repeat(F.lit("+"), 1000), "text")))
    store.delete_files(chunks(d.where("cast(substring(source, 4) as int) % 7 = 0"), F.col("text")).select("file_path"))
    left = store.read("chunks")
    lengths = store.read("lengths").select("id", "dl")
    files = store.read("files").select("file_path", "chunk_count")
    both = left.join(lengths, "id").join(files, "file_path")  # whatever belongs to a chunk is there with it
    return both.select(F.col("id").cast("long").alias("doc_id"), F.col("metadata")["source"].alias("source"), F.length("content").alias("n"))


UPSERT_DELETE = "SELECT doc_id, source, CAST(length(text) + CASE WHEN doc_id % 10 = 0 THEN 1000 ELSE 0 END AS INTEGER) AS n FROM documents WHERE CAST(source[4:] AS INTEGER) % 7 <> 0"


def paged_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.page(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 32, 32)


PAGED = "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 32 OFFSET 32"


def ids_to_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked ids with their documents; ids without one drop out; ranks by competition (1 + how many are greater)."""
    near = knn.exact(query_vectors(spark, sf), vectors(spark, sf).select((F.col("id") + 3).alias("id"), "embedding"), 5)
    docs = S.by_ids(near, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n")))
    return docs.select("query_id", "id", "rank", "n", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("n").desc())).alias("longest"))


IDS_TO_DOCS = f"""WITH {_Q}, d AS (SELECT query_id, vec_id + 3 AS id, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d)
SELECT query_id, id, rank, CAST(length(text) AS INTEGER) AS n, rank() OVER (PARTITION BY query_id ORDER BY length(text) DESC) AS longest FROM c JOIN documents ON doc_id = id WHERE rank <= 5"""


def semi_anti_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Judged documents, those without a judgment, a fixed sample with all judged, and what is in one set only, by language."""
    d, labels = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id")
    judged, other = d.join(labels, "doc_id", "left_semi"), d.join(labels, "doc_id", "left_anti")
    sample = d.where("doc_id % 11 = 0").union(judged).distinct()
    only = sample.exceptAll(judged)
    both = d.where("doc_id % 11 = 0").intersect(judged)
    parts = [x.groupBy("lang").agg(F.count("*").alias("n")).withColumn("part", F.lit(p)) for p, x in (("judged", judged), ("other", other), ("sample", sample), ("only", only), ("both", both))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SEMI_ANTI = """WITH j AS (SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), s AS (SELECT doc_id, lang FROM documents WHERE doc_id % 11 = 0)
SELECT lang, count(*) AS n, 'judged' AS part FROM j GROUP BY lang UNION ALL SELECT lang, count(*), 'other' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang
UNION ALL SELECT lang, count(*), 'sample' FROM (SELECT * FROM s UNION SELECT * FROM j) GROUP BY lang UNION ALL SELECT lang, count(*), 'only' FROM (SELECT * FROM s EXCEPT SELECT * FROM j) GROUP BY lang
UNION ALL SELECT lang, count(*), 'both' FROM (SELECT * FROM s INTERSECT SELECT * FROM j) GROUP BY lang"""


def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = watch.debounced(table(spark, sf, "events"), "user_id", "ts", "6 hours")
    return e.select("user_id", F.unix_micros(F.col("first").cast("timestamp")).alias("first"), F.unix_micros(F.col("last").cast("timestamp")).alias("last"), "n")


DEBOUNCE = """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM s) SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM g GROUP BY user_id, grp"""


def watched_changes(spark: SparkSession, sf: str) -> DataFrame:
    """An index that has followed the events as a stream of changes: each user is a file, a purchase deletes it, all else rewrites it."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    op = F.when(F.col("event_type") == "purchase", F.lit("delete")).otherwise(F.lit("upsert"))
    changes = stream.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("file_path"), op.alias("op"), F.timestamp_seconds("event_id").alias("at"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("content"))

    def chunks(files: DataFrame) -> DataFrame:
        return files.select(F.concat("file_path", F.lit(":chunk_1")).alias("id"), "file_path", "content", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>").alias("embedding"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(False).alias("is_test"))

    store = S.Store(spark, new_folder(spark, "store"))
    watch.watch(changes, store, chunks, new_folder(spark, "watched"), once=True).awaitTermination()
    return store.read("chunks").join(store.read("files").select("file_path", "chunk_count"), "file_path").select("file_path", "content", "chunk_count")


WATCHED = """WITH l AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id)
SELECT 'user/' || user_id AS file_path, event_type || ' ' || event_id AS content, CAST(1 AS BIGINT) AS chunk_count FROM l WHERE event_type <> 'purchase'"""


def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    return S.latest(e, "user_id", "o").select("user_id", "event_id", "event_type")


LATEST = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"


def printed_results(spark: SparkSession, sf: str) -> DataFrame:
    near = knn.exact(query_vectors(spark, sf), vectors(spark, sf).select("id", "embedding"), 4)
    rows = near.join(documents(spark, sf).select(F.col("doc_id").alias("id"), "file_path", "text"), "id")
    res = rows.select("query_id", "rank", F.col("file_path").alias("file"), F.lit(1).alias("start"), F.size(F.split("text", "\n")).alias("end"), F.col("distance").alias("score"), F.lit("").alias("content"), F.lit(False).alias("is_test"))
    return S.printed(res).join(S.printed(res, "quiet").withColumnRenamed("output", "quiet"), "query_id")


PRINTED = f"""WITH {_Q}, d AS (SELECT query_id, vec_id AS id, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d),
r AS (SELECT query_id, rank, {PATH_SQL} AS p, len(string_split(text, chr(10))) AS n FROM c JOIN documents ON doc_id = id WHERE rank <= 4)
SELECT query_id, string_agg(p || ':1-' || n, chr(10) ORDER BY rank) AS output, string_agg(p, chr(10) ORDER BY rank) AS quiet FROM r GROUP BY query_id"""


def path_prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest rows under a path prefix: filtered after the search, first k of what is left."""
    near = knn.exact(query_vectors(spark, sf), vectors(spark, sf).select("id", "embedding"), 50).drop("rank")
    rows = near.join(documents(spark, sf).select(F.col("doc_id").alias("id"), "file_path"), "id").where(F.col("file_path").startswith("pkg/"))
    return knn.ranked(rows, 5, [F.col("distance"), F.col("id")]).select("query_id", "id", r6(F.col("distance")).alias("distance"), "rank")


PREFIX = f"""WITH {_Q}, d AS (SELECT query_id, vec_id AS id, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM d),
r AS (SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM c JOIN documents ON doc_id = id WHERE n <= 50 AND starts_with({PATH_SQL}, 'pkg/'))
SELECT query_id, id, round(d, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 5"""

def _two_tools(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ten nearest by cosine, and five nearest among even ids; judged by label."""
    rows, q = vectors(spark, sf).select("id", "embedding"), query_vectors(spark, sf)
    a, b = knn.exact(q, rows, 10), knn.exact(q, rows.where("id % 2 = 0"), 5)
    both = a.select(F.lit("all").alias("tool"), "query_id", F.col("id").alias("file")).unionByName(b.select(F.lit("even").alias("tool"), "query_id", F.col("id").alias("file")))
    labels = vectors(spark, sf).select(F.col("id").alias("file"), "label")
    judged = both.select("query_id", "file").distinct().join(labels, "file").join(q.select("query_id", F.col("label").alias("ql")), "query_id").select("query_id", "file", (F.col("ql") == F.col("label")).cast("int").alias("rel"))
    totals = _relevant(q.select("query_id", F.col("label").alias("ql")), labels.withColumnRenamed("file", "id"), False).withColumnRenamed("n_relevant", "relevant")
    return both, judged, totals


def paired_tools(spark: SparkSession, sf: str) -> DataFrame:
    both, judged, totals = _two_tools(spark, sf)
    c = metrics.compare(both, judged, totals).join(metrics.overlap(both, "even", "all"), "query_id")
    return c.select("query_id", "tool", "returned", "relevant", "found", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "tokens", "overlap")


_TWO = f"""{_Q}, d AS (SELECT query_id, ql, vec_id AS id, label, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM d), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM d WHERE id % 2 = 0),
r AS (SELECT 'all' AS tool, query_id, id, ql, label FROM a WHERE n <= 10 UNION ALL SELECT 'even', query_id, id, ql, label FROM b WHERE n <= 5), t AS (SELECT query_id, count(*) FILTER (ql = label) AS relevant FROM d GROUP BY query_id),
o AS (SELECT x.query_id, count(y.id) AS overlap FROM r x LEFT JOIN r y ON y.query_id = x.query_id AND y.id = x.id AND y.tool = 'all' WHERE x.tool = 'even' GROUP BY x.query_id)"""
PAIRED_TOOLS = f"""WITH {_TWO} SELECT r.query_id, tool, count(*) AS returned, relevant, count(*) FILTER (ql = label) AS found, round(count(*) FILTER (ql = label) / count(*), 6) AS precision, round(count(*) FILTER (ql = label) / relevant, 6) AS recall, count(*) * 10 AS tokens, overlap
FROM r JOIN t ON r.query_id = t.query_id JOIN o ON o.query_id = r.query_id GROUP BY r.query_id, tool, relevant, overlap"""


def mean_tool_quality(spark: SparkSession, sf: str) -> DataFrame:
    both, judged, totals = _two_tools(spark, sf)
    s = metrics.summary(metrics.compare(both, judged, totals), "tool", ["precision", "recall"], ["tokens"])
    return s.select("tool", "queries", "total_tokens", F.round(metrics.f1(F.col("avg_precision"), F.col("avg_recall")), 6).alias("f1_of_means"))


MEAN_TOOL = f"""WITH {_TWO}, m AS (SELECT r.query_id, tool, count(*) FILTER (ql = label) / count(*) AS p, count(*) FILTER (ql = label) / max(relevant) AS rc, count(*) * 10 AS tokens FROM r JOIN t ON r.query_id = t.query_id GROUP BY r.query_id, tool)
SELECT tool, count(*) AS queries, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(2 * avg(p) * avg(rc) / (avg(p) + avg(rc)), 6) AS f1_of_means FROM m GROUP BY tool"""


def benchmark_corpora(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the corpora of a run, by language; the judgments are good documents as answers to their own texts."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    queries, own = C.self_retrieval(docs)
    judged = own.join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "rel")
    fast = C.corpus(docs, judged).groupBy("lang").agg(F.count("*").alias("fast"))
    asked = C.judged_queries(queries, judged).select("query_id").join(docs.withColumnRenamed("doc_id", "query_id"), "query_id").groupBy("lang").agg(F.count("*").alias("asked"))
    full = C.corpus(docs, judged, "full").groupBy("lang").agg(F.count("*").alias("full"))
    return full.join(fast, "lang").join(asked, "lang")


CORPORA = """WITH j AS (SELECT doc_id FROM documents WHERE length(text) > 10 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT lang, count(*) AS full, count(*) FILTER (doc_id IN (SELECT doc_id FROM j)) AS fast, count(*) FILTER (doc_id IN (SELECT doc_id FROM j)) AS asked FROM documents GROUP BY lang HAVING fast > 0"""

QUERIES = {f.__name__: f for f in (ir_metrics, ir_binary_metrics, tool_summary, jaccard_diversity, latency_percentiles, nearest_rank_percentiles, stage_timing, token_savings, result_lines, result_ranges, grep_baseline, index_stats, upsert_delete, paged_chunks, ids_to_documents, semi_anti_sets, debounce_sessions, watched_changes, latest_events, printed_results, path_prefix_filter, paired_tools, mean_tool_quality, benchmark_corpora)}
ORACLE_SQL = {
    "ir_metrics": IR_METRICS, "ir_binary_metrics": IR_BINARY, "tool_summary": TOOL_SUMMARY, "jaccard_diversity": JACCARD, "latency_percentiles": LATENCY, "nearest_rank_percentiles": NEAREST_RANK, "stage_timing": STAGE_TIMING,
    "token_savings": TOKEN_SAVINGS, "result_lines": RESULT_LINES, "result_ranges": RESULT_RANGES, "grep_baseline": GREP, "index_stats": INDEX_STATS, "upsert_delete": UPSERT_DELETE, "paged_chunks": PAGED, "ids_to_documents": IDS_TO_DOCS,
    "semi_anti_sets": SEMI_ANTI, "debounce_sessions": DEBOUNCE, "watched_changes": WATCHED, "latest_events": LATEST, "printed_results": PRINTED, "path_prefix_filter": PREFIX, "paired_tools": PAIRED_TOOLS, "mean_tool_quality": MEAN_TOOL, "benchmark_corpora": CORPORA,
}
