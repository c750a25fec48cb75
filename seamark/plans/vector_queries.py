"""Registered queries: vectors, neighbours, pooling, quantisation, late interaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..functions import vector as V
from ..operators import knn, maxsim, pooling, segments
from ..operators.pq import ProductQuantiser
from .tables import query_vectors, table, vectors

#: Lists of the index, and how many a query looks at. (The test vectors have hardly any clusters, so these are many.)
LISTS, PROBES = 128, 56
_D = "CAST({} AS DOUBLE[])"
_COS = "(1 - list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_inner_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_inner_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[])))))"
_Q = "q AS (SELECT vec_id AS query_id, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 50 = 0)"


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    found = knn.exact(query_vectors(spark, sf), vectors(spark, sf), 10, 1.0)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return found.join(docs, "id", "left").select("query_id", "id", r6(F.col("distance")).alias("distance"), "rank", "lang")


KNN_EXACT = f"""WITH {_Q}, d AS (SELECT query_id, vec_id AS id, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d WHERE d <= 1.0)
SELECT query_id, r.id, round(d, 6) + 0.0 AS distance, rank, lang FROM r LEFT JOIN documents ON doc_id = r.id WHERE rank <= 10"""


def knn_bruteforce(spark: SparkSession, sf: str) -> DataFrame:
    return knn.search(query_vectors(spark, sf), vectors(spark, sf), 5, 0.95).select("query_id", "id", r6(F.col("distance")).alias("distance"), "rank")


KNN_BRUTE = f"""WITH {_Q}, d AS (SELECT query_id, vec_id AS id, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d WHERE d <= 0.95)
SELECT query_id, id, round(d, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 5"""


def knn_threshold(spark: SparkSession, sf: str) -> DataFrame:
    found = knn.within(query_vectors(spark, sf), vectors(spark, sf), 0.85)
    return found.select("query_id", "n", r6(F.col("farthest")).alias("farthest"))


KNN_THRESHOLD = f"""WITH {_Q}, d AS (SELECT query_id, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings)
SELECT query_id, count(*) AS n, round(max(d), 6) + 0.0 AS farthest FROM d WHERE d <= 0.85 GROUP BY query_id"""


def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    found = knn.exact(query_vectors(spark, sf), vectors(spark, sf), 5, kind="l2")
    return found.where("id != query_id").select("query_id", "id", r6(F.col("distance")).alias("distance"), "rank")


KNN_L2 = f"""WITH {_Q}, d AS (SELECT query_id, vec_id AS id, list_distance({_D.format('qv')}, {_D.format('embedding')}) AS d FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d)
SELECT query_id, id, round(d, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 5 AND id <> query_id"""


def vector_distances(spark: SparkSession, sf: str) -> DataFrame:
    a = vectors(spark, sf).select("id", F.col("embedding").alias("a"))
    b = vectors(spark, sf).select((F.col("id") - 1).alias("id"), F.transform("embedding", lambda x: x * 2).alias("b"))
    x, y = F.col("a"), F.col("b")
    return a.join(b, "id").select("id", r6(V.dot(x, y)).alias("dot"), r6(V.dot_distance(x, y)).alias("dot_distance"), r6(V.cosine_distance(x, y)).alias("cosine_distance"), r6(V.cosine_similarity(x, y)).alias("cosine_similarity"), r6(V.l2_distance(x, y)).alias("l2"), r6(V.squared_l2(x, y)).alias("squared_l2"), r6(V.norm(y)).alias("norm"))


VECTOR_DISTANCES = f"""WITH p AS (SELECT a.vec_id AS id, {_D.format('a.embedding')} AS a, list_transform({_D.format('b.embedding')}, lambda x: x * 2) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT id, round(list_inner_product(a, b), 6) + 0.0 AS dot, round(1 - list_inner_product(a, b), 6) + 0.0 AS dot_distance, round({_COS.format('a', 'b')}, 6) + 0.0 AS cosine_distance,
 round(1 - {_COS.format('a', 'b')}, 6) + 0.0 AS cosine_similarity, round(list_distance(a, b), 6) + 0.0 AS l2, round(pow(list_distance(a, b), 2), 6) + 0.0 AS squared_l2, round(sqrt(list_inner_product(b, b)), 6) + 0.0 AS norm FROM p"""


def normalise_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select("id", V.normalise(F.transform("embedding", lambda x: (x * 3).cast("float"))).alias("v"))
    return v.select("id", F.round(V.norm(F.col("v")), 4).alias("norm"), F.round(F.element_at("v", 1).cast("double"), 4).alias("first"))


NORMALISE = f"""WITH v AS (SELECT vec_id AS id, list_transform({_D.format('embedding')}, lambda x: x * 3) AS v FROM embeddings)
SELECT id, CAST(1.0 AS DOUBLE) AS norm, round(v[1] / sqrt(list_inner_product(v, v)), 4) AS first FROM v"""


def vector_codec(spark: SparkSession, sf: str) -> DataFrame:
    said = V.format_vector(F.transform("embedding", lambda x: F.round(x.cast("double"), 3)))
    v = vectors(spark, sf).select("id", V.parse_vector(said).alias("v"))
    return v.select("id", F.size("v").alias("dims"), F.round(F.element_at("v", 2).cast("double"), 3).alias("second"), F.element_at(V.top_k_indices(F.col("v"), 3), 1).alias("least_at"))


VECTOR_CODEC = """WITH v AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 3)) AS v FROM embeddings)
SELECT id, CAST(len(v) AS INTEGER) AS dims, v[2] AS second, CAST(list_position(list_transform(v, lambda x: CAST(x AS FLOAT)), list_min(list_transform(v, lambda x: CAST(x AS FLOAT)))) - 1 AS INTEGER) AS least_at FROM v"""


def file_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    pooled = pooling.mean_vectors(vectors(spark, sf), "label", "embedding", F.col("id").cast("int"))
    return pooled.select("label", F.posexplode("embedding").alias("pos", "x"), "chunk_count", "total_lines").select("label", "pos", F.round(F.col("x").cast("double"), 4).alias("x"), "chunk_count", "total_lines")


_MEANS = """m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos),
u AS (SELECT label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m)"""
FILE_MEAN_POOL = f"""WITH {_MEANS}, c AS (SELECT label, count(*) AS chunk_count, max(vec_id) AS total_lines FROM embeddings GROUP BY label)
SELECT u.label, CAST(pos AS INTEGER) AS pos, round(x, 4) AS x, chunk_count, CAST(total_lines AS INTEGER) AS total_lines FROM u JOIN c ON u.label = c.label"""


def file_level_search(spark: SparkSession, sf: str) -> DataFrame:
    files = pooling.mean_vectors(vectors(spark, sf), "label", "embedding").withColumn("file", F.col("label").cast("long"))
    found = knn.exact(query_vectors(spark, sf), files, 3, row=("file", "embedding"))
    return found.select("query_id", "file", F.round("distance", 4).alias("distance"), "rank")


_FILE_SEARCH = f"""{_MEANS}, f AS (SELECT CAST(label AS BIGINT) AS file, list(x ORDER BY pos) AS fv FROM u GROUP BY label), {_Q},
fd AS (SELECT query_id, file, {_COS.format('qv', 'fv')} AS d FROM q, f), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, file) AS rank FROM fd)"""
FILE_LEVEL_SEARCH = f"WITH {_FILE_SEARCH} SELECT query_id, file, round(d, 4) AS distance, rank FROM fr WHERE rank <= 3"


def meta_query_search(spark: SparkSession, sf: str) -> DataFrame:
    files = pooling.mean_vectors(vectors(spark, sf), "label", "embedding").withColumn("file", F.col("label").cast("string"))
    found = knn.exact(query_vectors(spark, sf), files, 10, row=("file", "embedding")).withColumnRenamed("file", "file_path")
    chunks = vectors(spark, sf).select(F.col("label").cast("string").alias("file_path"), "id", F.col("id").alias("start_line"))
    return pooling.first_chunks(found, chunks, 4).select("query_id", "file_path", "id", "nth", F.round("distance", 4).alias("distance"))


META_QUERY_SEARCH = f"""WITH {_FILE_SEARCH}, c AS (SELECT CAST(label AS BIGINT) AS file, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth FROM embeddings),
p AS (SELECT query_id, fr.file, c.id, nth, d, coalesce(sum(1) OVER (PARTITION BY query_id ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fr JOIN c ON fr.file = c.file WHERE nth <= 2)
SELECT query_id, CAST(file AS VARCHAR) AS file_path, id, CAST(nth AS INTEGER) AS nth, round(d, 4) AS distance FROM p WHERE before < 8"""


def quantise_minmax(spark: SparkSession, sf: str) -> DataFrame:
    q = vectors(spark, sf).select("id", "embedding", Q.int8_minmax(F.col("embedding")).alias("t"), Q.int8_minmax(F.col("embedding"), True).alias("r"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
    back = Q.from_int8_minmax(F.col("r.q"), F.col("r.scale"), F.col("r.min"))
    worst = F.array_max(F.zip_with(back, F.col("embedding"), lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return q.select("id", total(F.col("t.q")).alias("sum_truncated"), total(F.col("r.q")).alias("sum_rounded"), r6(F.col("t.scale")).alias("scale"), r6(F.col("t.min")).alias("low"), (worst <= F.col("r.scale") * 0.51 + 1e-6).alias("close"))


QUANTISE_MINMAX = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT *, list_min(v) AS low, (list_max(v) - list_min(v)) / 255.0 AS scale FROM v)
SELECT id, CAST(list_sum(list_transform(v, lambda x: CAST(trunc((x - low) / scale - 128) AS BIGINT))) AS BIGINT) AS sum_truncated,
 CAST(list_sum(list_transform(v, lambda x: CAST(round((x - low) / scale) - 128 AS BIGINT))) AS BIGINT) AS sum_rounded, round(scale, 6) + 0.0 AS scale, round(low, 6) + 0.0 AS low, true AS close FROM s"""


def quantise_unit(spark: SparkSession, sf: str) -> DataFrame:
    q = vectors(spark, sf).select("id", Q.int8_unit(F.transform("embedding", lambda x: (x * 5).cast("float"))).alias("q"))
    return q.select("id", F.array_min("q").cast("int").alias("low"), F.array_max("q").cast("int").alias("high"), F.aggregate("q", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"), r6(F.element_at(Q.from_int8_unit(F.col("q")), 1).cast("double")).alias("first"))


QUANTISE_UNIT = """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(trunc(greatest(-1, least(1, CAST(CAST(x * 5 AS FLOAT) AS DOUBLE))) * 127) AS INTEGER)) AS q FROM embeddings)
SELECT id, list_min(q) AS low, list_max(q) AS high, CAST(list_sum(q) AS BIGINT) AS total, round(CAST(CAST(q[1] / 127.0 AS FLOAT) AS DOUBLE), 6) + 0.0 AS first FROM v"""


def quantise_binary(spark: SparkSession, sf: str) -> DataFrame:
    q = vectors(spark, sf).select("id", Q.binary_words(F.col("embedding")).alias("w"), Q.binary_bytes(F.col("embedding")).alias("b"))
    ones = F.size(F.filter(Q.from_binary_words(F.col("w"), 64), lambda x: x > 0))
    return q.select("id", F.element_at("w", 1).alias("word0"), F.element_at("w", 2).alias("word1"), F.lower(F.hex("b")).alias("bits"), ones.alias("ones"))


_BITS = "list_reduce(list_transform({0}, lambda x: CASE WHEN x > 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END), lambda a, x: a * 2 + x)"
QUANTISE_BINARY = f"""SELECT vec_id AS id, {_BITS.format('embedding[1:32]')} AS word0, {_BITS.format('embedding[33:64]')} AS word1,
 lower(lpad(to_hex({_BITS.format('embedding[1:32]')}), 8, '0') || lpad(to_hex({_BITS.format('embedding[33:64]')}), 8, '0')) AS bits,
 CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS ones FROM embeddings"""


def hamming_topk(spark: SparkSession, sf: str) -> DataFrame:
    words = Q.binary_words(F.col("embedding"))
    rows = vectors(spark, sf).select(F.col("id").alias("_id"), words.alias("_vec"))
    found = knn.nearest(query_vectors(spark, sf).select("query_id", words.alias("w")), rows, 5, knn.by_bits, query=("query_id", "w"), kind=int)
    return found.withColumn("distance", F.col("distance").cast("long"))


HAMMING_TOPK = f"""WITH b AS (SELECT vec_id AS id, {_BITS.format('embedding[1:32]')} AS w0, {_BITS.format('embedding[33:64]')} AS w1 FROM embeddings),
d AS (SELECT q.id AS query_id, b.id, CAST(bit_count(xor(q.w0, b.w0)) + bit_count(xor(q.w1, b.w1)) AS BIGINT) AS distance FROM b q, b WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) SELECT query_id, id, distance, rank FROM r WHERE rank <= 5"""


def int8_dot_topk(spark: SparkSession, sf: str) -> DataFrame:
    coded = vectors(spark, sf).select("id", Q.int8_minmax(F.col("embedding"), True).alias("q"))
    rows = coded.select(F.col("id").alias("_id"), F.col("q.q").alias("_vec"), F.col("q.scale").alias("_scale"), F.col("q.min").alias("_min"))
    found = knn.nearest(query_vectors(spark, sf), rows, 5, knn.by_codes("dot"))
    return found.select("query_id", "id", F.round(1 - F.col("distance"), 5).alias("score"), "rank")


INT8_DOT_TOPK = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, list_min(CAST(embedding AS DOUBLE[])) AS low, (list_max(CAST(embedding AS DOUBLE[])) - list_min(CAST(embedding AS DOUBLE[]))) / 255.0 AS scale FROM embeddings),
z AS (SELECT id, v, list_transform(v, lambda x: (round((x - low) / scale)) * scale + low) AS back FROM v),
d AS (SELECT q.id AS query_id, z.id, list_inner_product(q.v, z.back) AS s FROM z q, z WHERE q.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM d)
SELECT query_id, id, round(s, 5) AS score, rank FROM r WHERE rank <= 5"""


def _parts(rows: DataFrame, key: str, out: str, name: str, vec: str = "embedding") -> DataFrame:
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col(vec), i * 16 + 1, 16))
    return rows.select(F.col(key).alias(out), F.posexplode(parts).alias(f"{name}_idx", f"{name}_vec"))


def maxsim_topk(spark: SparkSession, sf: str) -> DataFrame:
    terms = _parts(query_vectors(spark, sf), "query_id", "query_id", "term")
    segs = _parts(vectors(spark, sf), "id", "chunk_id", "segment")
    near = knn.exact(query_vectors(spark, sf), vectors(spark, sf), 30).select("query_id", F.col("id").alias("chunk_id"))
    return maxsim.top(maxsim.maxsim(terms, segs, near), 10).select("query_id", "chunk_id", r6(F.col("maxsim")).alias("maxsim"), "rank")


MAXSIM_TOPK = f"""WITH {_Q}, d AS (SELECT query_id, vec_id AS id, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM d),
p AS (SELECT vec_id AS id, i, {_D.format('embedding[i * 16 + 1:i * 16 + 16]')} AS v FROM embeddings, (SELECT unnest(range(4)) AS i)),
b AS (SELECT c.query_id, c.id, t.i, max(list_inner_product(t.v, s.v)) AS best FROM c JOIN p t ON t.id = c.query_id JOIN p s ON s.id = c.id WHERE n <= 30 GROUP BY c.query_id, c.id, t.i),
m AS (SELECT query_id, id AS chunk_id, sum(greatest(best, 0)) / 4 AS m FROM b GROUP BY query_id, id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, chunk_id) AS rank FROM m)
SELECT query_id, chunk_id, round(m, 6) + 0.0 AS maxsim, rank FROM r WHERE rank <= 10"""


def maxsim_int8(spark: SparkSession, sf: str) -> DataFrame:
    terms = _parts(query_vectors(spark, sf), "query_id", "query_id", "term")
    segs = _parts(vectors(spark, sf), "id", "chunk_id", "segment").withColumn("q", Q.int8_minmax(F.col("segment_vec"), True)).select("chunk_id", "segment_idx", F.col("q.q").alias("emb_i8"), F.col("q.scale").alias("scale"), F.col("q.min").alias("min"))
    near = knn.exact(query_vectors(spark, sf), vectors(spark, sf), 10).select("query_id", F.col("id").alias("chunk_id"))
    return maxsim.maxsim(terms, segs, near).select("query_id", "chunk_id", F.round("maxsim", 5).alias("maxsim"))


MAXSIM_INT8 = f"""WITH {_Q}, d AS (SELECT query_id, vec_id AS id, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM d),
p AS (SELECT vec_id AS id, i, {_D.format('embedding[i * 16 + 1:i * 16 + 16]')} AS v FROM embeddings, (SELECT unnest(range(4)) AS i)),
z AS (SELECT id, list_transform(v, lambda x: round((x - list_min(v)) / ((list_max(v) - list_min(v)) / 255.0)) * ((list_max(v) - list_min(v)) / 255.0) + list_min(v)) AS v FROM p),
b AS (SELECT c.query_id, c.id, t.i, max(list_inner_product(t.v, s.v)) AS best FROM c JOIN p t ON t.id = c.query_id JOIN z s ON s.id = c.id WHERE n <= 10 GROUP BY c.query_id, c.id, t.i)
SELECT query_id, id AS chunk_id, round(sum(greatest(best, 0)) / 4, 5) AS maxsim FROM b GROUP BY query_id, id"""


def _recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, k, found): of the k true neighbours of a query, how many were found."""
    hits = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("k"), F.count("hit").alias("found"))


def _recall_and_share(found: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """Adds the share of all rows whose vectors a query looked at."""
    looked = found.groupBy("query_id").agg(F.round(F.max("looked") / F.lit(float(max(1, n))), 4).alias("share"))
    return _recall(found, truth).join(looked, "query_id")


def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 10 of the list index against exact search, and the share of rows looked at, by query."""
    rows, q = vectors(spark, sf).select("id", "embedding"), query_vectors(spark, sf)
    return _recall_and_share(knn.ListIndex(rows, LISTS).search(q, 10, PROBES), knn.exact(q, rows, 10), rows.count())


def lsh_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The same for sketches by random planes."""
    rows, q = vectors(spark, sf).select("id", "embedding"), query_vectors(spark, sf)
    return _recall_and_share(knn.SketchIndex(rows).search(q, 10), knn.exact(q, rows, 10), rows.count())


def pq_adc_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by table products over product codes, ranked by exact products."""
    rows = vectors(spark, sf).select("id", "embedding")
    pq, out = ProductQuantiser.train(rows), None
    coded = pq.encode_rows(rows.withColumn("vector", F.col("embedding")))
    for ids, q in knn.query_blocks(query_vectors(spark, sf), "query_id", "embedding"):
        one = pq.search(list(zip(ids.tolist(), q, strict=True)), coded, 10, vec_col="vector")
        out = one if out is None else out.unionByName(one)
    return out


def pq_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 10 of the product codes against exact products, by query."""
    rows = vectors(spark, sf).select("id", "embedding")
    return _recall(pq_adc_topk(spark, sf), knn.exact(query_vectors(spark, sf), rows, 10, kind="dot"))


def pq_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).select("id", "embedding")
    pq = ProductQuantiser.train(rows)
    return pq.encode_rows(rows).select("id", F.size("codes").alias("parts"), F.array_min("codes").cast("int").alias("low"), F.array_max("codes").cast("int").alias("high"))


def segment_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    segs = _parts(rows, "id", "chunk_id", "segment").withColumn("text", F.concat(F.lit("s"), F.col("segment_idx").cast("string")))
    pooled = segments.pool(segs, 3)
    return pooled.select("chunk_id", "segment_idx", "text", F.round(F.element_at("segment_vec", 1), 6).alias("first"))


QUERIES = {f.__name__: f for f in (knn_exact, knn_bruteforce, knn_threshold, knn_l2, vector_distances, normalise_vectors, vector_codec, file_mean_pool, file_level_search, meta_query_search, quantise_minmax, quantise_unit, quantise_binary, hamming_topk, int8_dot_topk, maxsim_topk, maxsim_int8, ivf_recall, lsh_recall, pq_adc_topk, pq_recall, pq_codes, segment_pool)}
ORACLE_SQL = {
    "knn_exact": KNN_EXACT, "knn_bruteforce": KNN_BRUTE, "knn_threshold": KNN_THRESHOLD, "knn_l2": KNN_L2, "vector_distances": VECTOR_DISTANCES, "normalise_vectors": NORMALISE, "vector_codec": VECTOR_CODEC,
    "file_mean_pool": FILE_MEAN_POOL, "file_level_search": FILE_LEVEL_SEARCH, "meta_query_search": META_QUERY_SEARCH, "quantise_minmax": QUANTISE_MINMAX, "quantise_unit": QUANTISE_UNIT, "quantise_binary": QUANTISE_BINARY,
    "hamming_topk": HAMMING_TOPK, "int8_dot_topk": INT8_DOT_TOPK, "maxsim_topk": MAXSIM_TOPK, "maxsim_int8": MAXSIM_INT8,
}
