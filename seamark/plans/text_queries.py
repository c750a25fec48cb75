"""Registered queries: lexical and hybrid search, query and path rules, fusion, dedup, chunking."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions.embedding import HashingEmbedder
from ..operators import chunking, dedup, fusion, hybrid, knn, lexical, search, segments
from ..shared import local_rows, new_folder
from ..sources.store import Store
from .tables import PATH_SQL, QUERIES_SQL, documents, kept_index, literal_queries, query_vectors, table, text_index, vectors
from .vector_queries import _COS, _Q

_STOPS = ", ".join(f"'{w}'" for w in T.LEXICAL_STOPS)
_TERM_STOPS = ", ".join(f"'{w}'" for w in T.TERM_STOPS)
_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{Nd}}]+')"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_ESTIMATE = "greatest(CAST(strlen({0}) // 4 AS INTEGER), CAST(floor(len(" + _WORDS + ") * CAST(1.3 AS DOUBLE)) AS INTEGER))"


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.estimate_words(F.col("text")).alias("words"), F.round(T.cost(T.estimate_tokens(F.col("text"))), 9).alias("cost"))


TOKEN_ESTIMATE = f"SELECT doc_id, {_ESTIMATE.format('text')} AS tokens, CAST(floor(len({_WORDS.format('text')}) * CAST(1.3 AS DOUBLE)) AS INTEGER) AS words, round({_ESTIMATE.format('text')} / 1e6 * 3.0, 9) AS cost FROM documents"


def _bench_terms(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.explode(T.tokens(F.col("text"))).alias("term"))


def _doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.document_tokens(table(spark, sf, "documents"), "doc_id", ["text"])


def bm25_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.corpus_stats(lexical.doc_stats(_doc_tokens(spark, sf))).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


_TOK = f"tok AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS t FROM documents)"
BM25_CORPUS_STATS = f"WITH {_TOK} SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avgdl FROM tok"


def bm25_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    df = lexical.postings(_doc_tokens(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    first = df.orderBy(F.col("df").desc(), "term").limit(100)  # the only rows that meet in one task
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.col("df").desc(), "term")))


BM25_DF = f"""WITH {_TOK}, p AS (SELECT id, unnest(t) AS term FROM tok), f AS (SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM p GROUP BY term)
SELECT * FROM (SELECT term, df, cf, row_number() OVER (ORDER BY df DESC, term) AS rank FROM f) WHERE rank <= 100"""


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25_top(_bench_terms(spark, sf), text_index(spark, sf), 10).select("query_id", "id", F.round("bm25", 6).alias("bm25"), "rank")


_BM25 = f"""{_TOK}, qt AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark), p AS (SELECT id, unnest(t) AS term FROM tok),
tf AS (SELECT id, term, count(*) AS f FROM p GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), dl AS (SELECT id, len(t) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
w AS (SELECT query_id, tf.id, -sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25, count(*) AS matched
 FROM qt JOIN tf ON qt.term = tf.term JOIN df ON df.term = tf.term JOIN dl ON dl.id = tf.id, st GROUP BY query_id, tf.id)"""
BM25_TOPK = f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), id) AS rank FROM w) SELECT query_id, id, round(bm25, 6) AS bm25, rank FROM r WHERE rank <= 10"


def bm25_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(_bench_terms(spark, sf), text_index(spark, sf), True).select("query_id", "id", F.round("bm25", 6).alias("bm25"))


BM25_ALL = f"WITH {_BM25}, asked AS (SELECT query_id, count(*) AS asked FROM qt GROUP BY query_id) SELECT w.query_id, id, round(bm25, 6) AS bm25 FROM w JOIN asked ON w.query_id = asked.query_id WHERE matched = asked"


def bm25_phrases(spark: SparkSession, sf: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    runs = F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat_ws("-", a, b))
    pairs = table(spark, sf, "benchmark").where(F.size(t) > 1).select(F.col("item_id").alias("query_id"), F.explode(runs).alias("term"))
    return lexical.bm25(pairs, text_index(spark, sf)).select("query_id", "id", F.round("bm25", 6).alias("bm25"))


BM25_PHRASES = f"""WITH {_TOK}, b AS (SELECT item_id AS query_id, {_TOKENS.format('text')} AS t FROM benchmark), q AS (SELECT DISTINCT query_id, t[i] || ' ' || t[i + 1] AS term FROM (SELECT *, unnest(range(1, len(t))) AS i FROM b)), u AS (SELECT DISTINCT term FROM q),
p AS (SELECT id, t, unnest(range(1, len(t))) AS i FROM tok), tf AS (SELECT p.id, term, count(*) AS f FROM p JOIN u ON t[i] || ' ' || t[i + 1] = term GROUP BY p.id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dl AS (SELECT id, len(t) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)
SELECT query_id, tf.id, round(-sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25
FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = tf.term JOIN dl ON dl.id = tf.id, st GROUP BY query_id, tf.id"""


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = query_vectors(spark, sf)
    items = table(spark, sf, "benchmark")
    texts = items.select(F.col("item_id").alias("item"), F.explode(T.tokens(F.col("text"))).alias("term"))
    terms = q.select("query_id", F.pmod(F.floor(F.col("query_id") / 50), F.lit(max(1, items.count()))).alias("item")).join(texts, "item").select("query_id", "term")
    # Candidates are few rows and are read several times. Only they are scored, from the texts: no index of all texts is written for that.
    knn.exact(q, vectors(spark, sf), hybrid.candidates(10), 1.0).write.parquet(path := new_folder(spark, "candidates"))
    semantic = spark.read.parquet(path)
    scored = lexical.bm25_of(semantic, terms, table(spark, sf, "documents").select("doc_id", "text"), "doc_id", ["text"])
    return hybrid.combine(semantic, scored, 10, 1.0).select("query_id", "id", F.round("distance", 6).alias("distance"), F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"), "rank")


HYBRID_TOPK = f"""WITH {_Q}, d AS (SELECT query_id, vec_id AS id, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM d WHERE d <= 1.0),
{_BM25.replace("SELECT DISTINCT item_id AS query_id, unnest", "SELECT DISTINCT query_id, unnest").replace("FROM benchmark)", "FROM q JOIN benchmark ON item_id = (query_id // 50) % (SELECT count(*) FROM benchmark))")},
s AS (SELECT c.query_id, c.id, d, coalesce(bm25, 0.0) AS bm25, 0.6 * d + 0.4 * coalesce(bm25, 0.0) AS score FROM c LEFT JOIN w ON w.query_id = c.query_id AND w.id = c.id WHERE n <= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s)
SELECT query_id, id, round(d, 6) AS distance, round(bm25, 6) AS bm25, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


def search_terms(spark: SparkSession, sf: str) -> DataFrame:
    texts = literal_queries(spark).unionByName(table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("query_id"), F.col("text").alias("query")))
    return texts.select("query_id", T.search_terms(F.col("query")).alias("any_of"), T.search_terms(F.col("query"), True).alias("all_of"), F.size(T.pattern_words(F.col("query"))).alias("n_patterns"))


_QUOTE = "CASE WHEN regexp_matches(w, '[\\^*\"():\\-]') THEN '\"' || replace(w, '\"', '\"\"') || '\"' ELSE w END"
_BARE = f"""list_transform(list_filter(list_transform({_WORDS.format('lower(query)')}, lambda w: trim(w, '.,?!"''`:;()[]{{}}*')), lambda w: strlen(w) >= 2 AND NOT list_contains([{_STOPS}], w)), lambda w: {_QUOTE})"""
SEARCH_TERMS = f"""WITH t AS (SELECT * FROM {QUERIES_SQL} UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations WHERE role = 'user')
SELECT query_id, array_to_string({_BARE}, ' OR ') AS any_of, array_to_string({_BARE}, ' ') AS all_of, CAST(len(list_filter(regexp_split_to_array(query, '[ ?.,;]+'), lambda w: strlen(w) >= 3)) AS INTEGER) AS n_patterns FROM t"""


def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), F.col("text").alias("query"))
    q = literal_queries(spark).unionByName(b)
    return q.select("query_id", F.posexplode(T.query_terms(F.col("query"))).alias("term_idx", "term"))


QUERY_TERMS = f"""WITH b AS (SELECT * FROM {QUERIES_SQL} UNION ALL SELECT item_id + 1000, text FROM benchmark),
w AS (SELECT query_id, trim(query) AS q, {_TOKENS.format('query')} AS w FROM b WHERE trim(query) <> ''),
a AS (SELECT query_id, q AS term, 0 AS ord FROM w
 UNION ALL SELECT query_id, w[i], i FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) <= 3) WHERE strlen(w[i]) > 2 AND NOT list_contains([{_TERM_STOPS}], w[i])
 UNION ALL SELECT query_id, w[i] || ' ' || w[i + 1], i FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 3) WHERE NOT (list_contains([{_TERM_STOPS}], w[i]) AND list_contains([{_TERM_STOPS}], w[i + 1]))
 UNION ALL SELECT query_id, w[i], 1000 + i FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 3) WHERE strlen(w[i]) > 3 AND NOT list_contains([{_TERM_STOPS}], w[i])),
u AS (SELECT query_id, term, min(ord) AS ord FROM a GROUP BY query_id, term), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) - 1 AS k FROM u)
SELECT query_id, CAST(k AS INTEGER) AS term_idx, term FROM n WHERE k < 8"""


def query_intent(spark: SparkSession, sf: str) -> DataFrame:
    return literal_queries(spark).select("query_id", T.intent(F.col("query")).alias("intent"), T.is_meta_query(F.col("query")).alias("is_meta"))


def _rlike(pattern: str) -> str:
    return "regexp_matches(query, '" + pattern.replace("'", "''") + "')"


_INTENT = "CASE " + " ".join(f"WHEN {_rlike(p)} THEN '{n}'" for n, p in T.INTENTS) + " ELSE 'conceptual' END"
QUERY_INTENT = f"SELECT query_id, {_INTENT} AS intent, {_rlike(T.META)} AS is_meta FROM {QUERIES_SQL}"


def path_rules(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("file_path")
    d = documents(spark, sf)
    return d.select("doc_id", p, P.is_code_file(p).alias("is_code"), P.is_test_file(p).alias("is_test"), P.should_ignore(p).alias("ignored"), P.should_smart_skip(p).alias("skipped"), P.is_worktree(p).alias("worktree"), P.canonical_path(p).alias("canonical"), P.basename(p).alias("base"), P.dirname(p).alias("dir"), P.extension(p).alias("ext"), T.short_hash(p).alias("repo_id"))


def _in(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _suffix(x: str, xs: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({x}, '{s}')" for s in xs) + ")"


_EXT = r"lower(regexp_extract(file_path, '(\.[^./]*)$', 1))"
_BASE = "string_split(file_path, '/')[-1]"
PATH_RULES = f"""WITH d AS (SELECT doc_id, {PATH_SQL} AS file_path FROM documents), e AS (SELECT *, {_EXT} AS ext, {_BASE} AS base, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM d)
SELECT doc_id, file_path, ext IN {_in(P.CODE_EXTENSIONS)} AS is_code, {_suffix('lower(base)', P.TEST_SUFFIXES)} OR (starts_with(lower(base), 'test_') AND ends_with(lower(base), '.py')) OR regexp_matches(dir, '/({"|".join(P.TEST_DIRS)})(/|$)') AS is_test,
 len(list_filter(string_split(file_path, '/'), lambda x: x IN {_in([p for p in P.active_patterns(P.IGNORED) if '*' not in p])} OR ends_with(x, '.min.js') OR ends_with(x, '.bundle.js'))) > 0 AS ignored,
 {_suffix('base', P.SKIP_TESTS + P.SKIP_GENERATED)} OR {" OR ".join(f"contains(file_path, '{x}')" for x in P.SKIP_DIRS)} OR ext IN {_in(P.SKIP_EXTENSIONS)} AS skipped,
 contains(file_path, '.worktrees/') AS worktree, regexp_replace(file_path, '^.*?\\.worktrees/[^/]*/', '') AS canonical, base, dir, ext, sha256(file_path)[1:12] AS repo_id FROM e"""


def path_boost(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", "file_path").join(literal_queries(spark), F.lit(True))
    return rows.select("doc_id", "query_id", F.round(P.path_boost(F.col("file_path"), T.intent(F.col("query"))), 6).alias("boost"))


_BOOST = """CASE WHEN intent = 'conceptual' AND p IN ('readme.md', 'readme', 'readme.txt') THEN 1.5 WHEN intent = 'conceptual' AND ends_with(p, '/readme.md') AND NOT contains(p, 'example') THEN 1.2 ELSE 1.0 END
 * CASE WHEN intent IN ('conceptual', 'definition') AND regexp_matches(p, '^(pkg|internal|lib)/') AND NOT contains(p, 'example') AND NOT contains(p, 'test') THEN 1.3 ELSE 1.0 END
 * CASE WHEN intent IN ('conceptual', 'definition') AND (contains(p, '/example') OR starts_with(p, 'example')) THEN 0.7 ELSE 1.0 END
 * CASE WHEN intent = 'example' AND (contains(p, 'example') OR contains(p, 'demo')) THEN 1.3 ELSE 1.0 END
 * CASE WHEN ends_with(p, '_test.go') OR contains(p, '/test/') THEN 0.8 ELSE 1.0 END * CASE WHEN contains(p, '.worktrees/') THEN 0.5 ELSE 1.0 END
 * CASE WHEN contains(p, '.generated.') OR contains(p, '.pb.go') THEN 0.6 ELSE 1.0 END"""
PATH_BOOST = f"WITH r AS (SELECT doc_id, query_id, lower({PATH_SQL}) AS p, {_INTENT} AS intent FROM documents, {QUERIES_SQL}) SELECT doc_id, query_id, CAST(round(CAST({_BOOST} AS DOUBLE), 6) AS DOUBLE) AS boost FROM r"


def fusion_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(i, h, r, c, *map(float, fusion.weights(i, h, r, c))) for i in ("conceptual", "definition", "procedural", "example") for h in (False, True) for r, c in ((False, True), (True, False), (True, True))]
    kinds = {"intent": pa.string(), "hybrid": pa.bool_(), "rerank": pa.bool_(), "late": pa.bool_(), "wv": pa.float64(), "wr": pa.float64(), "wc": pa.float64()}
    df = local_rows(spark, {name: ([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})
    return df.select("intent", "hybrid", "rerank", "late", *[F.round(c, 4).alias(c) for c in ("wv", "wr", "wc")])


#: Raw weights before they are normalised: (hybrid, rerank, late) and intent.
FUSION_WEIGHTS = """WITH m(hybrid, rerank, late, v, r, c) AS (VALUES (false, false, true, 0.5, 0.0, 0.5), (false, true, false, 0.5, 0.5, 0.0), (false, true, true, 0.3, 0.4, 0.3), (true, false, true, 0.75, 0.0, 0.25), (true, true, false, 0.75, 0.25, 0.0), (true, true, true, 0.7, 0.05, 0.25)),
i(intent) AS (VALUES ('conceptual'), ('definition'), ('procedural'), ('example')), w AS (SELECT intent, hybrid, rerank, late,
 CAST(CASE WHEN intent IN ('conceptual', 'definition') THEN least(v + 0.1, 0.6) ELSE v END AS DOUBLE) AS v,
 CAST(CASE WHEN intent IN ('conceptual', 'definition') AND rerank THEN greatest(r - 0.05, 0.2) WHEN intent = 'example' AND rerank THEN least(r + 0.1, 0.5) ELSE r END AS DOUBLE) AS r,
 CAST(CASE WHEN intent IN ('conceptual', 'definition') AND NOT rerank AND late THEN least(c + 0.2, 0.5) WHEN intent = 'example' AND late THEN least(c + 0.1, 0.5) ELSE c END AS DOUBLE) AS c FROM m, i)
SELECT intent, hybrid, rerank, late, round(v / (v + r + c), 4) AS wv, round(r / (v + r + c), 4) AS wr, round(c / (v + r + c), 4) AS wc FROM w"""


def _fusion_rows(spark: SparkSession, sf: str) -> DataFrame:
    near = knn.exact(query_vectors(spark, sf), vectors(spark, sf), 30)
    n = F.pmod(F.col("query_id"), F.lit(8))
    q = literal_queries(spark).withColumnRenamed("query_id", "n")
    rows = near.join(documents(spark, sf).select(F.col("doc_id").alias("id"), "file_path"), "id").withColumn("n", n).join(q, "n")
    return rows.withColumn("logit", F.when(F.col("rank") <= 20, (F.pmod(F.col("id"), F.lit(7)) - 3).cast("double"))).withColumn("maxsim", F.when(F.col("rank") <= 25, F.pmod(F.col("id"), F.lit(11)) / 11.0))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    out = fusion.fuse(_fusion_rows(spark, sf), True, True, True, 10)
    return out.select("query_id", "id", "rank", F.round("rrf", 9).alias("rrf"), "rrf_rank")


RRF_FUSION = f"""WITH {_Q}, d AS (SELECT query_id, vec_id AS id, {_COS.format('qv', 'embedding')} AS d FROM q, embeddings), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d),
j AS (SELECT c.query_id, id, rank, lower({PATH_SQL}) AS p, {_INTENT} AS intent, CASE WHEN rank <= 20 THEN id % 7 - 3 END AS logit, CASE WHEN rank <= 25 THEN (id % 11) / 11.0 END AS ms
 FROM c JOIN documents ON doc_id = id JOIN (SELECT query_id AS n, query FROM {QUERIES_SQL}) ON n = c.query_id % 8 WHERE rank <= 30),
s AS (SELECT query_id, id, rank, ((CASE intent WHEN 'procedural' THEN 0.7 WHEN 'example' THEN 0.7 / 1.2 ELSE 0.6 / 1.05 END) / (60 + rank)
 + (CASE intent WHEN 'procedural' THEN 0.05 WHEN 'example' THEN 0.15 / 1.2 ELSE 0.2 / 1.05 END) * coalesce(1 / (60 + (1 - 1 / (1 + exp(-logit))) * 100 + 1), 0)
 + (CASE intent WHEN 'procedural' THEN 0.25 WHEN 'example' THEN 0.35 / 1.2 ELSE 0.25 / 1.05 END) * coalesce(1 / (60 + (1 - ms) * 50 + 1), 0)) * CAST({_BOOST} AS DOUBLE) AS rrf FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rank) AS rrf_rank FROM s) SELECT query_id, id, rank, round(rrf, 9) AS rrf, rrf_rank FROM r WHERE rrf_rank <= 10"""


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    start = F.pmod(F.col("doc_id") * 7, F.lit(60)).cast("int") + 1
    return d.select(F.pmod(F.col("doc_id"), F.lit(5)).alias("query_id"), F.format_string("%08d", "doc_id").alias("id"), F.concat(F.when(F.col("doc_id") % 3 == 0, ".worktrees/w/").otherwise(""), F.lit("pkg/"), F.col("source"), F.lit(".go")).alias("file_path"), start.alias("start_line"), (start + F.pmod(F.col("doc_id"), F.lit(9)).cast("int") * 5).alias("end_line"), (F.pmod(F.col("doc_id") * 13, F.lit(101)) / 100.0).alias("score"))


def dedup_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_intervals(_ranges(spark, sf)).select("query_id", "id", "canonical", "start_line", "end_line", F.round("score", 6).alias("score"))


DEDUP_INTERVALS = """WITH RECURSIVE r AS (SELECT doc_id % 5 AS query_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, doc_id % 3 = 0 AS wt, 'pkg/' || source || '.go' AS canonical, CAST(doc_id * 7 % 60 + 1 AS INTEGER) AS s, CAST(doc_id * 7 % 60 + 1 + doc_id % 9 * 5 AS INTEGER) AS e, (doc_id * 13 % 101) / 100.0 AS score FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, canonical ORDER BY score, wt, id) AS n FROM r),
f(query_id, canonical, n, kept) AS (SELECT query_id, canonical, n, [{'id': id, 'wt': wt, 's': s, 'e': e, 'score': score}] FROM o WHERE n = 1
 UNION ALL SELECT o.query_id, o.canonical, o.n, CASE WHEN len(list_filter(kept, lambda k: (least(k.e, o.e) - greatest(k.s, o.s) + 1 > 0 AND ((least(k.e, o.e) - greatest(k.s, o.s) + 1) / (k.e - k.s + 1) > 0.5 OR (least(k.e, o.e) - greatest(k.s, o.s) + 1) / (o.e - o.s + 1) > 0.5)) OR (o.wt AND NOT k.wt))) > 0 THEN kept
  ELSE list_append(kept, {'id': o.id, 'wt': o.wt, 's': o.s, 'e': o.e, 'score': o.score}) END FROM f JOIN o ON o.query_id = f.query_id AND o.canonical = f.canonical AND o.n = f.n + 1),
l AS (SELECT query_id, canonical, max(n) AS n FROM o GROUP BY query_id, canonical), k AS (SELECT f.query_id, f.canonical, unnest(kept) AS k FROM f JOIN l ON f.query_id = l.query_id AND f.canonical = l.canonical AND f.n = l.n)
SELECT query_id, k.id AS id, canonical, k.s AS start_line, k.e AS end_line, CAST(round(k.score, 6) AS DOUBLE) AS score FROM k"""


def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    cut = T.truncate_at_boundary(t, 384)
    return table(spark, sf, "documents").select("doc_id", F.length(cut).alias("n"), F.sha2(cut, 256).alias("hash"), T.format_bytes(F.octet_length(t).cast("long") * 37).alias("size"), F.round(T.sigmoid((F.length(t) - 1000) / 500.0), 9).alias("sigmoid"))


TRUNCATE_TEXT = """WITH h AS (SELECT doc_id, text, text[1:384] AS head FROM documents), p AS (SELECT *, length(head) - strpos(reverse(head), chr(10)) AS nl, length(head) - strpos(reverse(head), ' ') AS sp FROM h),
c AS (SELECT doc_id, text, CASE WHEN length(text) <= 384 THEN text WHEN contains(head, chr(10)) AND nl > 288 THEN head[1:nl] WHEN contains(head, ' ') AND sp > 192 THEN head[1:sp] ELSE head END AS cut, strlen(text) * 37 AS b FROM p)
SELECT doc_id, CAST(length(cut) AS INTEGER) AS n, sha256(cut) AS hash, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%.1f MB', b / 1048576.0) END AS size,
 round(1 / (1 + exp(-(length(text) - 1000) / 500.0)), 9) AS sigmoid FROM c"""


def size_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.format_string("src/doc_%d.txt", "doc_id").alias("file_path"), F.col("text").alias("content"))
    return chunking.chunk_files(d, chunking.Config(300, 3)).select("id", "file_path", "start_line", "end_line", F.sha2("content", 256).alias("hash"), "description")


def document_segments(spark: SparkSession, sf: str) -> DataFrame:
    return segments.segment_chunks(table(spark, sf, "documents"), "doc_id", "text").select(F.col("chunk_id").cast("long").alias("doc_id"), "segment_idx", "text")


_STATE = "STRUCT(out_ VARCHAR[], held VARCHAR, size BIGINT)"
_TRIM = r"regexp_replace({0}, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g')"
_BEGINS = " OR ".join(f"starts_with(x.held, '{w}')" for w in segments.STARTS)


def _closed(of: str) -> str:
    return f"{{'out_': list_append({of}.out_, {of}.held), 'held': '', 'size': 0}}::{_STATE}"


#: A fold over the trimmed lines, which come as states that hold one line.
DOCUMENT_SEGMENTS = f"""WITH d AS (SELECT doc_id, {_TRIM.format("text")} AS t FROM documents),
l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda y: {{'out_': []::VARCHAR[], 'held': {_TRIM.format("y")}, 'size': 0}}::{_STATE}) AS lines FROM d),
f AS (SELECT doc_id, list_reduce(list_prepend({{'out_': []::VARCHAR[], 'held': '', 'size': 0}}::{_STATE}, lines), lambda a, x: list_transform(list_transform(
 [CASE WHEN a.size > {segments.CUT} AND (x.held = '' OR {_BEGINS}) THEN {_closed("a")} ELSE a END],
 lambda c: CASE WHEN x.held = '' THEN c ELSE {{'out_': c.out_, 'held': CASE WHEN c.size = 0 THEN x.held ELSE c.held || ' ' || x.held END, 'size': c.size + strlen(x.held)}}::{_STATE} END),
 lambda e: CASE WHEN e.size > {segments.FULL} THEN {_closed("e")} ELSE e END)[1]) AS s FROM l),
o AS (SELECT doc_id, CASE WHEN s.size > {segments.LAST} THEN list_append(s.out_, s.held) ELSE s.out_ END AS o FROM f), n AS (SELECT *, len(o) AS n, greatest(len(o) // 8, 1) AS step FROM o),
p AS (SELECT doc_id, CASE WHEN n <= {segments.MOST} THEN o ELSE list_concat([o[1]], list_transform(list_filter(range(1, 9), lambda i: i * step < n - 1), lambda i: o[i * step + 1]), [o[n]]) END AS o FROM n)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS segment_idx, o[i] AS text FROM (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM p)"""


def hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all documents, whole texts."""
    d = HashingEmbedder(32).embed(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("v"))


def _chunk_index(spark: SparkSession, sf: str, chunks: DataFrame) -> lexical.StoredIndex:
    """The kept postings of these chunks' contents and paths."""
    return kept_index(spark, sf, "chunks", lambda: lexical.document_tokens(chunks, "id", ["content", "file_path"]))


def search_full(spark: SparkSession, sf: str) -> DataFrame:
    """The orchestrated search over chunks made of documents and vectors, with late interaction."""
    chunks = documents(spark, sf).join(vectors(spark, sf).withColumnRenamed("id", "doc_id"), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "file_path", F.col("text").alias("content"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), "embedding", P.is_test_file(F.col("file_path")).alias("is_test"))
    n = F.pmod(F.col("query_id"), F.lit(8))
    q = query_vectors(spark, sf).withColumn("n", n).join(literal_queries(spark).withColumnRenamed("query_id", "n"), "n").select("query_id", "query", "embedding")
    terms = q.select("query_id", F.lit(0).alias("term_idx"), F.col("embedding").alias("term_vec"))
    segs = chunks.select(F.col("id").alias("chunk_id"), F.lit(0).alias("segment_idx"), F.col("embedding").alias("segment_vec"))
    index = search.Index(chunks, segs, postings=_chunk_index(spark, sf, chunks))
    opts = search.SearchOptions(threshold=1.2, use_hybrid=True, use_late=True)
    return search.search(q, index, opts, terms).select("query_id", "rank", "file", "start", "end", F.round("score", 6).alias("score"), "is_test")


#: Candidates by distance and BM25 (phrases where a term has several tokens), fused with the one segment's product. No two rows have
#: one canonical path, so none is dropped for overlap; rows of test files go last, after the ten of each query are chosen.
SEARCH_FULL = f"""WITH {_Q}, lit AS (SELECT query_id AS n, query, {_INTENT} AS intent FROM {QUERIES_SQL}), docs AS (SELECT doc_id, text, {PATH_SQL} AS p, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
tok AS (SELECT doc_id, list_concat({_TOKENS.format('text')}, {_TOKENS.format('p')}) AS t FROM docs), st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM tok),
words AS (SELECT DISTINCT n, array_to_string({_TOKENS.format('w')}, ' ') AS said, {_TOKENS.format('w')} AS ws FROM (SELECT n, unnest({_BARE.replace("regexp_matches(w, '[\\^*", "false AND regexp_matches(w, '[\\^*")}) AS w FROM lit) WHERE len({_TOKENS.format('w')}) > 0),
tf AS (SELECT n, said, doc_id, len(t) AS dl, len(list_filter(range(1, len(t) - len(ws) + 2), lambda i: t[i:i + len(ws) - 1] = ws)) AS f FROM words, tok WHERE list_contains(t, ws[1])),
df AS (SELECT said, count(DISTINCT doc_id) AS df FROM tf WHERE f > 0 GROUP BY said),
bm AS (SELECT n, doc_id, -sum((CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM tf JOIN df ON tf.said = df.said, st WHERE f > 0 GROUP BY n, doc_id),
d AS (SELECT query_id, qv, doc_id, p, embedding, text, {_COS.format('qv', 'embedding')} AS d FROM q, docs), near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, CAST(doc_id AS VARCHAR)) AS k FROM d WHERE d <= 1.2),
s AS (SELECT near.query_id, near.doc_id, near.p, text, intent, qv, embedding, 0.6 * d + 0.4 * coalesce(bm25, 0.0) AS score FROM near JOIN lit ON lit.n = near.query_id % 8 LEFT JOIN bm ON bm.n = near.query_id % 8 AND bm.doc_id = near.doc_id WHERE k <= 150),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, CAST(doc_id AS VARCHAR)) AS rank FROM s),
w AS (SELECT *, p AS file, greatest(list_inner_product(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 0) AS ms FROM r WHERE rank <= 30),
u AS (SELECT query_id, doc_id, file, text, score, rank, ((CASE WHEN intent IN ('conceptual', 'definition') THEN 0.6 / 1.05 WHEN intent = 'example' THEN 0.75 / 1.1 ELSE 0.75 END) / (60 + rank)
 + (CASE WHEN intent IN ('conceptual', 'definition') THEN 0.45 / 1.05 WHEN intent = 'example' THEN 0.35 / 1.1 ELSE 0.25 END) / (60 + (1 - ms) * 50 + 1)) * CAST({_BOOST} AS DOUBLE) AS rrf FROM (SELECT * REPLACE (lower(p) AS p) FROM w)),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rank) AS k FROM u), x AS (SELECT *, {_suffix("lower(string_split(file, '/')[-1])", P.TEST_SUFFIXES)} OR regexp_matches(regexp_extract(file, '^(.*)/[^/]*$', 1), '/({"|".join(P.TEST_DIRS)})(/|$)') AS is_test FROM v WHERE k <= 10)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, CAST(doc_id AS VARCHAR)) AS rank, file, CAST(1 AS INTEGER) AS start, CAST(len(string_split(text, chr(10))) AS INTEGER) AS end, round(score, 6) AS score, is_test FROM x WHERE NOT is_test"""


def stored_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of all documents as a store has them after chunks were written and indexed for late interaction."""
    d = table(spark, sf, "documents")
    e = HashingEmbedder(16)
    chunks = e.embed(d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.create_map(F.lit("lang"), "lang").alias("metadata"), F.lit(False).alias("is_test")), "content")
    store = Store(spark, new_folder(spark, "store"))
    store.upsert_chunks(chunks, postings=False)  # no lexical search follows
    store.preindex(e)
    return store.read("segments").select(F.col("chunk_id").cast("long").alias("doc_id"), "segment_idx", "text", (F.size("emb_i8") == 16).alias("coded"))


STORED_SEGMENTS = f"SELECT *, true AS coded FROM ({DOCUMENT_SEGMENTS})"


QUERIES = {f.__name__: f for f in (stored_segments, token_estimate, bm25_corpus_stats, bm25_document_frequency, bm25_topk, bm25_all_terms, bm25_phrases, hybrid_topk, search_terms, query_terms, query_intent, path_rules, path_boost, fusion_weights, rrf_fusion, dedup_intervals, truncate_text, size_chunks, document_segments, hashed_embeddings, search_full)}
ORACLE_SQL = {
    "token_estimate": TOKEN_ESTIMATE, "bm25_corpus_stats": BM25_CORPUS_STATS, "bm25_document_frequency": BM25_DF, "bm25_topk": BM25_TOPK, "bm25_all_terms": BM25_ALL, "bm25_phrases": BM25_PHRASES, "hybrid_topk": HYBRID_TOPK,
    "search_terms": SEARCH_TERMS, "query_terms": QUERY_TERMS, "query_intent": QUERY_INTENT, "path_rules": PATH_RULES, "path_boost": PATH_BOOST, "fusion_weights": FUSION_WEIGHTS, "rrf_fusion": RRF_FUSION,
    "dedup_intervals": DEDUP_INTERVALS, "truncate_text": TRUNCATE_TEXT, "document_segments": DOCUMENT_SEGMENTS, "search_full": SEARCH_FULL, "stored_segments": STORED_SEGMENTS,
}
