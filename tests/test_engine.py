import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.functions.embedding import HashingEmbedder
from seamark.operators import chunking, dedup, knn, metrics, search
from seamark.operators.pq import ProductQuantiser
from seamark.plans.tables import query_vectors, vectors
from seamark.sources import files, results
from seamark.sources.store import Store
from seamark.streaming import watch

RESULTS = "query_id int, id string, file_path string, start_line int, end_line int, score double"


@pytest.mark.parametrize("rows,kept", [
    ([("/a", 1, 10, 0.3), ("/a", 5, 15, 0.5), ("/b", 1, 10, 0.4), ("/a", 1, 10, 0.2)], [("/a", 0.2), ("/b", 0.4)]),
    ([("/a", 1, 10, 0.1), ("/a", 50, 60, 0.2), ("/a", 100, 110, 0.3), ("/b", 1, 10, 0.4)], [("/a", 0.1), ("/a", 0.2), ("/a", 0.3), ("/b", 0.4)]),
    ([("pkg/x", 1, 10, 0.3), (".worktrees/a/pkg/x", 1, 10, 0.3), (".worktrees/b/pkg/x", 1, 10, 0.4), ("o", 1, 2, 0.5)], [("o", 0.5), ("pkg/x", 0.3)]),
    ([("pkg/x", 1, 10, 0.5), (".worktrees/a/pkg/x", 1, 10, 0.2)], [(".worktrees/a/pkg/x", 0.2)]),
    ([("pkg/x", 1, 10, 0.1), (".worktrees/a/pkg/x", 50, 60, 0.2)], [("pkg/x", 0.1)]),
])
def test_dedup(spark, rows, kept):
    df = spark.createDataFrame([(1, f"i{n}", *r) for n, r in enumerate(rows)], RESULTS)
    assert sorted((r["file_path"], r["score"]) for r in dedup.dedup_intervals(df).collect()) == kept


@pytest.mark.parametrize("a,b,c,d,want", [(1, 10, 20, 30, 0), (1, 10, 1, 10, 1), (1, 10, 5, 15, 1), (1, 100, 99, 200, 0), (1, 100, 40, 60, 1), (1, 10, 11, 20, 0)])
def test_overlap(spark, a, b, c, d, want):
    assert spark.range(1).select(dedup.overlaps(*map(F.lit, (a, b, c, d)))).first()[0] == bool(want)


def rels(spark, xs, n_relevant):
    return spark.createDataFrame([(1, i + 1, r, n_relevant) for i, r in enumerate(xs)], "q int, rank int, rel int, n_relevant int")


@pytest.mark.parametrize("xs,total,metric,want", [([0, 1, 0], 1, "mrr", 0.5), ([2], 1, "dcg_5", 3.0), ([2, 1, 0], 2, "ndcg_5", 1.0), ([1, 0, 1], 4, "p_5", 2 / 3), ([1, 0, 1], 4, "r_5", 0.5), ([1, 0, 1], 2, "ap", 5 / 6), ([0, 0], 0, "ap", 0.0), ([0, 0, 0, 0, 0, 1], 1, "mrr_5", 0.0)])
def test_metrics(spark, xs, total, metric, want):
    assert metrics.per_query(rels(spark, xs, total), ["q"]).first()[metric] == pytest.approx(want)


def test_exact_search_against_numpy(spark, sf):
    rows = vectors(spark, sf).select("id", "embedding")
    got = {(r["query_id"], r["rank"]): r["id"] for r in knn.exact(query_vectors(spark, sf), rows, 7, block=3).collect()}
    data = {r["id"]: np.array(r["embedding"], float) for r in rows.collect()}
    for q in (x for x in data if x % 50 == 0):
        near = sorted(data, key=lambda i: (1 - data[q] @ data[i] / np.linalg.norm(data[q]) / np.linalg.norm(data[i]), i))
        assert [got[q, k + 1] for k in range(7)] == near[:7]


def test_exact_search_keeps_ties_nulls_and_other_lengths_out(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(50, None), (51, [1.0, 0.0, 0.0]), (52, [0.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["id"] for r in knn.exact(q, rows, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert knn.exact(q.where("false"), rows, 5).count() == 0


def test_product_quantiser(spark, sf):
    rows = vectors(spark, sf).select("id", "embedding")
    pq = ProductQuantiser.train(rows, parts=16, centres=64)
    x = np.array([r["embedding"] for r in rows.collect()], float)
    codes = pq.encode(x)
    q = x[3]
    assert np.allclose(pq.dot(pq.table(q), codes), pq.decode(codes) @ q, atol=1e-9)
    again = ProductQuantiser.from_bytes(pq.to_bytes())
    assert (again.books == pq.books).all() and pq.ratio == 16
    assert ((pq.decode(codes) - x) ** 2).sum(1).mean() < 0.5
    assert pq.codebook(spark).count() == 16 * 64


def test_directory_to_index_and_back(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"pkg/a.py": "def hello(name):\n    return 'hello there ' + name + '!' * 3\n", "pkg/tests/t.py": "x = 1\n", "node_modules/z.js": "no", "b.md": "# Title\ntext", "big.go": "x" * (1 << 21), "empty.go": "", "skip/me.go": "package x", "c.bin": "?"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / ".gitignore").write_text("# comment\n\nskip*\n")
    scanned = files.scan(spark, str(root))
    assert {(r["file_path"], r["is_test"]) for r in scanned.collect()} == {("pkg/a.py", False), ("pkg/tests/t.py", True), ("b.md", False)}
    embedder = HashingEmbedder(16)

    def to_chunks(f):
        made = chunking.chunk_files(f)
        return embedder.embed(made.withColumn("t", F.concat_ws("\n\n", "description", "content")), "t").select("id", "file_path", "content", "start_line", "end_line", "embedding", F.create_map(F.lit("description"), "description").alias("metadata"), F.lit(False).alias("is_test"))

    store = Store(spark, str(tmp_path / "index"))
    assert store.stats()[:2] == (0, 0) and not store.has_segments()
    store.upsert_chunks(to_chunks(scanned))
    assert store.stats()[:2] == (3, 3) and store.compute_file_vectors() == 3
    chunks = store.read("chunks")
    store.replace_segments(chunks.select(F.col("id").alias("chunk_id"), F.lit(0).alias("segment_idx"), F.col("content").alias("text"), F.col("embedding").alias("segment_vec")))
    assert store.has_segments()
    store.upsert_chunks(to_chunks(spark.createDataFrame([("b.md", "other text")], "file_path string, content string")))
    assert [r["content"] for r in store.read("chunks").where("file_path = 'b.md'").collect()] == ["other text"]
    store.delete_files(spark.createDataFrame([("pkg/a.py",)], "file_path string"))
    assert {r["file_path"] for r in store.read("chunks").collect()} == {"b.md", "pkg/tests/t.py"}
    assert store.read("segments").count() == 2 and store.read("files").count() == 2
    store.export_vectors(str(tmp_path / "vectors"))
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 2
    store.write_metadata("/r", "2020-01-01T00:00:00Z")
    store.clear()
    assert store.stats() == (0, 0, 0)


def test_watching_changes(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def put(n, rows):
        (inbox / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))

    def to_chunks(f):
        return f.select(F.concat("file_path", F.lit(":chunk_1")).alias("id"), "file_path", "content", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>").alias("embedding"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(False).alias("is_test"))

    store = Store(spark, str(tmp_path / "index"))
    put(1, [{"file_path": "a", "op": "upsert", "at": "2020-01-01T00:00:00Z", "content": "1"}, {"file_path": "a", "op": "upsert", "at": "2020-01-01T00:00:01Z", "content": "2"}, {"file_path": "b", "op": "upsert", "at": "2020-01-01T00:00:00Z", "content": "b"}])
    changes = watch.change_stream(spark, str(inbox))
    for n in (1, 2):
        watch.watch(changes, store, to_chunks, str(tmp_path / "cp"), once=True).awaitTermination()
        if n == 1:
            assert {(r["file_path"], r["content"]) for r in store.read("chunks").collect()} == {("a", "2"), ("b", "b")}
            put(2, [{"file_path": "b", "op": "delete", "at": "2020-01-01T00:00:05Z", "content": None}, {"file_path": "c", "op": "upsert", "at": "2020-01-01T00:00:05Z", "content": "c"}])
    assert {(r["file_path"], r["content"]) for r in store.read("chunks").collect()} == {("a", "2"), ("c", "c")}
    assert [round(x, 5) for x in store.read("files").first()["embedding"]] == [0.6, 0.8]


def test_debounce_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", "2020-01-01 00:00:00"), ("a", "2020-01-01 00:00:00.3"), ("a", "2020-01-01 00:00:05"), ("z", "2020-01-02 00:00:00")], "path string, t string").select("path", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "e"))
    q = watch.debounced(stream, "path", "ts").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["path"], r["n"]) for r in spark.table("bursts").collect()) == [("a", 1), ("a", 2)]


def corpus(spark, n=40):
    rng = random.Random(3)
    rows = [(f"d{i}", f"pkg/f{i % 13}.go" if i % 5 else f"pkg/f{i}_test.go", f"word{i} error handling text" if i % 2 else f"word{i} loader", 1 + i, 10 + i, [rng.gauss(0, 1) for _ in range(8)], i % 5 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id string, file_path string, content string, start_line int, end_line int, embedding array<float>, is_test boolean")


def test_search(spark):
    chunks = corpus(spark)
    vec = {r["id"]: r["embedding"] for r in chunks.collect()}
    q = spark.createDataFrame([(1, "error handling", vec["d3"]), (2, "what does this repo do", vec["d4"])], "query_id long, query string, embedding array<float>")
    plain = search.search(q, search.Index(chunks), search.SearchOptions(limit=5, threshold=2.0)).orderBy("query_id", "rank").collect()
    assert [r["rank"] for r in plain] == [1, 2, 3, 4, 5] * 2 and not any(r["is_test"] for r in plain)
    assert plain[0]["content"].startswith("word3 ") and plain[0]["score"] == pytest.approx(0, abs=1e-6)
    scores = [r["score"] for r in plain if r["query_id"] == 1]
    assert scores == sorted(scores)
    exact = knn.exact(q, chunks, 40, 2.0)
    d = {r["id"]: r["distance"] for r in exact.where("query_id = 1").collect()}
    assert plain[1]["score"] == pytest.approx(0.92 * d["d" + plain[1]["content"].split()[0][4:]])
    rare = q.withColumn("query", F.lit("word7, loader"))
    hybrid = search.search(rare, search.Index(chunks), search.SearchOptions(limit=5, threshold=3.0, use_hybrid=True)).where("query_id = 1").orderBy("rank").collect()
    assert hybrid[0]["content"].startswith("word7 ") and hybrid[0]["score"] < 0 < hybrid[1]["score"] + 1
    tests = search.search(q, search.Index(chunks), search.SearchOptions(limit=40, threshold=2.0, include_tests=True, deduplicate=False, rerank_top_k=99)).where("query_id = 1").collect()
    assert any(r["is_test"] for r in tests)

    class Lengths:
        def score(self, pairs):
            return pairs.withColumn("logit", F.length("content").cast("double"))

    terms = q.select("query_id", F.lit(0).alias("term_idx"), F.col("embedding").alias("term_vec"))
    segs = chunks.select(F.col("id").alias("chunk_id"), F.lit(0).alias("segment_idx"), F.col("embedding").alias("segment_vec"))
    opts = search.SearchOptions(limit=5, threshold=2.0, use_rerank=True, use_late=True)
    fused = search.search(q, search.Index(chunks, segs), opts, terms, Lengths()).where("query_id = 1").orderBy("rank").collect()
    assert 0 < len(fused) <= 5 and [r["score"] for r in fused] == sorted(r["score"] for r in fused)
    files_ = chunks.groupBy("file_path").agg(F.first("embedding").alias("embedding"))
    meta = search.search(q, search.Index(chunks, files=files_), search.SearchOptions(limit=5, threshold=2.0)).where("query_id = 2").collect()
    assert meta


def test_datasets_and_tool_output(spark, tmp_path):
    data = {"name": "n", "queries": [{"query": "q1", "category": "c", "judgments": [{"file": "a.go", "rel": 2}, {"file": "b.go", "rel": 0}], "grep_patterns": ["x"]}, {"query": "q2", "category": "c", "judgments": [], "grep_patterns": []}]}
    (tmp_path / "d.json").write_text(json.dumps(data, indent=1))
    assert sorted((r["query_id"], r["file"], r["rel"]) for r in results.read_dataset(spark, str(tmp_path / "d.json")).collect() if r["file"]) == [(0, "a.go", 2), (0, "b.go", 0)]
    lines = spark.createDataFrame([(1, 1, "x/a.go:10-20"), (1, 2, "y/a.go:1-2"), (1, 3, "C:\\q\\b.go:5: text"), (1, 4, ""), (1, 5, "c.go")], "query_id int, line_no int, line string")
    assert [(r["file"], r["rank"]) for r in results.parse_lines(lines).orderBy("rank").collect()] == [("x/a.go", 1), ("C:\\q\\b.go", 2), ("c.go", 3)]
    out = spark.createDataFrame([(1, '[{"file":"a/x.go","start":1},{"file":"b/x.go"},{"file":"y.go"}]')], "query_id int, output string")
    assert [r["file"] for r in results.parse_json(out).orderBy("rank").collect()] == ["a/x.go", "y.go"]
