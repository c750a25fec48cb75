import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.client import Client
from seamark.functions.embedding import HashingEmbedder
from seamark.operators import knn, lexical, maxsim, metrics, search
from seamark.shared import local_rows
from seamark.sources import files, qrels, results
from seamark.sources import store as S
from seamark.sources.store import Buffer, Store

CHUNK = "id string, file_path string, content string, start_line int, end_line int, embedding array<float>, metadata map<string,string>, is_test boolean"


def chunk(path, n, text, v=(3.0, 4.0)):
    return (f"{path}:chunk_{n}", path, text, n, n + 4, list(v), {"description": text}, False)


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), CHUNK)


def live(store, table, *columns):
    return sorted(tuple(r) for r in store.read(table).select(*columns).collect())


def postings(store):
    """Of the index as it is, and made from the live chunks."""
    kept = live(store, "postings", "term", "id", "tf", "dl")
    tokens = lexical.document_tokens(store.read("chunks"), "id", ["content", "file_path"])
    made = sorted(tuple(r) for r in lexical.placed_postings(tokens).select("term", "id", "tf", "dl").collect())
    return kept, made


@pytest.mark.parametrize("most", [16, 2])
def test_commits_replace_and_delete_all_that_belongs_to_a_file(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_VERSIONS", most)
    store = Store(spark, str(tmp_path / "i"))
    assert store.read("chunks").count() == 0 and store.stats() == (0, 0, 0)
    store.upsert_chunks(chunks(spark, chunk("a", 1, "one two two"), chunk("a", 2, "three"), chunk("b", 1, "two", (0.0, 2.0)), chunk("c", 1, "four")))
    store.replace_segments(store.read("chunks").select(F.col("id").alias("chunk_id"), F.lit(0).alias("segment_idx"), F.col("content").alias("text"), F.col("embedding").alias("segment_vec")))
    store.upsert_chunks(chunks(spark, chunk("a", 1, "five"), chunk("d", 1, "one one")))
    assert live(store, "chunks", "id", "content") == [("a:chunk_1", "five"), ("b:chunk_1", "two"), ("c:chunk_1", "four"), ("d:chunk_1", "one one")]
    assert live(store, "segments", "chunk_id") == [("a:chunk_1",), ("b:chunk_1",), ("c:chunk_1",)], "segments of a chunk that vanished are gone"
    store.delete_files(spark.createDataFrame([("b",), ("nowhere",)], "file_path string"))
    assert live(store, "chunks", "id") == [("a:chunk_1",), ("c:chunk_1",), ("d:chunk_1",)]
    assert live(store, "files", "file_path", "chunk_count") == [("a", 1), ("c", 1), ("d", 1)]
    assert live(store, "segments", "chunk_id") == [("a:chunk_1",), ("c:chunk_1",)]
    kept, made = postings(store)
    assert kept == made and len(kept) > 8
    stats = store.lexical_index().stats().first()
    assert stats["n_docs"] == 3 and stats["avgdl"] == pytest.approx(sum(x for (x,) in live(store, "lengths", "dl")) / 3)
    store.compact()
    assert len(list((tmp_path / "i").glob("v*"))) == 1 and len(list((tmp_path / "i" / "manifests").glob("*.json"))) == 1
    assert live(store, "chunks", "id") == [("a:chunk_1",), ("c:chunk_1",), ("d:chunk_1",)] and postings(store)[0] == made
    assert live(store, "segments", "chunk_id") == [("a:chunk_1",), ("c:chunk_1",)]


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"))
    store.upsert_chunks(chunks(spark, chunk("a", 1, "one")))
    bad = chunks(spark, chunk("b", 1, "two"), chunk("a", 1, "x")).withColumn("content", F.when(F.col("file_path") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        store.upsert_chunks(bad)
    assert live(store, "chunks", "id", "content") == [("a:chunk_1", "one")] and live(store, "files", "file_path") == [("a",)]
    store.upsert_chunks(chunks(spark, chunk("b", 1, "two")))
    assert live(store, "chunks", "id") == [("a:chunk_1",), ("b:chunk_1",)]


def test_only_touched_files_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"))
    store.upsert_chunks(chunks(spark, *[chunk(f"f{i}", 1, f"text {i}") for i in range(50)]))
    store.upsert_chunks(chunks(spark, chunk("f7", 1, "other")))
    assert spark.read.parquet(str(tmp_path / "i" / "v2" / "chunks")).count() == 1
    assert spark.read.parquet(str(tmp_path / "i" / "v2" / "files")).count() == 1
    assert store.stats()[:2] == (50, 50)


@pytest.mark.parametrize("mode", ["none", "int8", "binary"])
def test_vectors_are_kept_and_searched_by_the_mode(spark, tmp_path, mode):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 32))
    store = Store(spark, str(tmp_path / "i"), mode)
    store.upsert_chunks(chunks(spark, *[chunk(f"f{i}", 1, "t", v) for i, v in enumerate(x.tolist())]))
    kept = store.read("chunks").first()
    assert [kept[c] is not None for c in ("embedding", "embedding_i8", "embedding_bits")] == [mode == "none", mode == "int8", mode == "binary"]
    assert Store(spark, str(tmp_path / "i")).mode == mode, "a store keeps its mode"
    q = spark.createDataFrame([(i, x[i].tolist()) for i in (3, 5)], "query_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in store.nearest(q, 4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in (3, 5):
        assert got[i, 1] == (f"f{i}:chunk_1", pytest.approx(0, abs=1e-2))
        if mode == "binary":
            bits = ((x > 0) != (x[i] > 0)).mean(1)
            assert [got[i, k + 1][1] for k in range(4)] == pytest.approx(sorted(bits)[:4])
        else:
            assert [got[i, k + 1][1] for k in range(4)] == pytest.approx(sorted(1 - u @ u[i])[:4], abs=0.02)
    assert store.nearest(q, 9, 0.3).where("distance > 0.3").count() == 0
    assert store.compute_file_vectors() == 60 and len(store.read("files").first()["embedding"]) == 32


def test_buffered_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"))
    buffer = Buffer(store, most=4)
    buffer.upsert(chunks(spark, chunk("a", 1, "one"), chunk("b", 1, "two")))
    buffer.delete(spark.createDataFrame([("a",)], "file_path string"))
    assert store.read("chunks").count() == 0, "nothing is written before a flush"
    assert sorted(r["id"] for r in buffer.read("chunks").collect()) == ["b:chunk_1"]
    buffer.delete(spark.createDataFrame([("b",)], "file_path string"))
    buffer.upsert(chunks(spark, chunk("b", 1, "three")))
    buffer.upsert(chunks(spark, chunk("c", 1, "four")))
    buffer.upsert(chunks(spark, chunk("c", 1, "five")))
    assert not buffer.held and live(store, "chunks", "id", "content") == [("b:chunk_1", "three"), ("c:chunk_1", "five")]
    buffer.flush()


def test_preindex_exports_and_fallback(spark, tmp_path):
    e = HashingEmbedder(16)
    store = Store(spark, str(tmp_path / "i"))
    text = "def read_file(path):\n    return open(path).read()\n\ndef write_file(path, data):\n    open(path, 'w').write(data)\n"
    store.upsert_chunks(e.embed(chunks(spark, chunk("a", 1, text), chunk("b", 1, "")).drop("embedding"), "content"))
    assert store.preindex(e) == 1 and store.preindex(e) == 0
    assert [x for (x,) in live(store, "segments", "segment_idx")] == [0, 1]
    store.export_segments(str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    store.export_vectors(str(tmp_path / "v"))
    some = spark.createDataFrame([("a:chunk_1",)], "id string")
    assert S.read_vectors(spark, str(tmp_path / "v")).count() == 2 and S.read_vectors(spark, str(tmp_path / "v"), some).count() == 1
    terms = e.embed(spark.createDataFrame([(1, 0, "read file path")], "query_id long, term_idx int, term string"), "term", "term_vec")
    asked = spark.createDataFrame([(1, "a:chunk_1"), (1, "new"), (1, "empty")], "query_id long, chunk_id string")
    scored = maxsim.maxsim(terms, store.read("segments"), asked)

    def make(ids):
        return ids.where("chunk_id = 'new'").crossJoin(terms.select(F.lit(0).alias("segment_idx"), F.col("term_vec").alias("segment_vec")).limit(1))

    got = {r["chunk_id"]: r["maxsim"] for r in maxsim.with_fallback(scored, asked, make, terms).collect()}
    assert got["new"] == pytest.approx(1, abs=1e-6) and got["empty"] == 0 and 0 < got["a:chunk_1"] <= 1.01


def test_client(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"a/read.py": "def read_config(path):\n    return parse_config(open(path).read(), strict=True)\n", "a/write.py": "def write_report(rows):\n    return sum(len(r) for r in rows) + count_lines(rows)\n", "b.md": "# Overview\nreport writer"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    client = Client(spark, str(root), str(tmp_path / "home"))
    assert client.index() == {"processed": 3, "errors": 0, "removed": 0, "chunks": 3}
    assert [r["path"] for r in files.repositories(spark, str(tmp_path / "home")).collect()] == [str(root)]
    found = client.search("read config path", limit=2, threshold=1.5).orderBy("rank").collect()
    assert found[0]["file"] == "a/read.py" and found[0]["content"].startswith("def read_config")
    assert client.search("read config path", threshold=0.0001).count() == 0
    assert client.preindex() == 3 and client.store.has_segments()
    late = client.search(spark.createDataFrame([(7, "write report rows"), (8, "what does this repo do")], "query_id long, query string"), 2, 1.5, search.SearchOptions(use_hybrid=True, use_late=True))
    assert late.where("query_id = 7 and rank = 1").first()["file"] in ("a/write.py", "b.md")
    (root / "b.md").unlink()
    assert client.index()["removed"] == 1 and live(client.store, "files", "file_path") == [("a/read.py",), ("a/write.py",)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"file_path": "a/write.py", "op": "delete", "at": "2020-01-01T00:00:00Z", "content": None}))
    client.watch(str(tmp_path / "in"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert live(client.store, "files", "file_path") == [("a/read.py",)]
    client.close()


def test_large_trees_skip_low_value_files(spark, tmp_path, monkeypatch):
    for name in ("a.go", "a_test.go", "x.pb.go", "docs/b.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("package a")
    assert files.scan(spark, str(tmp_path)).count() == 4
    monkeypatch.setattr(files.P, "MANY_FILES", 3)
    assert [r["file_path"] for r in files.scan(spark, str(tmp_path)).collect()] == ["a.go"]
    assert files.scan(spark, str(tmp_path), smart_skip=False).count() == 4


def test_repositories(spark, tmp_path):
    for i, text in enumerate(['{"path": "/a", "indexed_at": "t"}', "{broken", '{"other": 1}']):
        (tmp_path / "repos" / str(i)).mkdir(parents=True)
        (tmp_path / "repos" / str(i) / "metadata.json").write_text(text)
    assert [(r["path"], r["indexed_at"]) for r in files.repositories(spark, str(tmp_path)).collect()] == [("/a", "t")]


def test_search_goes_to_an_index_when_there_are_many_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=24)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = spark.createDataFrame(rows[:10], "query_id long, embedding array<float>")
    a, b = (sorted((r["query_id"], r["rank"], r["id"]) for r in knn.search(q, df, 5, 1.0, exact_below=n).collect()) for n in (50_000, 100))
    assert len(b) == 50 and len(set(a) & set(b)) >= 45
    assert knn.search(q, df, 5, 0.0001, exact_below=100).count() <= 10
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [2.0, 0.1])], "id long, embedding array<float>")
    one = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    for found in (knn.ListIndex(odd, 2).search(one, 3, 2), knn.SketchIndex(odd).search(one, 3)):
        assert [r["id"] for r in found.orderBy("rank").collect()] == [1, 5, 4]
    none = odd.where("false")
    assert knn.ListIndex(none, 4).search(one, 3).count() == 0 and knn.SketchIndex(none).search(one, 3).count() == 0


def test_printed_styles(spark):
    rows = spark.createDataFrame([(1, 2, "b.go", 3, 9, 0.5, "x", False), (1, 1, "a.go", 1, 2, 0.25, "l1\n" + "y" * 90 + "\nl3\nl4\nl5\nl6", True)], "query_id long, rank int, file string, start int, end int, score double, content string, is_test boolean")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    said = {s: {r["query_id"]: r["output"] for r in S.printed(rows, s, asked).collect()} for s in ("default", "quiet", "context", "json")}
    assert said["default"] == {1: "a.go:1-2\nb.go:3-9", 2: "No results found"}
    assert said["quiet"][1] == "a.go\nb.go"
    assert said["context"][1] == "a.go:1-2 (0.25)\nl1\n" + "y" * 77 + "...\nl3\nl4\nl5\nb.go:3-9 (0.50)\nx"
    assert [r["file"] for r in json.loads(said["json"][1])] == ["a.go", "b.go"] and said["json"][2] == "[]"


def test_dataset_run_and_report(spark, tmp_path):
    dataset = spark.createDataFrame([(0, "find the reader", "p/a.go", 2), (0, "find the reader", "p/b.go", 1), (1, "no judgments", None, None)], "query_id long, query string, file string, rel int")
    lines = local_rows(spark, {"content": (["alpha reader", "beta", "reader beta", "x.y", "xzy"], results.pa.string()), "file_path": ([f"p/{c}.go" for c in "abcde"], results.pa.string())})
    patterns = spark.createDataFrame([(0, 0, "alpha"), (0, 1, "reader"), (0, 2, "beta"), (1, 0, "nothing"), (2, 0, "x\\.y"), (2, 1, "x.y")], "query_id long, ord int, pattern string")
    found = results.grep(lines, patterns, 2)
    assert sorted((r["query_id"], r["rank"], r["file_path"]) for r in found.collect()) == [(0, 1, "p/a.go"), (0, 2, "p/c.go"), (2, 1, "p/d.go"), (2, 2, "p/e.go")]
    tried = results.attempts(patterns, found, 2)
    assert {r["query_id"]: r["attempts"] for r in tried.collect()} == {0: 2, 1: 1, 2: 2}
    rows = found.select(F.lit("grep").alias("tool"), "query_id", F.col("file_path").alias("file"), "rank").where("query_id < 2").unionByName(spark.createDataFrame([("engine", 0, "x/b.go", 1)], "tool string, query_id long, file string, rank int"))
    per, sums = metrics.run_dataset(dataset, rows, tried.withColumn("tool", F.lit("grep")))
    got = {(r["tool"], r["query_id"]): (r["mrr"], r["r_5"], r["tokens"]) for r in per.collect()}
    assert got == {("grep", 0): (1.0, 0.5, 2 * 2 + 20), ("engine", 0): (1.0, 0.5, 3 + 10)}
    results.save_report(spark, str(tmp_path / "report.json"), "d", "2020-01-01T00:00:00Z", per, sums)
    said = json.loads((tmp_path / "report.json").read_text())
    assert said["tools"] == ["engine", "grep"] and len(said["results"]) == 2 and (tmp_path / "report.json").read_text().startswith('{\n  "dataset"')


def test_banners_are_no_results(spark):
    lines = spark.createDataFrame([(1, 0, "[DEBUG] Search completed: 1 results in 4ms"), (1, 1, "\x1b[1mFound 3 results\x1b[0m"), (1, 2, "-----"), (1, 3, "src/a.go:1-2")], "query_id int, line_no int, line string")
    assert [r["file"] for r in results.parse_lines(lines).collect()] == ["src/a.go"]


def test_sampled_corpus_holds_all_judged(spark):
    docs = spark.range(2000).withColumnRenamed("id", "doc_id")
    rels = spark.createDataFrame([(1, 5, 1), (1, 6, 0), (2, 1999, 2)], "query_id long, doc_id long, rel int")
    got = {r["doc_id"] for r in qrels.corpus(docs, rels, "sampled").collect()}
    assert {5, 1999} <= got and 120 < len(got) < 290 and got == {r["doc_id"] for r in qrels.corpus(docs.repartition(5), rels, "sampled").collect()}
    assert qrels.corpus(docs, rels, "full").count() == 2000 and {r["doc_id"] for r in qrels.corpus(docs, rels).collect()} == {5, 1999}
    with pytest.raises(ValueError):
        qrels.corpus(docs, rels, "other")


def test_ranks_within_groups(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.integers(0, 50, 700)] + [("b", 1.0)] * 400 + [("c", 3.0), (None, 2.0), (None, 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = metrics.ranked_in_groups(df, "g", "v").collect()
    for g in ("a", "b", "c", None):
        mine = sorted((r["i"], r["v"]) for r in at if r["g"] == g)
        want = sorted(v for x, v in rows if x == g)
        assert [i for i, _ in mine] == list(range(len(want))) and [v for _, v in mine] == want
    got = {r["g"]: r["p"] for r in metrics.quantiles(df, "g", "v", {"p": 0.3}).collect()}
    assert got["a"] == pytest.approx(np.quantile([v for g, v in rows if g == "a"], 0.3)) and got["c"] == 3.0 and "d" not in got


def test_postings_left_out_are_made_by_the_first_lexical_search(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"))
    store.upsert_chunks(chunks(spark, chunk("a", 1, "one two two"), chunk("b", 1, "three")))
    store.upsert_chunks(chunks(spark, chunk("a", 1, "four"), chunk("c", 1, "five five"), chunk("d", 1, "six")), postings=False)
    assert not (tmp_path / "i" / "v2" / "postings").exists()
    store.delete_files(spark.createDataFrame([("d",)], "file_path string"))
    assert store.lexical_index().stats().first()["n_docs"] == 3
    kept, made = postings(store)
    assert kept == made and len(kept) > 6
    n = store._manifest()[2]
    store.lexical_index()
    assert store._manifest()[2] == n, "nothing is left to make"
    store.delete_files(spark.createDataFrame([("c",)], "file_path string"))
    assert postings(store)[0] == postings(store)[1]


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_version_that_nothing_ended_is_read_without_a_join(spark, tmp_path):
    store = Store(spark, str(tmp_path / "i"))
    store.upsert_chunks(chunks(spark, chunk("a", 1, "one"), chunk("b", 1, "two")), postings=False)
    assert "Join" not in plan(store.read("chunks"))
    store.upsert_chunks(chunks(spark, chunk("a", 1, "three")))
    assert live(store, "chunks", "content") == [("three",), ("two",)]


def test_segments_need_no_postings(spark, sf, tmp_path, monkeypatch):
    from seamark.plans import catalog, text_queries

    monkeypatch.setattr(text_queries, "new_folder", lambda spark, label: f"file://{tmp_path}/{label}")
    assert catalog.QUERIES["stored_segments"](spark, sf).count() > 0
    assert list(tmp_path.glob("store/v*/segments")) and not list(tmp_path.glob("store/v*/postings"))
