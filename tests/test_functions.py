import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.functions import paths as P
from seamark.functions import quantize as Q
from seamark.functions import text as T
from seamark.functions import vector as V
from seamark.functions.embedding import HashingEmbedder, HttpEmbedder, HttpReranker, parse_embeddings, parse_scores, rerank_top


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("a,b,cos,l2,dot", [([1.0, 0.0], [1.0, 0.0], 0, 0, 1), ([1.0, 0.0], [0.0, 1.0], 1, 2**0.5, 0), ([1.0, 0.0], [-1.0, 0.0], 2, 2, -1), ([1.0, 0.0], [1.0, 1.0], 1 - 2**-0.5, 1, 1), ([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], None, 27**0.5, 32), ([3.0, 4.0], [0.0, 0.0], V.FAR, 5, 0), ([1.0], [1.0, 2.0], V.FAR, V.FAR, 0)])
def test_vector_math(spark, a, b, cos, l2, dot):
    x, y = F.col("a"), F.col("b")
    if cos is not None:
        assert one(spark, V.cosine_distance(x, y), a=a, b=b) == pytest.approx(cos)
        assert one(spark, V.cosine_similarity(x, y), a=a, b=b) == pytest.approx(0 if cos == V.FAR else 1 - cos)
    assert one(spark, V.l2_distance(x, y), a=a, b=b) == pytest.approx(l2)
    assert one(spark, V.dot(x, y), a=a, b=b) == pytest.approx(dot)


def test_normalise_and_top_k(spark):
    assert one(spark, V.normalise(F.col("a").cast("array<float>")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalise(F.col("a").cast("array<float>")), a=[0.0, 0.0]) == [0, 0]
    assert one(spark, V.top_k_indices(F.col("a"), 2), a=[3.0, 1.0, 2.0, 1.0]) == [1, 3]
    assert one(spark, V.parse_vector(F.col("s")), s="[1,2.5,-3e-1]") == pytest.approx([1, 2.5, -0.3])


def test_quantisers(spark):
    v = [-1.0, -0.5, 0.0, 0.5, 1.0]
    assert one(spark, Q.int8_unit(F.col("a")), a=v) == [-127, -63, 0, 63, 127]
    r = one(spark, Q.int8_minmax(F.col("a"), True), a=v)
    assert r["q"] == [-128, -64, 0, 63, 127] and r["min"] == -1
    back = one(spark, Q.from_int8_minmax(Q.int8_minmax(F.col("a"))["q"], Q.int8_minmax(F.col("a"))["scale"], Q.int8_minmax(F.col("a"))["min"]), a=v)
    assert np.abs(np.array(back) - v).max() < 2 / 255
    assert one(spark, Q.int8_minmax(F.col("a"))["scale"], a=[2.0, 2.0]) == pytest.approx(1 / 255)
    for bits, want in (([1.0] * 8, b"\xff"), ([-1.0] * 8, b"\x00"), ([1.0, -1.0] * 4, b"\xaa"), ([1.0] * 8 + [0.0] * 8, b"\xff\x00")):
        assert bytes(one(spark, Q.binary_bytes(F.col("a")), a=bits)) == want
        assert one(spark, Q.from_binary_words(Q.binary_words(F.col("a")), len(bits)), a=bits) == [1 if x > 0 else -1 for x in bits]
    assert one(spark, Q.hamming(Q.binary_words(F.col("a")), Q.binary_words(F.col("b"))), a=[1.0] * 40, b=[1.0, -1.0] * 20) == 20
    assert [Q.parse_mode(x) for x in ("INT8", "scalar", "bit", "binary", "x")] == ["int8", "int8", "binary", "binary", "none"]
    q = Q.int8_minmax(F.col("a"), True)
    assert one(spark, Q.mixed_dot(F.col("b"), q["q"], q["scale"], q["min"]), a=v, b=[1.0, 2.0, 3.0, 4.0, 5.0]) == pytest.approx(5, abs=0.05)


@pytest.mark.parametrize("query,want", [("how does the authentication work", "authentication OR work"), ("error handling, logging, and metrics", "error OR handling OR logging OR metrics"), ("how is the", ""), ("rate-limit", '"rate-limit"'), ('say"hello"', 'say"hello'), ('a"b"c', '"a""b""c"')])
def test_search_terms(spark, query, want):
    got = one(spark, T.search_terms(F.col("q")), q=query)
    assert got == want or (query.startswith("say") and got == '"say""hello"')


@pytest.mark.parametrize("query,low,high", [("error handling", 2, 5), ("how does authentication work", 3, 8), ("x", 1, 2), ("", 0, 0), ("one two three four five six seven eight nine", 8, 8)])
def test_query_terms(spark, query, low, high):
    got = one(spark, T.query_terms(F.col("q")), q=query)
    assert low <= len(got) <= high and len(set(got)) == len(got)


def test_tokens_and_estimates(spark):
    assert one(spark, T.tokens(F.col("t")), t="Hello World func_name CamelCase 123abc") == ["hello", "world", "func", "name", "camelcase", "123abc"]
    assert one(spark, T.estimate_tokens(F.col("t")), t="hello") == 1
    assert one(spark, T.estimate_tokens(F.col("t")), t="a b c d e") == 6
    assert one(spark, T.truncate_at_boundary(F.col("t"), 20), t="0123456789 012345\n7890123") == "0123456789 012345"
    assert one(spark, T.truncate_at_boundary(F.col("t"), 20), t="0123456789 0123456789012") == "0123456789 012345678", "a space at half: a hard cut"
    assert one(spark, T.truncate_at_boundary(F.col("t"), 20), t="0123456789a 123456789012") == "0123456789a"
    assert one(spark, T.truncate_at_boundary(F.col("t"), 20), t="01234 6789012345678901234") == "01234 67890123456789"
    assert one(spark, T.truncate_to_tokens(F.col("t"), 4), t="abcdefgh ijklmno") == "abcdefgh"
    assert one(spark, T.format_bytes(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, T.format_bytes(F.col("n")), n=12) == "12 B"


@pytest.mark.parametrize("path,want", [("a/x_test.go", 1), ("Latest.java", 1), ("x.test.ts", 1), ("test_a.py", 1), ("a/test_a.go", 0), ("a/tests/x.go", 1), ("tests/x.go", 0), ("a/spec/b/x.go", 1), ("a/contest/x.go", 0), ("x_spec.rb", 1), ("main.go", 0)])
def test_test_files(spark, path, want):
    assert one(spark, P.is_test_file(F.col("p")), p=path) == bool(want)


@pytest.mark.parametrize("path,want", [("node_modules/x.js", 1), ("a/vendor/b.go", 1), ("x.min.js", 1), ("package-lock.json", 0), ("go.sum", 0), (".git/config", 1), ("distance/x.go", 0), (".", 0), ("a/build/x", 1)])
def test_ignore_rules(spark, path, want):
    assert one(spark, P.should_ignore(F.col("p")), p=path) == bool(want)
    assert one(spark, P.should_ignore(F.col("p"), ["*.t?t", "[ab]*"]), p="q/bx") is True


@pytest.mark.parametrize("path,want", [(".worktrees/f/pkg/a.go", "pkg/a.go"), (".worktrees/branch", ".worktrees/branch"), ("pkg/a.go", "pkg/a.go"), ("r/.worktrees/f/.worktrees/g/a", ".worktrees/g/a")])
def test_canonical_path(spark, path, want):
    assert one(spark, P.canonical_path(F.col("p")), p=path) == want


def test_smart_skip(spark):
    got = {p: one(spark, P.should_smart_skip(F.col("p")), p=p) for p in ("a/x.pb.go", "mydocs/a.go", "a.md", "a/b.go", "x.d.ts", "testdata/q.go")}
    assert got == {"a/x.pb.go": True, "mydocs/a.go": True, "a.md": True, "a/b.go": False, "x.d.ts": True, "testdata/q.go": True}


def test_services(spark):
    assert parse_embeddings('[{"index":1,"embedding":[[3,4]]},{"index":0,"embedding":[[1,0]]}]', 2) == [[1, 0], [3, 4]]
    assert parse_embeddings('{"embedding":[1,2]}', 1) == [[1, 2]]
    assert parse_scores('{"results":[{"index":1,"relevance_score":0.5},{"index":7,"relevance_score":1}]}', 2) == [None, 0.5]

    def send(url, payload):
        import json

        texts = payload["content"]
        if len(texts) > 1 or len(texts[0]) > 6:
            raise ValueError("too long")
        return json.dumps([{"index": i, "embedding": [[float(len(t)), 0.0]]} for i, t in enumerate(texts)])

    df = spark.createDataFrame([(1, "abc"), (2, "abcdefgh"), (3, "abc"), (4, None), (5, "abcdefghijklmnopqrstuvwxyz")], "id long, text string")
    embedder = HttpEmbedder("u", 2, send=send)
    assert embedder.stats() == (0, 0)
    embedder.count(spark)
    got = {r["id"]: r["embedding"] for r in embedder.embed(df, "text").collect()}
    assert got == {1: [1, 0], 2: [1, 0], 3: [1, 0], 4: None, 5: None}
    assert embedder.stats() == (3, 1)

    def rank(url, payload):
        import json

        return json.dumps({"results": [{"index": i, "relevance_score": float(len(d))} for i, d in reversed(list(enumerate(payload["documents"])))]})

    pairs = spark.createDataFrame([(1, i, "q", "x" * i) for i in range(1, 5)], "query_id long, id long, query string, content string")
    top = rerank_top(HttpReranker("u", rank).score(pairs), 2).orderBy("rank").collect()
    assert [(r["id"], r["logit"]) for r in top] == [(4, 4.0), (3, 3.0)]


def test_hashing_embedder(spark):
    df = spark.createDataFrame([("a b",), ("b a",), ("",)], "t string")
    rows = HashingEmbedder(16).embed(df, "t").collect()
    assert rows[0]["embedding"] == rows[1]["embedding"] and np.linalg.norm(rows[0]["embedding"]) == pytest.approx(1, abs=1e-5)
    assert not any(rows[2]["embedding"])


def test_embedding_in_batches_is_the_expression(spark):
    from seamark.functions.embedding import HashingEmbedder
    from xxhash import xxh64

    texts = ["a b", "b A  b, c", "", None, "x " * 3000, "\u00e9t\u00e9 d1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = HashingEmbedder(16)
    both = e.embed(df.withColumn("want", e.vector(F.col("t"))), "t").collect()
    assert all(r["embedding"] == pytest.approx(r["want"], abs=1e-6) for r in both)
    for r in both:  # and by hand: signed counts of xxHash64 of the tokens, of unit length
        v = np.zeros(16)
        for w in re.findall(r"[^\W_]+", (r["t"] or "").lower()):
            h = xxh64(w.encode(), 42).intdigest()
            h -= (h >> 63) << 64
            v[h % 16] += 1 if h >> 40 & 1 else -1
        assert np.allclose(r["embedding"], v / (np.linalg.norm(v) or 1), atol=1e-6)


def test_segments_are_the_rule_line_by_line(spark):
    from seamark.operators import segments as S

    def plain(text):
        out, held, size = [], [], 0
        for line in map(str.strip, text.strip().split("\n")):
            if size > 20 and (not line or line.startswith(("func ", "type ", "//", "def ", "class ", "#"))):
                out, held, size = [*out, " ".join(held)], [], 0
            if line:
                held, size = [*held, line], size + len(line.encode())
                if size > 200:
                    out, held, size = [*out, " ".join(held)], [], 0
        out += [" ".join(held)] * (size > 10)
        step = max(1, len(out) // 8)
        return out if len(out) <= 10 else [out[0], *[out[i] for i in range(step, len(out) - 1, step)][:8], out[-1]]

    rng = np.random.default_rng(6)
    lines = ["", "  ", "func f() {", "# a title", "short", "a line of some words here", "w" * 150, "\u00e9" * 90, "// note", "class X:", "\t tabbed \t"]
    texts = ["\n".join(rng.choice(lines, rng.integers(0, 120))) for _ in range(60)] + ["", " \n ", "x", "only ten b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", S.segments(F.col("t")).alias("s")).collect()
    assert {r["id"]: r["s"] for r in rows} == {i: plain(t) for i, t in enumerate(texts)}
    assert one(spark, S.segments(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("rerank,late", [(False, False), (True, False), (False, True), (True, True)])
@pytest.mark.parametrize("hybrid", [False, True])
def test_fusion_weights_sum_to_one(rerank, late, hybrid):
    from seamark.operators.fusion import weights

    for intent in ("conceptual", "definition", "procedural", "example", "other"):
        w = weights(intent, hybrid, rerank, late, 0.4, 0.2)
        assert sum(w) == pytest.approx(1) and min(w) >= 0
    if rerank and not late and not hybrid:
        assert weights("procedural", False, True, False, 0.4) == pytest.approx((0.6, 0.4, 0.0))


def test_metadata_as_json(spark):
    from seamark.sources.store import metadata_json, parse_metadata

    df = spark.createDataFrame([({"a": "1", "b": 'x"y'},), ({},), (None,)], "m map<string,string>")
    said = [r["j"] for r in df.select(metadata_json(F.col("m")).alias("j")).collect()]
    assert said == ['{"a":"1","b":"x\\"y"}', "", ""]
    back = spark.createDataFrame([(x,) for x in [*said, "{broken", None]], "j string").select(parse_metadata(F.col("j")).alias("m")).collect()
    assert [r["m"] for r in back] == [{"a": "1", "b": 'x"y'}, {}, {}, {}, {}]


def test_a_vectors_norm_and_range_are_made_once(spark):
    """Within a lambda function what it names is made for each element: work by the cube of the dimensions."""
    v = spark.createDataFrame([([3.0, 4.0],), (None,), ([0.0, 0.0],)], "a array<float>")
    made = v.select(Q.int8_minmax(V.normalise(F.col("a"))).alias("q"), V.normalise(F.col("a")).alias("n"))
    said = made._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("sqrt(") + said.count("SQRT(") == 2 and said.count("array_max(") == 2
    rows = made.collect()
    assert rows[0]["n"] == pytest.approx([0.6, 0.8]) and rows[0]["q"]["q"] == [-128, 127]
    assert rows[1]["n"] is None and rows[1]["q"]["q"] is None and rows[2]["n"] == [0, 0]
