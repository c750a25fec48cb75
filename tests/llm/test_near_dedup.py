import random
import re

import numpy as np
import pyarrow as pa
import pytest

from seamark.llm import common, near_dedup
from seamark.llm.components import connected_components
from seamark.llm.near_dedup import _block_links, keep_one, near_duplicates, op2_minhash_near_dedup, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=2):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return ({tuple(w)} if w else set()) if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size=2):
    sets = [(d, shingles(t, size)) for d, t in rows]
    least = {d: d for d, _ in rows if d is not None}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y:
                c = len(x & y)
                if 100 * c >= 80 * (len(x) + len(y) - c):
                    p, q = sorted((top(a), top(b)))
                    least[q] = p
    return sorted(((d, len(x), None if d is None else top(d), d is None or top(d) == d) for d, x in sets), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf, documents):
    assert found(op2_minhash_near_dedup(spark, sf)) == brute(documents)


@pytest.mark.parametrize("size", [2, 5])
def test_odd_rows(spark, odd, odd_rows, none, size):
    assert found(near_duplicates(odd, size)) == brute(odd_rows, size)
    assert near_duplicates(none, size).count() == 0
    kept = keep_one(odd, size)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, *_, k in brute(odd_rows, size) if k), key=str)


def test_five_words_are_the_rule_elsewhere(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "a b c d e f g h i x"), (4, "a b")]
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 5)


def test_pivots_and_buckets_with_many_rows(spark, monkeypatch):
    """Keys with more rows than a task takes are dealt to several, and nothing changes."""
    for module, name in ((near_dedup, "PARTNERS"), (common, "KEY_ROWS")):
        monkeypatch.setattr(module, name, 7)
    monkeypatch.setattr(common.dealt, "__defaults__", tuple(7 if x == 20_000 else x for x in common.dealt.__defaults__))
    monkeypatch.setattr(common.join_dealt, "__defaults__", tuple(7 if x == 20_000 else x for x in common.join_dealt.__defaults__))
    texts = copies(9, [f"w{i}" for i in range(60)], 60, 9) + ["same text as others have"] * 30
    rows = list(enumerate(texts)) + [(3, texts[3]), (4, "another text under a known id")]
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == brute(rows)


def copies(seed, base, n, most):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("small", "size"), [(64, 2), (3, 2), (0, 2), (0, 5)])
def test_families_of_copies(spark, monkeypatch, small, size):
    """Copies with up to 16 of 100 words changed: some pairs are links, some are not, components are chains."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    texts = [t for s in range(3) for t in copies(s, [f"w{s}_{i}" for i in range(100)], 70, 17)]
    random.Random(5).shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:20])]
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size)) == brute(rows, size)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7), (None, 3)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            top[q] = p
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(top)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_count_distinct_shingles():
    texts = ["a B a b", "", None, " x ", "x", "x x", "x x x", "ß Ü\tü\x0b", "a" * 3_000_000 + " b"]
    for size in (2, 5):
        assert [len(s) for s in shingle_sets(texts, size)] == [len(shingles(t, size)) for t in texts]
    sets = shingle_sets(["x", "X", "x x"], 2)
    assert (sets[0] == sets[1]).all() and sets[0][0] != sets[2][0]


def test_block_links():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    of = [i % 9 for i in range(30)]
    rows = pa.table({"outside": [i < 12 for i in range(30)], "id": list(range(30)), "of": of, "shingles": [s.tobytes() for s in sets]})
    got = _block_links(rows, 80)
    want = {(i, of[j]) for i in range(12) for j in range(12, 30) if of[i] != of[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert {(a, of[b]) for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist())} == want
