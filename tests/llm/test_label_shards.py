import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.llm import common
from seamark.llm.label_shards import accepted, op9_label_shards, propagate, quotas, shard_documents


def check_law(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[s]) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(sizes) - min(sizes) <= 1


def broken(rows):
    """Groups of equal texts, and those in more shards than they need."""
    of = defaultdict(Counter)
    for r in rows:
        of[bytes(r["content"]) if r["content"] is not None else object()][r["shard"]] += 1
    groups = [c for c in of.values() if sum(c.values()) > 1]
    return len(groups), sum(len(c) > 1 for c in groups)


def test_query_against_brute_force(spark, documents):
    import duckdb

    sf = "/root/testdata/sf0.01"
    rows = op9_label_shards(spark, sf).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    check_law(rows, 24)
    groups, cut = broken(shard_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    assert groups > 20 and cut <= groups // 10


def test_odd_rows(spark, odd, odd_rows, none):
    rows = shard_documents(odd, 4).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in odd_rows)
    check_law(rows, 4)
    assert shard_documents(none).count() == 0
    few = shard_documents(odd.where("doc_id = 1"), 24).collect()
    assert [(r["size"], r["slot"]) for r in few] == [(8, 0)]


@pytest.mark.parametrize("most", [20_000, 30])
def test_a_group_of_a_third_of_all_rows(spark, monkeypatch, most):
    monkeypatch.setattr(common.join_dealt, "__defaults__", tuple(most if x == 20_000 else x for x in common.join_dealt.__defaults__))
    rows = [(i, "same") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(400)] + [(5000 + i, f"own {i}") for i in range(403)]
    random.Random(2).shuffle(rows)
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()
    check_law(out, 12)
    groups, cut = broken(out)
    assert groups == 201 and cut <= 30


def test_other_links(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(600)], "doc_id long, text string")

    def ring(nodes):
        """Blocks of ten documents, linked within and a little across."""
        ids = [r["node"] for r in nodes.orderBy("doc_id").select("node").collect()]
        pairs = [(ids[i], ids[j]) for b in range(0, 600, 10) for i in range(b, b + 10) for j in range(i)if j >= b]
        return spark.createDataFrame(pairs + [(rng.choice(ids), rng.choice(ids)) for _ in range(60)], "a long, b long").where("a != b")

    out = {r["doc_id"]: r for r in shard_documents(rows, 6, 12, ring).collect()}
    check_law(out.values(), 6)
    inside = sum(out[i]["shard"] == out[j]["shard"] for b in range(0, 600, 10) for i in range(b, b + 10) for j in range(b, i))
    assert inside / 2700 > 0.6, "far more than the sixth of links that chance leaves"


def test_quotas_and_shares():
    assert quotas(10, 4).tolist() == [3, 3, 2, 2]
    asked = np.array([[0, 10, 0], [4, 0, 0], [6, 2, 0]], float)
    share = accepted(asked, np.array([3, -5, 0]))
    assert share[0, 1] == 0.4 and share[1, 0] == 1 and share[2, 0] == 0.5 and share[2, 1] == 0


def test_labels_stay_in_range(spark):
    links = spark.createDataFrame([(i, 0) for i in range(1, 50)], "a long, b long")
    got = propagate(links, quotas(50, 5)).agg(F.count("*"), F.min("label"), F.max("label")).first()
    assert got[0] == 50 and got[1] >= 0 and got[2] < 5
