from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.llm import common


def test_sieve_passes_all_keys_and_few_others(spark, monkeypatch):
    rows = spark.range(50_000).withColumn("x", F.col("id") * 7 - 100_000).union(spark.sql("select null, null"))
    keys = spark.range(0, 50_000, 25).select((F.col("id") * 7 - 100_000).alias("k")).union(spark.sql("select null"))
    got = {r["x"] for r in common.sieve(rows, F.col("x"), keys).collect()}
    want = {i * 7 - 100_000 for i in range(0, 50_000, 25)}
    assert want <= got and len(got) < 2_100 and None not in got
    monkeypatch.setattr(common, "SIEVE_BITS", 1 << 10)
    assert want <= {r["x"] for r in common.sieve(rows, F.col("x"), keys).collect()}
    assert common.sieve(rows, F.col("x"), keys.where("false")).count() == 0


def test_global_index_is_gapless_and_ordered(spark):
    rows = spark.range(1000).select(F.pmod(F.hash("id"), F.lit(5)).alias("a"), "id")
    got = common.global_index(rows, [F.col("a").desc(), F.col("id")], "at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(1000))
    assert [(r["a"], r["id"]) for r in got] == sorted(((r["a"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert common.global_index(rows.where("false"), [F.col("id")], "at").count() == 0


def test_joins_by_keys_with_many_rows(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, F.lit(7)).when(F.col("id") < 990, F.col("id")).alias("k"), "id")
    table = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(table, "k", how).select("k", "id", "v").collect()), key=str)
        assert sorted(map(tuple, common.join_dealt(rows, table, "k", F.col("id"), how, 50).select("k", "id", "v").collect()), key=str) == want
    parts, many = common.dealt(rows, "k", F.col("id"), 50)
    sizes = [r["count"] for r in parts.groupBy("k", "_part").count().collect()]
    assert many.count() == 1 and max(sizes) < 100
    assert common.dealt(rows, "k", F.col("id"))[1] is None


def test_without_is_an_exact_anti_join(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_BITS", 1 << 15)
    rows = spark.range(100_000).select(F.when(F.col("id") % 10 != 3, F.col("id")).alias("_gone"), "id")
    gone = common.materialise(spark.range(0, 100_000, 9).select(F.col("id").alias("x")), "gone")
    got = common.without(rows, F.col("_gone"), gone)
    assert got.columns == rows.columns
    assert {r["id"] for r in got.collect()} == {i for i in range(100_000) if i % 10 == 3 or i % 9}


@pytest.mark.parametrize("most", [65_536, 4, 1])
def test_ranges(spark, monkeypatch, most):
    """Even, in order, alike by numpy and by built-in functions, the same for the same rows."""
    monkeypatch.setattr(common, "MOST_BOUNDS", most)
    values = [i * 31 % 5003 - 900 for i in range(5003)] + [77] * 40 + [None] * 5
    rows = spark.createDataFrame([(v,) for v in values], "k long")
    r = common.Ranges(rows, "k", len(values), 20)
    again = common.Ranges(rows.repartition(7), "k", len(values), 20)
    assert r.bounds.tolist() == again.bounds.tolist() and r.n == again.n and len(r.bounds) <= most
    got = rows.withColumn("s", r.column()).collect()
    known = [x for x in got if x["k"] is not None]
    assert r.numbers(np.array([x["k"] for x in known])).tolist() == [x["s"] for x in known]
    assert {x["s"] for x in got if x["k"] is None} == {0}
    ordered = [x["s"] for x in sorted(known, key=lambda x: x["k"])]
    assert ordered == sorted(ordered) and 0 <= ordered[0] and ordered[-1] < r.n
    sizes = Counter(ordered)
    assert len(sizes) >= 15 and max(sizes.values()) < 3 * len(values) / 20
    assert common.Ranges(rows.where("false"), "k", 0, 1).n == 1


def test_scratch_deletes_what_it_made_and_keeps_the_result(spark):
    from pathlib import Path

    root = Path(common.shared_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    with common.scratch(spark):
        inner = common.materialise(spark.range(5), "inner")
        out = common.kept(inner.where("id > 2"), "outer")
    assert [p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before] == ["outer"]
    assert out.count() == 2
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.materialise(spark.range(5), "inner")
        1 / 0
    assert [p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before] == ["outer"]
