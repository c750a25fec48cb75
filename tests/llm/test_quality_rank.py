import zlib

import numpy as np
import pytest

from seamark.llm.quality_rank import CUT, N_FEATURES, features, fit, keep_good, learn, op7_bradley_terry_quality, score

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    import duckdb

    label = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    rows = op7_bradley_terry_quality(spark, SF).collect()
    assert len(rows) == duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= CUT) for r in rows)
    held = [(r["score"], r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    good, bad = [x for x in held if x[2] == 1], [x for x in held if x[2] == 0]
    wins = np.mean([(g[0] > b[0]) + 0.5 * (g[0] == b[0]) for g in good for b in bad])
    assert wins > 0.95
    assert np.mean([x[1] for x in good]) > 0.95 and np.mean([x[1] for x in bad]) < 0.2


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = learn(docs, labels), learn(docs, turned)
    x = np.array([features(t) for t in ("some words, here.", "A!! B!! C!!", "")])
    assert np.allclose(a.score(x), b.score(x))


def test_partitioning_changes_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = learn(docs, labels), learn(docs.repartition(7, "text"), labels.repartition(3, "quality"))
    assert (a.weights == b.weights).all() and a.threshold == b.threshold and a.spread == b.spread


def test_weights_against_gradient_descent():
    """The same loss over the same kind of pairs, minimised the plain way, orders documents alike."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, N_FEATURES))
    x[:, 95] = 8
    y = (x[:, 0] + 0.5 * x[:, 2] + rng.normal(size=300) > 0).astype(int)
    m = fit(x, y, pairs=4000, ridge=0.05)
    z, w = m.scaled(x), np.zeros(N_FEATURES)
    d = z[rng.choice(np.flatnonzero(y == 1), 20_000)] - z[rng.choice(np.flatnonzero(y == 0), 20_000)]
    for _ in range(400):
        w -= 0.3 * (0.05 * w - d.T @ (1 / (1 + np.exp(d @ w))) / len(d))
    assert np.corrcoef(z @ w, m.raw(x))[0, 1] > 0.98


def test_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(2, 0), (3, 1), (4, 1), (4, 0), (5, None), (6, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    model = learn(odd, labels)
    rows = score(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    kept = keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r["score"] >= CUT for r in rows)
    assert score(none, model).count() == 0
    assert {r["score"] for r in score(odd, learn(none, labels)).collect()} == {0.5}


def test_pairs_order_the_documents():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, N_FEATURES))
    x[:, 95] = 8
    y = (x[:, 0] - 0.5 * x[:, 1] > 0).astype(int)
    m = fit(x[:300], y[:300])
    s = m.score(x[300:])
    assert s[y[300:] == 1].mean() > s[y[300:] == 0].mean() + 0.2


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 0.998])
def test_threshold_parts_the_labels_at_any_share_of_bad_ones(share):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, N_FEATURES)) * 0.1
    x[:, 95] = 8
    y = (np.arange(3000) >= 3000 * share).astype(int)
    x[:, 0] += 3 * y
    predicted = fit(x, y).score(x) >= CUT
    assert predicted[y == 1].mean() > 0.99 and predicted[y == 0].mean() < 0.01


def test_model_is_bounded(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert learn(docs, labels, most=100).weights.shape == (N_FEATURES,)


@pytest.mark.parametrize("text", [None, "", " ", "\n", "a", "é" * 50, "!!!"])
def test_features_of_odd_texts(text):
    assert np.isfinite(features(text)).all()
