"""Document quality from preferences: a Bradley-Terry model.

Of two documents with different labels the one with label 1 is preferred, with probability sigmoid(w . (x - y)) for feature
vectors x and y. The weights minimise the mean logistic loss over pairs plus a ridge term, by Newton's steps. The threshold
between the labels lies between two of the training scores, whichever part them best; scores are shifted so that it falls on CUT.

Features are shares and ratios of bytes, words and lines of the whole text. The model is fitted on the driver from a bounded sample
of the labelled rows (MAX_LABELLED, by a hash of doc_id); every document is then scored. The sample is put in order first, so that
the same rows give the same model however they are partitioned.

Defined results: a null text is empty and gets a score; a null doc_id is never learnt from; of repeated labels the larger counts,
null labels don't; without both labels every score is 0.5; repeated documents are scored each; an empty table gives no rows; other
columns are ignored (`score`) or kept (`keep_good`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Most labelled rows to learn from, pairs, ridge weight, Newton steps, and the score from which a document is good.
MAX_LABELLED, PAIRS, RIDGE, STEPS, CUT = 20_000, 30_000, 1e-2, 8, 0.3
#: Bytes of text at which features count half: shares of very short texts say little.
HALF = 40
FOLDS = 5
_ASCII = slice(32, 127)
N_FEATURES = 95 + 20


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES, np.float64)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    out[:95] = np.log1p(200 * counts[_ASCII] / n)
    words, lines = raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    often = Counter(words)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    times = np.fromiter(often.values(), np.float64, len(often)) if often else np.zeros(1)
    letters = counts[65:91].sum() + counts[97:123].sum()
    low = Counter(raw.lower().split())
    out[95:] = (
        np.log1p(n),
        np.log1p(m),
        len(often) / m,
        np.log1p(len(often)) / np.log1p(m),
        times.max() / m,
        float((times**2).sum()) / m**2,
        sum(map(eq, words, words[1:])) / m,
        sizes.mean(),
        sizes.std(),
        float((sizes <= 3).mean()),
        float((sizes >= 11).mean()),
        sum(map(bytes.isupper, words)) / m,
        counts[65:91].sum() / max(1, letters),
        counts[48:58].sum() / n,
        counts[128:].sum() / n,
        (n - letters - counts[128:].sum() - counts[32] - counts[10]) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        np.log1p(m / (1 + counts[46] + counts[33] + counts[63])),
        len(low) / m,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        n = np.expm1(x[:, [95]])
        return (x - self.mean) / self.scale * (n / (n + HALF))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, CUT at the threshold."""
        if not self.weights.any():
            return np.full(len(x), 0.5)
        z = (self.raw(x) - self.threshold) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> Model:
    mean, scale = x.mean(0) if len(x) else np.zeros(N_FEATURES), x.std(0) + 1e-6 if len(x) else np.ones(N_FEATURES)
    model = Model(mean, scale, np.zeros(N_FEATURES), 0.0, 1.0)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(11)
    a = good[np.concatenate([rng.permutation(len(good)) for _ in range(-(-pairs // len(good)))])[:pairs]]
    b = bad[np.concatenate([rng.permutation(len(bad)) for _ in range(-(-pairs // len(bad)))])[:pairs]]
    z = model.scaled(x).astype(np.float32)
    w = np.zeros(x.shape[1])
    blocks = [slice(i, i + 8192) for i in range(0, len(a), 8192)]
    for _ in range(STEPS):
        gradient, hessian = ridge * w, ridge * np.eye(len(w))
        for s in blocks:
            d = z[a[s]] - z[b[s]]
            p = 1 / (1 + np.exp(np.clip(d @ w.astype(np.float32), -30, 30)))  # of the wrong order
            gradient -= d.T @ p / len(a)
            hessian += (d * (p * (1 - p))[:, None]).T @ d / len(a)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
    model.weights = w
    r = model.raw(x)
    # Cuts lie between neighbouring distinct scores, all of them: whatever the share of bad labels, the best cut is among them.
    distinct = np.unique(r)
    cuts = np.concatenate([distinct[:1], (distinct[:-1] + distinct[1:]) / 2])
    gain = np.searchsorted(np.sort(r[bad]), cuts) / len(bad) - np.searchsorted(np.sort(r[good]), cuts) / len(good)
    lowest = int(np.argmax(gain >= gain.max() - 0.002))  # of cuts about as good, the one that keeps most
    model.threshold, model.spread = float(cuts[lowest]), float(r.std() / 2 + 1e-9)
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t).astype(np.float32) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "label", "x"])


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MAX_LABELLED) -> Model:
    """Fit on labelled rows outside the held-out fold, at most about `most` of them."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long"), F.col(target).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n)))) if n > most else known
    pairs = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")  # about `most` rows of two numbers
    rows = pairs.mapInArrow(_feature_batches, "doc_id long, label int, x array<float>").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, N_FEATURES)
    doc, label = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "label"))
    order = np.lexsort([*x.T, doc])  # repeated doc_ids by their features
    return fit(x[order], label[order])


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            x = np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(model.score(x), pa.float64())], names=[*names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score_batches(model), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose score reaches CUT, with their columns."""
    model = learn(docs, labels)
    small_batches(docs.sparkSession)
    names, types = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            yield b.filter(pa.array(model.score(x) >= CUT))

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, types)


def op7_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
