"""Embedders and cross-encoders: protocols, a deterministic hashing embedder, and HTTP services.

The hashing embedder is a stand-in without knowledge of meaning: it makes every search path runnable without a model.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import vector as V


class Embedder(Protocol):
    dims: int

    def embed(self, texts: DataFrame, text: str, out: str) -> DataFrame: ...


class HashingEmbedder:
    """Tokens are hashed to signed positions, counted and normalised, all by built-in functions."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def vector(self, text: Column) -> Column:
        h = F.transform(T.tokens(F.coalesce(text, F.lit(""))), lambda t: F.xxhash64(t))
        spots = F.transform(h, lambda x: F.struct(F.pmod(x, F.lit(self.dims)).cast("int").alias("at"), F.when(F.getbit(x, F.lit(40)) == 1, 1.0).otherwise(-1.0).alias("sign")))
        summed = F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda i: F.aggregate(F.filter(spots, lambda s: s["at"] == i), F.lit(0.0), lambda acc, s: acc + s["sign"]).cast("float"))
        return V.normalise(summed)

    def embed(self, texts: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        """The same vectors, counted in batches: the work is one step for each token, however many dimensions there are."""
        names, dims = texts.columns, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 1024):
                    b = whole.slice(start, 1024)
                    h = b.column("_hashes")
                    x = h.flatten().to_numpy().astype(np.int64)
                    row = np.repeat(np.arange(b.num_rows), pc.list_value_length(h).to_numpy())
                    signs = np.where((x >> 40) & 1, 1.0, -1.0)
                    v = np.bincount(row * dims + x % dims, signs, b.num_rows * dims).reshape(-1, dims).astype(np.float32)
                    n = np.sqrt((v.astype(np.float64) ** 2).sum(1, keepdims=True))
                    v = np.where(n == 0, v, v * (1.0 / np.where(n == 0, 1, n)).astype(np.float32)).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(list(v), pa.list_(pa.float32()))], names=[*names, out])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
        hashed = F.transform(T.tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: F.xxhash64(t))
        return texts.withColumn("_hashes", hashed).mapInArrow(run, f"{fields}, `{out}` array<float>")


def parse_embeddings(body: str, n: int) -> list[list[float]]:
    """Vectors in the order asked for, from a list of {index, embedding} (vectors may be nested once) or from one {embedding}."""
    got = json.loads(body)
    rows = got if isinstance(got, list) else [{"index": 0, **got}]
    out: list[list[float]] = [[] for _ in range(n)]
    for r in rows:
        v = r["embedding"]
        out[r.get("index", 0)] = v[0] if v and isinstance(v[0], list) else v
    return out


def parse_scores(body: str, n: int) -> list[float | None]:
    """Scores in the order asked for, from {"results": [{index, relevance_score}]}; results outside are dropped."""
    out: list[float | None] = [None] * n
    for r in json.loads(body)["results"]:
        if 0 <= r["index"] < n:
            out[r["index"]] = r["relevance_score"]
    return out


def post(url: str, payload: dict, seconds: float = 60) -> str:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=seconds) as r:
        return r.read().decode()


class HttpEmbedder:
    """A service that takes {"content": [texts]}. Distinct texts are sent, in batches; a batch that fails goes text by text, shorter each time.

    After `count(spark)` it adds up the texts sent (`total`) and those without a vector (`errors`); a task that runs again counts again.
    """

    def __init__(self, url: str, dims: int, batch: int = 128, most_chars: int = 384, send=post):
        self.url, self.dims, self.batch, self.most_chars, self.send = url, dims, batch, most_chars, send
        self.total = self.errors = None

    def count(self, spark) -> None:
        self.total, self.errors = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def stats(self) -> tuple[int, int]:
        """(texts sent, texts without a vector)."""
        return (self.total.value, self.errors.value) if self.total else (0, 0)

    def _vectors(self, texts: list[str]) -> list[list[float]]:
        try:
            return parse_embeddings(self.send(self.url, {"content": texts}), len(texts))
        except (OSError, ValueError, LookupError):
            return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        for share in (1.0, *T.RETRY_RATIOS):
            try:
                return parse_embeddings(self.send(self.url, {"content": [text[: int(len(text) * share)]]}), 1)[0]
            except (OSError, ValueError, LookupError):
                continue
        return []

    def embed(self, texts: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        cut = texts.select(F.col(text), T.truncate_at_boundary(F.col(text), self.most_chars).alias("_cut")).where(F.col(text).isNotNull()).dropDuplicates([text])
        total, errors = self.total, self.errors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                given = b.column("_cut").to_pylist()
                got = [v for i in range(0, len(given), self.batch) for v in self._vectors(given[i : i + self.batch])]
                norm = [np.linalg.norm(v) or 1.0 for v in got]
                if total is not None:
                    total.add(len(got))
                    errors.add(sum(not v for v in got))
                yield pa.RecordBatch.from_arrays([b.column("_text"), pa.array([[x / n for x in v] or None for v, n in zip(got, norm, strict=True)], pa.list_(pa.float32()))], names=["_text", out])

        vectors = cut.select(F.col(text).alias("_text"), "_cut").mapInArrow(run, f"_text string, {out} array<float>")
        return texts.join(vectors, F.col(text) == F.col("_text"), "left").drop("_text")


class HttpReranker:
    """A service that takes {"query", "documents"} and scores them; pairs are grouped by query in batches of candidates."""

    def __init__(self, url: str, send=post):
        self.url, self.send = url, send

    def score(self, pairs: DataFrame, query: str = "query", document: str = "content") -> DataFrame:
        """Adds logit to (query_id, id, query, content); a query whose call fails has none."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

        def one(t: pa.Table) -> pa.Table:
            try:
                got = parse_scores(self.send(self.url, {"query": t.column(query)[0].as_py(), "documents": t.column(document).to_pylist()}), t.num_rows)
            except (OSError, ValueError, LookupError):
                got = [None] * t.num_rows
            return t.append_column("logit", pa.array(got, pa.float64()))

        return pairs.groupBy("query_id").applyInArrow(one, f"{schema}, logit double")


def rerank_top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by logit, best first."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("logit").desc_nulls_last(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
