"""Product quantisation: one codebook for each part of the vector, codes, and table distances.

Codebooks are fitted on a bounded sample on the driver; all rows are encoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a batch for each result asked for, and the share of a batch's rows that are candidates at least.
WIDTH, SHARE = 10, 0.05


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds from k-means++ starts; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    gap = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = gap.sum()
        pick = rng.choice(len(x), p=gap / total) if total > 0 else rng.integers(len(x))
        centres = np.vstack([centres, x[pick]])
        gap = np.minimum(gap, ((x - x[pick]) ** 2).sum(1))
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        fresh = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if np.allclose(fresh, centres):
            break
        centres = fresh
    return centres


@dataclass
class ProductQuantiser:
    """`books[m, k, d]`: k centres of d elements for each of m parts."""

    books: np.ndarray

    @classmethod
    def train(cls, rows: DataFrame, vec_col: str = "embedding", parts: int = 16, centres: int = 64, sample: int = 20_000, rounds: int = 12, seed: int = 42) -> ProductQuantiser:
        some = rows.where(F.col(vec_col).isNotNull())
        n = some.count()
        if n > sample:
            some = some.where(F.pmod(F.xxhash64(F.to_json(vec_col)), F.lit(1_000_000)) < int(1_000_000 * sample / n))
        x = [r[0] for r in some.select(vec_col).collect()]
        dims = max((len(v) for v in x), default=parts)
        x = np.array([v for v in x if len(v) == dims], np.float64).reshape(-1, dims)
        if not len(x):
            return cls(np.zeros((parts, 1, dims // parts)))
        if x.shape[1] % parts:
            raise ValueError(f"{x.shape[1]} elements are not {parts} equal parts")
        d = x.shape[1] // parts
        return cls(np.stack([kmeans(x[:, m * d : (m + 1) * d], min(centres, len(x)), rounds, seed + m) for m in range(parts)]))

    @property
    def ratio(self) -> float:
        """Bytes of single-precision elements for each byte of code."""
        m, _, d = self.books.shape
        return 4.0 * m * d / m

    def encode(self, x: np.ndarray) -> np.ndarray:
        m, _, d = self.books.shape
        parts = x.reshape(len(x), m, d)
        gaps = ((parts[:, :, None, :] - self.books[None]) ** 2).sum(-1)
        return gaps.argmin(-1).astype(np.int16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        m = self.books.shape[0]
        return self.books[np.arange(m)[None, :], codes].reshape(len(codes), -1)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Products of a query's parts with all centres."""
        m, _, d = self.books.shape
        return np.einsum("md,mkd->mk", q.reshape(m, d), self.books)

    def dot(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return table[np.arange(len(table))[None, :], codes].sum(1)

    def to_bytes(self) -> bytes:
        head = np.array(self.books.shape, "<u4").tobytes()
        return head + self.books.astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> ProductQuantiser:
        shape = np.frombuffer(data[:12], "<u4")
        return cls(np.frombuffer(data[12:], "<f8").reshape(shape))

    def codebook(self, spark) -> DataFrame:
        """(sub, c, centroid)."""
        rows = [(m, c, list(map(float, v))) for m, book in enumerate(self.books) for c, v in enumerate(book)]
        return spark.createDataFrame(rows, "sub int, c int, centroid array<double>")

    def encode_rows(self, rows: DataFrame, vec_col: str = "embedding") -> DataFrame:
        """Adds codes array<smallint> in place of the vectors. Rows without a vector of the right length are left out."""
        names, dims = [c for c in rows.columns if c != vec_col], self.books.shape[0] * self.books.shape[2]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from .knn import matrix

            for b in batches:
                x, at = matrix(b.column(vec_col), dims)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in names), pa.array(list(self.encode(x)), pa.list_(pa.int16()))], names=[*names, "codes"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != vec_col)
        return rows.where(F.col(vec_col).isNotNull()).mapInArrow(run, f"{fields}, codes array<smallint>")

    def search(self, queries: list[tuple[int, list[float]]], coded: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
        """(query_id, id, score, rank) by exact products with the vectors in `vec_col`, of candidates by table products: of each batch
        the best WIDTH * k rows, or SHARE of its rows if that is more. The tables of a block of queries go with the task."""
        tables = [(int(i), np.array(q, np.float64), self.table(np.array(q, np.float64))) for i, q in queries]
        id_type = coded.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes, x = (np.asarray(b.column(c).flatten().to_numpy(zero_copy_only=False), t).reshape(b.num_rows, -1) for c, t in (("codes", np.int64), (vec_col, np.float64)))
                for i, q, t in tables:
                    at = _largest(self.dot(t, codes), max(WIDTH * k, int(np.ceil(SHARE * b.num_rows))))
                    s = x[at] @ q
                    best = _largest(s, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i), pa.int64()), b.column(id_col).take(pa.array(at[best])), pa.array(s[best])], names=["query_id", id_col, "score"])

        best = coded.select(id_col, "codes", vec_col).mapInArrow(run, f"query_id long, {id_col} {id_type}, score double")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _largest(s: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest are; ties at the limit stay."""
    return np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if k < len(s) else np.arange(len(s))
