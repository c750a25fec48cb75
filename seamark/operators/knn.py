"""Nearest neighbours of many queries at once: exact, by an index of lists, by sign sketches, by stored codes.

All searches stream the rows once for each block of queries: a block is a matrix of bounded size in every task, a task keeps the k
best of a slice of rows, and only those few are shuffled to be ranked. Ties are put in the order of the id. Distances of a slice are
at most CELLS numbers at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..shared import no_rows
from .pq import kmeans

#: Queries of a block, and distances that a task holds at once.
BLOCK, CELLS = 1024, 1 << 22
#: Rows up to which a search is exact, and what an index is asked for: so many times the limit, at least so many.
EXACT_BELOW, OVER_FETCH, LEAST_FETCH = 50_000, 5, 30


def query_blocks(queries: DataFrame, id_col: str, vec_col: str, block: int = BLOCK, kind: type = np.float64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries, a block at a time: all that the driver holds of them."""
    ids, vectors = [], []
    for r in queries.select(id_col, vec_col).where(F.col(vec_col).isNotNull()).toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == block:
            yield np.array(ids, np.int64), np.array(vectors, kind)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, kind)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors of `dims` elements, and which rows those are. Null vectors, others lengths and null elements are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dims)
    some = column.take(pa.array(at)).flatten()
    x = np.asarray(some.to_numpy(zero_copy_only=False), np.float64 if some.null_count else kind).reshape(-1, dims)
    if some.null_count:
        whole = ~np.isnan(x).any(1)
        x, at = x[whole].astype(kind), at[whole]
    return x, at


def distances(kind: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Queries by rows: cosine (1 - cosine; FAR for zero vectors), dot (1 - dot) or l2."""
    if kind == "l2":
        return np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T))
    products = q @ x.T
    if kind == "dot":
        return 1 - products
    size = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None, :]
    return np.where(size == 0, V.FAR, 1 - products / np.where(size == 0, 1, size))


#: What a kernel makes of a batch: for each slice of rows the distances (queries by rows) and which rows of the batch they are.
Kernel = Callable[[pa.RecordBatch, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def slices(n_queries: int, n_rows: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, n_queries))
    for i in range(0, n_rows, step):
        yield slice(i, i + step)


def by_vectors(kind: str) -> Kernel:
    def run(b: pa.RecordBatch, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, rows = matrix(b.column("_vec"), q.shape[1])
        for s in slices(len(q), len(x)):
            yield distances(kind, q, x[s]), rows[s]

    return run


def by_bits(b: pa.RecordBatch, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different bits of words of bits."""
    x, rows = matrix(b.column("_vec"), q.shape[1], np.int64)
    for s in slices(len(q) * q.shape[1], len(x)):
        yield np.bitwise_count(q[:, None, :] ^ x[s][None, :, :]).sum(2, dtype=np.int64).astype(np.float64), rows[s]


def by_codes(kind: str) -> Kernel:
    """Vectors stored as int8: with `scale` and `min` of their own, or of the unit range where those are null."""

    def run(b: pa.RecordBatch, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, rows = matrix(b.column("_vec"), q.shape[1])
        scale, low = (b.column(c).to_numpy(zero_copy_only=False).astype(np.float64)[rows][:, None] for c in ("_scale", "_min"))
        back = np.where(np.isnan(scale), x / 127, (x + 128) * scale + low)
        for s in slices(len(q), len(x)):
            yield distances(kind, q, back[s]), rows[s]

    return run


def _nearest(d: np.ndarray, k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k least of each row of `d` within the threshold; ties at the limit stay."""
    limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < d.shape[1] else np.full((len(d), 1), np.inf)
    return np.nonzero(d <= (limit if threshold is None else np.minimum(limit, threshold)))


def _best(ids: np.ndarray, q: np.ndarray, k: int, threshold: float | None, kernel: Kernel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, rows in kernel(b, q):
                i, j = _nearest(d, k, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), b.column("_id").take(pa.array(rows[j])), pa.array(d[i, j])], names=["query_id", "_id", "distance"])

    return run


def ranked(rows: DataFrame, k: int | None, by: list, partition: str = "query_id", name: str = "rank") -> DataFrame:
    """Position in the order `by` for each query, and only the first k."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(partition).orderBy(*by)))
    return out if k is None else out.where(F.col(name) <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, kernel: Kernel, threshold: float | None = None, query: tuple[str, str] = ("query_id", "embedding"), id_col: str = "id", block: int = BLOCK, kind: type = np.float64) -> DataFrame:
    """(query_id, id, distance, rank) by a kernel over `rows` with the columns _id, _vec and what the kernel reads."""
    id_type = rows.schema["_id"].dataType.simpleString()
    found = None
    for ids, q in query_blocks(queries, *query, block, kind):
        one = rows.mapInArrow(_best(ids, q, k, threshold, kernel), f"query_id long, _id {id_type}, distance double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = no_rows(rows.sparkSession, f"query_id long, _id {id_type}, distance double")
    return ranked(found, k, [F.col("distance"), F.col("_id")]).withColumnRenamed("_id", id_col)


def exact(queries: DataFrame, rows: DataFrame, k: int, threshold: float | None = None, kind: str = "cosine", query: tuple[str, str] = ("query_id", "embedding"), row: tuple[str, str] = ("id", "embedding"), block: int = BLOCK) -> DataFrame:
    """(query_id, id, distance, rank): for each query the k nearest rows within the threshold."""
    source = rows.select(F.col(row[0]).alias("_id"), F.col(row[1]).alias("_vec")).where("_vec is not null")
    return nearest(queries, source, k, by_vectors(kind), threshold, query, row[0], block)


def within(queries: DataFrame, rows: DataFrame, threshold: float, kind: str = "cosine", query: tuple[str, str] = ("query_id", "embedding"), row: tuple[str, str] = ("id", "embedding"), block: int = BLOCK) -> DataFrame:
    """(query_id, n, farthest): how many rows are within the threshold of a query, counted where the rows are."""
    source, found = rows.select(F.col(row[1]).alias("_vec")).where("_vec is not null"), None

    def counted(ids: np.ndarray, q: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, far = np.zeros(len(q), np.int64), np.full(len(q), -np.inf)
            for b in batches:
                for d, _ in by_vectors(kind)(b, q):
                    near = d <= threshold
                    n += near.sum(1)
                    far = np.maximum(far, np.where(near, d, -np.inf).max(1, initial=-np.inf))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(far[some])], names=["query_id", "n", "farthest"])

        return run

    for ids, q in query_blocks(queries, *query, block):
        one = source.mapInArrow(counted(ids, q), "query_id long, n long, farthest double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = no_rows(rows.sparkSession, "query_id long, n long, farthest double")
    return found.groupBy("query_id").agg(F.sum("n").alias("n"), F.max("farthest").alias("farthest"))


class ListIndex:
    """An index of lists: rows go to their nearest centres; a query looks at its nearest lists and ranks their rows exactly.

    Centres are fitted on a bounded sample (`sample` rows); every row is in the index, in `copies` lists. `rows` has a row for each
    list that a vector is in; written in the order of `list`, a search reads only the lists that are probed.
    """

    def __init__(self, rows: DataFrame, lists: int = 64, sample: int = 20_000, seed: int = 7, id_col: str = "id", vec_col: str = "embedding", rounds: int = 15, copies: int = 1):
        self.id_col, self.vec_col = id_col, vec_col
        some = rows.where(F.col(vec_col).isNotNull())
        n = some.count()
        if n > sample:
            some = some.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * sample / n))
        x = [r[0] for r in some.select(vec_col).collect()]
        dims = len(x[0]) if x else 1
        x = np.array([v for v in x if len(v) == dims], np.float64).reshape(-1, dims)
        self.centres = kmeans(x, min(lists, len(x)), rounds, seed) if len(x) else np.zeros((0, 1))
        self.rows = self.assign(rows.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec")).where("_vec is not null"), copies)

    def assign(self, rows: DataFrame, n: int) -> DataFrame:
        """(_id, _vec, list): a row for each of the n nearest centres."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, at = matrix(b.column("_vec"), centres.shape[1])
                near = np.argsort(distances("l2", x, centres), 1, kind="stable")[:, :n].astype(np.int32)
                some = pa.array(np.repeat(at, near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("_id").take(some), b.column("_vec").take(some), pa.array(near.ravel())], names=["_id", "_vec", "list"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{fields}, list int") if len(centres) else rows.withColumn("list", F.lit(0)).where("false")

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """Whether a query looks at a list."""
        out = np.zeros((len(q), len(self.centres)), bool)
        np.put_along_axis(out, np.argsort(distances("l2", q, self.centres), 1, kind="stable")[:, :n], True, axis=1)
        return out

    def search(self, queries: DataFrame, k: int, probes: int = 4, query: tuple[str, str] = ("query_id", "embedding"), threshold: float | None = None) -> DataFrame:
        """(query_id, id, distance, rank) by cosine, of the rows in the lists that are probed."""
        id_type, found = self.rows.schema["_id"].dataType.simpleString(), None
        for ids, q in query_blocks(queries, *query) if len(self.centres) else ():
            if q.shape[1] != self.centres.shape[1]:
                continue
            looks = self.probes(q, probes)
            rows = self.rows.where(F.col("list").isin(np.flatnonzero(looks.any(0)).tolist()))
            one = rows.mapInArrow(_in_lists(ids, q, looks, k, threshold), f"query_id long, _id {id_type}, distance double, looked long")
            found = one if found is None else found.unionByName(one)
        if found is None:
            found = no_rows(self.rows.sparkSession, f"query_id long, _id {id_type}, distance double, looked long")
        looked = found.where("_id is null").groupBy("query_id").agg(F.sum("looked").alias("looked"))
        best = found.where("_id is not null").groupBy("query_id", "_id").agg(F.min("distance").alias("distance"))
        return ranked(best, k, [F.col("distance"), F.col("_id")]).join(looked, "query_id").withColumnRenamed("_id", self.id_col)


def _in_lists(ids: np.ndarray, q: np.ndarray, looks: np.ndarray, k: int, threshold: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = np.zeros(len(q), np.int64)
        names = ["query_id", "_id", "distance", "looked"]
        kind = pa.int64()
        for b in batches:
            x, rows = matrix(b.column("_vec"), q.shape[1])
            lists, kind = b.column("list").to_numpy()[rows], b.column("_id").type
            for number in np.unique(lists).tolist():
                asking, here = np.flatnonzero(looks[:, number]), np.flatnonzero(lists == number)
                looked[asking] += len(here)
                for s in slices(len(asking), len(here)):
                    d = distances("cosine", q[asking], x[here[s]])
                    i, j = _nearest(d, k, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asking[i]]), b.column("_id").take(pa.array(rows[here[s]][j])), pa.array(d[i, j]), pa.nulls(len(i), pa.int64())], names=names)
        some = np.flatnonzero(looked)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), kind), pa.nulls(len(some), pa.float64()), pa.array(looked[some])], names=names)

    return run


class SketchIndex:
    """Locality-sensitive hashing by signs: a row is known by the sides of `bits` random planes it is on.

    A vector's sketch agrees with a near one's in more bits than with others'. The sketches of all rows are compared, `share` of the
    rows of a batch (at least WIDTH * k) are candidates, and only their vectors are looked at, to rank them exactly.
    """

    WIDTH = 10

    def __init__(self, rows: DataFrame, bits: int = 512, seed: int = 5, id_col: str = "id", vec_col: str = "embedding"):
        self.id_col = id_col
        first = rows.where(F.col(vec_col).isNotNull()).select(F.size(vec_col)).first()
        self.planes = np.random.default_rng(seed).normal(size=(bits, first[0] if first else 1))
        planes, sketch = self.planes, self.sketch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, at = matrix(b.column("_vec"), planes.shape[1])
                some = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("_id").take(some), b.column("_vec").take(some), pa.array([w.tobytes() for w in sketch(planes, x)], pa.binary())], names=["_id", "_vec", "_bits"])

        source = rows.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec")).where("_vec is not null")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
        self.rows = source.mapInArrow(run, f"{fields}, _bits binary")

    @staticmethod
    def sketch(planes: np.ndarray, x: np.ndarray) -> np.ndarray:
        sides = np.packbits(x @ planes.T > 0, axis=1)
        return np.pad(sides, ((0, 0), (0, -sides.shape[1] % 8))).view(np.uint64)

    def search(self, queries: DataFrame, k: int, share: float = 0.1, query: tuple[str, str] = ("query_id", "embedding")) -> DataFrame:
        """(query_id, id, distance, rank, looked): by cosine, of the candidates; `looked` counts a query's candidates."""
        id_type, found, planes, sketch, width = self.rows.schema["_id"].dataType.simpleString(), None, self.planes, self.sketch, self.WIDTH

        def block(ids: np.ndarray, q: np.ndarray):
            own = sketch(planes, q)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                looked = np.zeros(len(q), np.int64)
                kind = pa.int64()
                for b in batches:
                    if not b.num_rows:
                        continue
                    kind = b.column("_id").type
                    x, rows = matrix(b.column("_vec"), planes.shape[1])
                    bits = np.frombuffer(b"".join(b.column("_bits").to_pylist()), np.uint64).reshape(b.num_rows, -1)[rows]
                    n = min(len(x), max(width * k, int(np.ceil(share * len(x)))))
                    for s in slices(len(x) * own.shape[1], len(q)):  # queries are sliced here: the rows of a batch are ranked together
                        differ = np.bitwise_count(own[s][:, None, :] ^ bits[None, :, :]).sum(2, dtype=np.int32)
                        near = np.argpartition(differ, n - 1, axis=1)[:, :n] if n < len(x) else np.tile(np.arange(len(x)), (len(differ), 1))
                        looked[s] += n
                        for row, at in zip(range(len(q))[s], near, strict=True):
                            d = distances("cosine", q[row : row + 1], x[at])
                            _, j = _nearest(d, k, None)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), ids[row])), b.column("_id").take(pa.array(rows[at[j]])), pa.array(d[0, j]), pa.nulls(len(j), pa.int64())], names=["query_id", "_id", "distance", "looked"])
                some = np.flatnonzero(looked)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), kind), pa.nulls(len(some), pa.float64()), pa.array(looked[some])], names=["query_id", "_id", "distance", "looked"])

            return run

        schema = f"query_id long, _id {id_type}, distance double, looked long"
        for ids, q in query_blocks(queries, *query):
            if q.shape[1] != planes.shape[1]:
                continue  # an index without rows, or of vectors of another length
            one = self.rows.mapInArrow(block(ids, q), schema)
            found = one if found is None else found.unionByName(one)
        if found is None:
            found = no_rows(self.rows.sparkSession, schema)
        looked = found.where("_id is null").groupBy("query_id").agg(F.sum("looked").alias("looked"))
        return ranked(found.where("_id is not null").select("query_id", "_id", "distance"), k, [F.col("distance"), F.col("_id")]).join(looked, "query_id").withColumnRenamed("_id", self.id_col)


def search(queries: DataFrame, rows: DataFrame, k: int, threshold: float | None = None, query: tuple[str, str] = ("query_id", "embedding"), row: tuple[str, str] = ("id", "embedding"), exact_below: int = EXACT_BELOW, share: float = 0.1) -> DataFrame:
    """Exact on tables of fewer than `exact_below` vectors, else by an index that is asked for OVER_FETCH times k (LEAST_FETCH at least),
    of which those within the threshold are kept, k of each query."""
    if rows.where(F.col(row[1]).isNotNull()).limit(exact_below).count() < exact_below:
        return exact(queries, rows, k, threshold, query=query, row=row)
    found = SketchIndex(rows, id_col=row[0], vec_col=row[1]).search(queries, max(OVER_FETCH * k, LEAST_FETCH), share, query).drop("rank", "looked")
    return ranked(found if threshold is None else found.where(F.col("distance") <= threshold), k, [F.col("distance"), F.col(row[0])])
