"""Segments of a chunk for late interaction, and their pooling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Segments of a chunk; lengths in bytes at which a segment is cut at a blank line or new unit, when it is full, and least at the end.
MOST, CUT, FULL, LAST = 10, 20, 200, 10
STARTS = ("func ", "type ", "//", "def ", "class ", "#")
POOLED, SIMILAR = 5, 0.90


def trimmed(x: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def segments(content: Column) -> Column:
    """array<string>: runs of lines, cut at blank lines, at lines that start a unit, and when full; at most MOST of them.

    A fold over the trimmed lines: `held` is the open segment, `size` the bytes of its lines.
    """
    text = trimmed(F.coalesce(content, F.lit("")))
    lines = F.transform(F.split(text, "\n"), trimmed)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit(0).alias("size"))

    def closed(acc: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.array(acc["held"])).alias("out"), F.lit("").alias("held"), F.lit(0).alias("size"))

    def cut(acc: Column, line: Column) -> Column:
        begins = F.lit(False)
        for word in STARTS:
            begins = begins | line.startswith(word)
        return F.when((acc["size"] > CUT) & ((line == "") | begins), closed(acc)).otherwise(acc)

    def added(acc: Column, line: Column) -> Column:
        return F.struct(acc["out"].alias("out"), F.when(acc["size"] == 0, line).otherwise(F.concat_ws(" ", acc["held"], line)).alias("held"), (acc["size"] + F.octet_length(line)).alias("size"))

    # One after the other, each by an array of one, so that what a step makes is made once.
    def then(value: Column, f) -> Column:
        return F.element_at(F.transform(F.array(value), f), 1)

    def step(acc: Column, line: Column) -> Column:
        ready = then(cut(acc, line), lambda x: F.when(line == "", x).otherwise(added(x, line)))
        return then(ready, lambda x: F.when(x["size"] > FULL, closed(x)).otherwise(x))

    found = F.aggregate(lines, start, step, lambda acc: F.when(acc["size"] > LAST, F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]))
    return then(found, sampled)


def sampled(xs: Column) -> Column:
    """Beyond MOST: the first, each eighth part's beginning, the last."""
    n = F.size(xs)
    step = F.greatest(F.floor(n / 8).cast("int"), F.lit(1))
    between = F.filter(F.transform(F.sequence(F.lit(1), F.lit(MOST - 2)), lambda i: i * step), lambda i: i < n - 1)
    return F.when(n <= MOST, xs).otherwise(F.concat(F.slice(xs, 1, 1), F.transform(between, lambda i: F.get(xs, i)), F.slice(xs, -1, 1)))


def segment_chunks(chunks: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(chunk_id, segment_idx, text)."""
    return chunks.select(F.col(id_col).cast("string").alias("chunk_id"), F.posexplode(segments(F.col(content))).alias("segment_idx", "text"))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def farthest(x: np.ndarray, most: int = POOLED) -> list[int]:
    """Rows picked one after the other, from the first, each the farthest (cosine) from those picked; ties: the first."""
    if len(x) <= most:
        return list(range(len(x)))
    u, picked = _unit(x), [0]
    near = np.full(len(u), 2.0)
    while len(picked) < most:
        near = np.minimum(near, 1 - u @ u[picked[-1]])
        open_ = near.copy()
        open_[picked] = -np.inf
        picked.append(int(np.argmax(open_)))
    return picked


def merged(x: np.ndarray, least: float = SIMILAR) -> list[list[int]]:
    """Clusters by chains of pairs at or above a cosine similarity, in order of their first member."""
    u = _unit(x)
    label = np.arange(len(u))
    for i, j in np.argwhere(np.triu(u @ u.T >= least, 1)):
        a, b = label[i], label[j]
        label[label == max(a, b)] = min(a, b)
    return [np.flatnonzero(label == k).tolist() for k in np.unique(label)]


def pool(rows: DataFrame, most: int = POOLED, least: float | None = SIMILAR) -> DataFrame:
    """Segments (chunk_id, segment_idx, text, segment_vec) merged where similar (mean vector, first text), thinned to `most`, renumbered.

    A chunk has few segments (MOST), so a group is small whatever the number of chunks.
    """

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("segment_idx")
        x = np.array(t.column("segment_vec").to_pylist(), np.float64)
        texts = t.column("text").to_pylist()
        groups = merged(x, least) if least is not None else [[i] for i in range(len(x))]
        vectors = np.array([x[g[0]] if len(g) == 1 else _unit(_unit(x[g]).mean(0, keepdims=True))[0] for g in groups])
        keep = farthest(vectors, most)
        return pa.table({"chunk_id": pa.array([t.column("chunk_id")[0].as_py()] * len(keep), pa.string()), "segment_idx": pa.array(range(len(keep)), pa.int32()), "text": pa.array([texts[groups[i][0]] for i in keep], pa.string()), "segment_vec": pa.array([vectors[i].tolist() for i in keep], pa.list_(pa.float64()))})

    return rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), "segment_idx", "text", "segment_vec").groupBy("chunk_id").applyInArrow(one, "chunk_id string, segment_idx int, text string, segment_vec array<double>")
