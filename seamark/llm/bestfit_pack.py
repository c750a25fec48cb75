"""Best-fit packing planned on the histogram of lengths.

The plan is made over counts: at most `capacity` lengths with one count each reach the driver, whatever the number of documents.
Best-fit decreasing places whole runs of equal lengths into whole runs of bins with equal free space; each placement is a run of
slots (length, first rank, count, first sequence, offset). Every piece then takes the slot of its rank within its length. The
rank comes from a range-partitioned order, so no length, however frequent, meets in one task.

Defined results: a null text is empty (one token, the end id); null doc_ids and repeated rows are packed each, those that can't be
told apart in some order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_index, materialise, small_batches
from .tokens import encoder, tokenizer_path

CAPACITY, END_ID = 2048, 0
VOCABULARY = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Slots for `counts[length]` pieces of each length, by best-fit decreasing.

    Returns (first, sequence, offset, sequences): pieces in order of falling length have positions from 0; slot run i holds the
    positions from first[i] up to first[i + 1], each in the next sequence from sequence[i], at offset[i].
    """
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free space: (first sequence, how many)
    frees: list[int] = []  # free spaces with runs, in order
    first, sequence, offset = [], [], []
    position = opened = 0

    def give(free: int, start: int, n: int) -> None:
        if n and free:
            if not runs[free]:
                insort(frees, free)
            runs[free].append((start, n))

    def place(length: int, start: int, bins: int, each: int, used: int) -> None:
        nonlocal position
        for j in range(each):
            first.append(position)
            sequence.append(start)
            offset.append(used + j * length)
            position += bins

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = int(np.searchsorted(frees, length)) if frees else 0
            if at < len(frees):
                free = frees[at]
                start, bins = runs[free].pop()
                if not runs[free]:
                    frees.pop(at)
            else:  # no bin has room: as many new ones as the rest needs
                free, start = capacity, opened
                bins = -(-left // (capacity // length))
                opened += bins
            each = free // length
            full = min(bins, left // each)
            if full:
                place(length, start, full, each, capacity - free)
                left -= full * each
                give(free - each * length, start, full)
            if full < bins and left:  # one more bin takes the rest; left < each here
                place(length, start + full, 1, left, capacity - free)
                give(free - left * length, start + full, 1)
                left, full = 0, full + 1
            give(free, start + full, bins - full)
    return np.array(first, np.int64), np.array(sequence, np.int64), np.array(offset, np.int64), opened


def _piece_batches(path: str, capacity: int):
    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode_many(texts), strict=True):
                ids = np.append(ids, end).astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole texts as ids with the end id, only longer ones cut."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_piece_batches(path, capacity), PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` from 1 to `capacity`, and doc_id and piece for the order."""
    spark = cut.sparkSession
    counts = {int(r["length"]): r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    first, sequence, offset, _ = plan_best_fit(counts, capacity)
    keys = [F.col("length").desc(), F.col("doc_id"), F.col("piece")]
    ranked = global_index(cut, keys, "_rank", "pack")
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("_rank").to_numpy()
            at = np.searchsorted(first, rank, "right") - 1
            added = [pa.array(sequence[at] + rank - first[at], pa.int64()), pa.array(offset[at], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + added, names=names + schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*[F.col(f"`{c}`") for c in names], "_rank").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialise(pieces(docs, path or tokenizer_path(VOCABULARY), capacity), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
