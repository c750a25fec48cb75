"""Benchmark decontamination with one FM-index for each training shard.

Benchmark items become windows of 13 words (a shorter item is one window). Training texts are read in shards of bounded size;
a shard's words become symbols, an FM-index is built over them, and every window is searched backwards through wavelet ranks.
Occurrences are located by sampled suffix positions and merged into removal spans.

Words that no window holds cannot be part of an occurrence: they all become separators, and a run between separators that is
shorter than the shortest window is left out of the index. That changes no result and keeps the index small.

The benchmark goes to the executors in blocks of at most BLOCK_WORDS words; each block is a pass over the training texts. A block
is the words as one array of numbers, and for each distinct window where it starts in it and which items have it, so its size is a
few arrays as long as the block and the block's distinct words. A longer item is cut, with WINDOW - 1 words in both parts.

Defined results: null or empty texts have no words and no hits; a null item_id is the empty string; repeated items count once by
item_id; repeated documents are judged each; an empty benchmark leaves every document clean; other columns are ignored
(`find_hits`) or kept (`keep_clean`), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_dealt, materialise, small_batches, without
from .fm_index import FMIndex

WINDOW = 13
#: Words of a shard of the index, words of a block of the benchmark, and windows that are searched at once.
SHARD_WORDS, BLOCK_WORDS, AT_ONCE = 1_000_000, 500_000, 1 << 16
#: Lower case for A to Z, a space for all other ASCII but a to z and 0 to 9; what is left between spaces is a word.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Windows:
    """The distinct windows of a block of items: where each starts in the block's words, by length, and the items of each.

    `items`: (name, words). `starts[n]` has a place in `stream` for each window of n words; window k's items are
    `numbers[n][offsets[n][k] : offsets[n][k + 1]]`, in order.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int = WINDOW):
        self.codes: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        parts, by_length, held = [np.zeros(0, np.int32)], {}, 0
        for item, said in items:
            if said:
                n = min(size, len(said))
                parts.append(np.array([self.codes.setdefault(x, len(self.codes) + 1) for x in said], np.int32))
                by_length.setdefault(n, []).append((held, len(said) - n + 1, number[item]))
                held += len(said)
        self.stream = np.concatenate(parts)
        self.starts, self.offsets, self.numbers = {}, {}, {}
        for n, runs in sorted(by_length.items()):
            first, count, item = np.array(runs, np.int64).T
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            _, at_first, which = np.unique(self._rows(at, n), axis=0, return_index=True, return_inverse=True)
            both = np.unique(np.stack([which.ravel(), np.repeat(item, count)]), axis=1)
            self.starts[n] = at[at_first]
            self.offsets[n] = np.searchsorted(both[0], np.arange(len(at_first) + 1))
            self.numbers[n] = both[1].astype(np.int32)
        self.least = min(self.starts, default=1)

    def _rows(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.stream, n)[at]

    def phrases(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first, rows of words) of the windows of n words, AT_ONCE at a time."""
        for i in range(0, len(self.starts[n]), AT_ONCE):
            yield i, self._rows(self.starts[n][i : i + AT_ONCE], n).astype(np.int64)

    def of(self, n: int, k: np.ndarray) -> np.ndarray:
        """Numbers of the items that have any of the windows k of n words."""
        low, high = self.offsets[n][k], self.offsets[n][k + 1]
        count = high - low
        return np.unique(self.numbers[n][np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())])


def occurrences(codes: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, window number) of all windows in a shard's codes (0: no word of the benchmark, or between documents)."""
    none = np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes != 0).view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= windows.least
    starts, ends = starts[long], ends[long]
    if not len(starts) or not windows.starts:
        return none, none, none
    sizes = ends - starts + 1  # with a separator after each run
    first = np.cumsum(sizes) - sizes
    place = np.repeat(starts - first, sizes) + np.arange(sizes.sum())
    text = codes[np.minimum(place, len(codes) - 1)]
    text[first + sizes - 1] = 0
    index = FMIndex(text)
    at, length, number = [], [], []
    known = 1 << index.bits
    for n in windows.starts:
        for first_number, phrases in windows.phrases(n):
            usable = np.flatnonzero((phrases < known).all(axis=1))  # a window with a word above all of the shard's can't occur
            low, high = index.search(phrases[usable])
            count = high - low
            rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at.append(place[index.locate(rows)])
            length.append(np.full(len(rows), n, np.int64))
            number.append(first_number + np.repeat(usable, count))
    return np.concatenate(at), np.concatenate(length), np.concatenate(number)


HITS = "n_words long, hits array<struct<start:int,end:int>>, items array<string>, spans array<struct<start:int,end:int>>"


def _hit_batches(windows: Windows, shard_words: int, only_hits: bool):
    """Adds n_words, hits (runs of words), items and spans (the same runs in code points) to rows with a text, and drops the text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    code = windows.codes.get

    def shard(rows: list[dict], texts: list, parts: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        gap = np.zeros(1, np.int64)
        codes = np.concatenate([x for p in parts for x in (p, gap)])
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        at, length, number = occurrences(codes, windows)
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).view(np.int8)])))
        hits: dict[int, list] = {}
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            d = int(np.searchsorted(begins, s, "right")) - 1
            hits.setdefault(d, []).append({"start": s - int(begins[d]), "end": e - int(begins[d])})
        items: dict[int, set] = {}
        if len(at):
            doc = np.searchsorted(begins, at, "right") - 1
            for n in windows.starts:
                some = np.unique(np.stack([doc[length == n], number[length == n]]), axis=1)
                for d in np.unique(some[0]).tolist():
                    items.setdefault(d, set()).update(windows.of(n, some[1][some[0] == d]).tolist())
        for d, (row, part) in enumerate(zip(rows, parts, strict=True)):
            found = hits.get(d, [])
            places = [(m.start(), m.end()) for m in _WORD.finditer(texts[d])] if found else []
            row |= {"n_words": len(part), "hits": found, "items": sorted(windows.items[k] for k in items.get(d, ()))}
            row["spans"] = [{"start": places[x["start"]][0], "end": places[x["end"] - 1][1]} for x in found]
        return pa.RecordBatch.from_pylist([r for r in rows if r["hits"] or not only_hits], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, parts, held, schema = [], [], [], 0, None
        for b in batches:
            others = b.select([c for c in b.schema.names if c != "text"])
            schema = pa.schema([*others.schema, ("n_words", pa.int64()), ("hits", kind), ("items", pa.list_(pa.string())), ("spans", kind)])
            for row, text in zip(others.to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(text)
                parts.append(np.fromiter(map(code, w, repeat(0)), np.int64, len(w)))
                rows.append(row)
                texts.append(text)
                held += len(w) + 1
                if held >= shard_words:
                    yield shard(rows, texts, parts, schema)
                    rows, texts, parts, held = [], [], [], 0
        if rows:
            yield shard(rows, texts, parts, schema)

    return run


def blocks(benchmark: DataFrame, size: int = WINDOW, block_words: int | None = None) -> Iterator[Windows]:
    """The windows of the items, block by block: all that the driver has of the benchmark at once."""
    most, held, n = max(block_words or BLOCK_WORDS, size), [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").toLocalIterator():
        said, at = words(r["text"]), 0
        while at < len(said):
            part = said[at : at + most - n]
            if len(part) < min(size, len(said)):  # too little room for a window
                part = []
            held.append((r["item_id"], part))
            n += len(part)
            ends = at + len(part) == len(said)
            at = len(said) if ends else at + len(part) - (size - 1 if part else 0)
            if not ends or n >= most:
                yield Windows(held, size)
                held, n = [], 0
    if n:
        yield Windows(held, size)


def merge_runs(runs: Column) -> Column:
    """Sorted runs without overlap from any runs (touching ones become one)."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.sort_array(runs), F.array().cast(kind), step)


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int | None = None, with_key: bool = False) -> DataFrame:
    """(doc_id, n_words, hits, items, spans) for every row of `docs`: merged runs of hit words (end exclusive), the items found, and
    the runs in code points of the text. `with_key`: also the text's key, as `_text`."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    keyed = docs.withColumn("_text", text_key(F.col("text")))
    parts = blocks(benchmark, size, block_words)
    first, second = next(parts, Windows([], size)), next(parts, None)
    if second is None:
        rows, names = (keyed, "doc_id long, _text string") if with_key else (docs, "doc_id long")
        return rows.mapInArrow(_hit_batches(first, SHARD_WORDS, False), f"{names}, {HITS}")
    made = materialise(keyed.mapInArrow(_hit_batches(first, SHARD_WORDS, False), f"doc_id long, _text string, {HITS}"), "first-hits")
    more = None  # of further blocks, what is found in each text that has something
    for part in chain([second], parts):
        one = keyed.mapInArrow(_hit_batches(part, SHARD_WORDS, True), f"doc_id long, _text string, {HITS}").select("_text", "hits", "items", "spans").dropDuplicates(["_text"])
        one = materialise(one, "hits")
        more = one if more is None else more.unionByName(one)
    more = more.groupBy("_text").agg(*[F.flatten(F.collect_list(c)).alias(f"_{c}") for c in ("hits", "items", "spans")])
    both = join_dealt(made, more, "_text", F.col("doc_id"), "left")

    def with_more(c: str) -> Column:
        return F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.concat(c, f"_{c}"))

    return both.select("doc_id", *["_text"] * with_key, "n_words", merge_runs(with_more("hits")).alias("hits"), F.array_sort(F.array_distinct(with_more("items"))).alias("items"), merge_runs(with_more("spans")).alias("spans"))


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: a twentieth of the words or more are hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns. A text decides for all rows that have it."""
    bad = judged(find_hits(docs, benchmark, with_key=True)).where("contaminated").select("_text").distinct()
    return without(docs, text_key(F.col("text")), materialise(bad, "contaminated"))


def digest_columns(found: DataFrame) -> DataFrame:
    return judged(found).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op5_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(find_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP5_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'b', coalesce(CAST(item_id AS VARCHAR), ''), text FROM benchmark
), split AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM words
), item AS (
  SELECT id, w, least(13, len(w)) AS n FROM split WHERE kind = 'b' AND len(w) > 0
), win AS (
  SELECT DISTINCT id AS item, n, array_to_string(w[i:i + n - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM item)
), size AS (SELECT DISTINCT n FROM win), doc AS (
  SELECT CAST(id AS BIGINT) AS doc_id, w FROM split WHERE kind = 'd'
), place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS said
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item, place.n, i FROM place JOIN win ON place.n = win.n AND place.said = win.said
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM doc LEFT JOIN covered ON doc.doc_id = covered.doc_id LEFT JOIN items ON doc.doc_id = items.doc_id
"""
