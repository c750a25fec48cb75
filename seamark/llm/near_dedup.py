"""Near-duplicate documents: MinHash, banding, signature and full-set verification, connected components.

A document is the set of its distinct shingles of `size` words (a shorter text is one shingle); sets are linked from `percent` on.
Documents with equal sets are one class, of which the least doc_id goes on. HASHES universal hash minima make a signature, BANDS bands of it make bucket keys.

Candidates come in rounds, none of which lists all pairs of a bucket:
1. every member of a bucket with the bucket's least member, thinned by set sizes and by the signatures' agreement,
2. in buckets that still hold several components and up to SMALL members, each member with those of other components, thinned
   in the same way (so the pairs are at most SMALL times the members),
3. in larger ones, by blocks: documents that share such buckets are a family; all outside its main component meet all of it, a
   block of bounded size with a block, and a task multiplies the two blocks' incidence matrices. Only links come out of a task, one
   for each document and component. Nothing is capped: a family of any size is so many more blocks.
Every candidate is confirmed on the full sets: 100 * common >= percent * union.

No step gives all rows of one bucket, pivot or family to one task: a key with more rows than a task takes is dealt to several, and
what belongs to the key (a pivot's signature or set, a bucket's label) is handed to each of them once.

Two sets at exactly the limit of 80 share no band with probability (1 - 0.8 ** 5) ** 40, about 1e-7; their signatures agree in
less than AGREE of the places with probability below 1e-6. For other limits choose BANDS and ROWS anew.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; rows that share a doc_id are one
document to be reached (their sets are looked at one by one); a null doc_id is linked with nothing, has a null component and is
kept; an empty table gives no rows; other columns are ignored (`near_duplicates`) or kept (`keep_one`), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, handed_out, join_dealt, kept, materialise, scratch, sieve, sieve_flag, small_batches, without
from .components import connected_components
from .tokens import _powers

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
AGREE = 0.65
PERCENT = 80
#: Members of a bucket that are paired by a join; bytes of sets and rows of a block of a family; shingles multiplied at once.
SMALL, BLOCK_BYTES, BLOCK_ROWS, COLUMNS = 64, 512 << 10, 256, 8_192
#: Partners of a pivot that one task compares with it.
PARTNERS = 512
#: Words of a shingle: as op 2's contract has it, and for all other uses.
PAIRS_OF_WORDS, SHINGLE = 2, 5

_RNG = np.random.default_rng(2024)
#: Universal hashing x -> (a * x + b) mod 2 ** 64 with odd a, of which the upper 32 bits count.
_A, _B = _RNG.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 1 << 63, HASHES, np.uint64)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BYTE[_IS_SPACE] = 0
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    held = 0
    for t in texts:
        raw = (t or "").encode() + b"\n"
        part.append(raw)
        held += len(raw)
        if held >= 1 << 20:
            out += _sets_of(part, size)
            part, held = [], 0
    return out + _sets_of(part, size)


def _sets_of(raws: list[bytes], size: int) -> list[np.ndarray]:
    if not raws:
        return []
    data = np.frombuffer(b"".join(raws), np.uint8)
    space = _IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    at = np.flatnonzero(first)
    begins = np.cumsum([0, *map(len, raws)])
    bounds = np.searchsorted(at, begins, "left").tolist()
    h = np.zeros(0, np.uint64)
    if len(at):
        power, inverse = _powers(len(data))
        h = mix(np.add.reduceat(_BYTE[data] * power[: len(data)], at) * inverse[at])
    out = []
    for a, z in zip(bounds, bounds[1:], strict=False):
        n = min(size, z - a)
        if not n:
            out.append(h[:0])
            continue
        x = np.full(z - a - n + 1, n, np.uint64)
        for k in range(n):
            x = (x + h[a + k : z - n + 1 + k]) * _C1
            x ^= x >> np.uint64(29)
        out.append(np.unique(mix(x)))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima of 32 bits."""
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 512):
        x = _A[:, None] * s[None, i : i + 512]
        x += _B[:, None]
        np.minimum(out, x.min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row; the band is part of the key."""
    bands = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _C2, bands.shape[:2]).copy()
    for k in range(ROWS):
        key = mix((key + bands[:, :, k]) * _C1)
    return key.view(np.int64)


SKETCH = "doc_id long, n_shingles long, set_id binary, keys array<long>, signature binary"


def _sketch_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), size)
            signatures = np.array([signature(s) for s in sets]).reshape(-1, HASHES)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if ok else None for s, ok in zip(sets, full, strict=True)], pa.binary()),
                    pa.array([k if ok else None for k, ok in zip(band_keys(signatures), full, strict=True)], pa.list_(pa.int64())),
                    pa.array([(x & np.uint32(0xFFFF)).astype(np.uint16).tobytes() if ok else None for x, ok in zip(signatures, full, strict=True)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_id", "keys", "signature"],
            )

    return run


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _value_batches(size: int):
    """Texts become sets; a text that stands in several rows of a batch is cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("value").to_pylist()
            distinct = list(dict.fromkeys(texts))
            sets = dict(zip(distinct, (s.tobytes() for s in shingle_sets(distinct, size)), strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("b", "_part", "a")), pa.array([sets[t] for t in texts], pa.binary())], names=["b", "_part", "a", "value"])

    return run


def _agree(a: bytes, b: bytes) -> bool:
    return float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean()) >= AGREE


def _linked(percent: int):
    def test(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        common = len(x) + len(y) - len(np.union1d(x, y))
        return 100 * common >= percent * (len(x) + len(y) - common)

    return test


def _pair_batches(test):
    """Rows by b, part and a with nulls first: values of `b` (rows without `a`) come before those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for b, part, a, value in zip(*(batch.column(c).to_pylist() for c in ("b", "_part", "a", "value")), strict=True):
                if (b, part) != at:
                    at, own = (b, part), []
                if a is None:
                    own.append(value)
                elif any(test(value, x) for x in own):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return run


def _block_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links of documents outside the main component (rows marked so) with the block's others, one for each component reached."""
    outside = np.array(rows.column("outside").to_pylist(), bool)
    ids, of = (np.array(rows.column(c).to_pylist(), np.int64) for c in ("id", "of"))
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
    n = np.array([len(s) for s in sets], np.int64)
    small, large = np.minimum(n[x][:, None], n[y][None, :]), np.maximum(n[x][:, None], n[y][None, :])
    open_ = (of[x][:, None] != of[y][None, :]) & (small * 100 >= large * percent)
    a, b = [], []
    if open_.any():
        x, y, open_ = x[open_.any(1)], y[open_.any(0)], open_[np.ix_(open_.any(1), open_.any(0))]
        xs, ys = np.concatenate([sets[i] for i in x]), np.concatenate([sets[i] for i in y])
        both = np.intersect1d(xs, ys)
        common = np.zeros((len(x), len(y)), np.int64)
        for at in range(0, len(both), COLUMNS):
            some = both[at : at + COLUMNS]
            common += np.rint(_incidence(xs, n[x], some) @ _incidence(ys, n[y], some).T).astype(np.int64)
        linked = open_ & (100 * common >= percent * (n[x][:, None] + n[y][None, :] - common))
        for i, row in zip(x.tolist(), linked, strict=True):
            seen: set[int] = set()
            for j in y[row].tolist():
                if int(of[j]) not in seen:
                    seen.add(int(of[j]))
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _incidence(values: np.ndarray, sizes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1: which of `some` (sorted) each set has."""
    out = np.zeros((len(sizes), len(some)), np.float32)
    at = np.searchsorted(some, values)
    hit = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == values)
    out[np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]] = 1
    return out


class NearDuplicates:
    def __init__(self, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT):
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        small_batches(self.spark, 64)  # rows of full sets are large
        self.docs = docs.select(F.col("doc_id").cast("long"), "text")

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) for every row."""
        with scratch(self.spark):
            sketch = materialise(self.docs.mapInArrow(_sketch_batches(self.size), SKETCH), "sketch")
            known = sketch.where("set_id is not null and doc_id is not null")
            classes = materialise(known.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "classes", narrow=True)
            counts = classes.where("n > 1").select("set_id", "n")
            # A set that stands once is its own class where it is; of the others only the rows that go on are shuffled further.
            marked = sieve_flag(known, F.col("set_id"), counts.select("set_id"), "again")
            first = classes.select("set_id", F.col("id").alias("doc_id"))
            some = marked.where("again").join(first, ["set_id", "doc_id"], "left_semi").dropDuplicates(["set_id"])
            one = marked.where("not again").unionByName(some)
            self.nodes = materialise(one.select(F.col("doc_id").alias("id"), "n_shingles", "keys", "signature"), "nodes")
            self.members = self.nodes.select("id", "n_shingles", F.explode("keys").alias("key"))
            buckets = self.members.groupBy("key").agg(F.min("id").alias("pivot"), F.min_by("n_shingles", "id").alias("pivot_n"), F.count("*").alias("n")).where("n > 1")
            self.buckets = materialise(buckets, "buckets")
            components = self._links()
            rows = join_dealt(sketch.select("doc_id", "n_shingles", "set_id"), classes.join(components, "id", "left").select("set_id", F.coalesce("component", "id").alias("of")), "set_id", F.col("doc_id"), "left", counts=counts)
            component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id"))
            out = rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
            return kept(out, "near-duplicates", narrow=True)

    def _links(self) -> DataFrame:
        sizes = F.least("n_shingles", "pivot_n") * 100 >= F.greatest("n_shingles", "pivot_n") * self.percent
        # Most keys are of one document: a sieve drops them before the shuffle.
        shared = sieve(self.members, F.col("key"), self.buckets.select("key"))
        shared = materialise(join_dealt(shared, self.buckets.drop("n"), "key", F.col("id"), counts=self.buckets.select("key", "n")), "shared", narrow=True)
        star = self._agreeing(shared.where("id != pivot").where(sizes).select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
        components = materialise(connected_components(self._confirmed(star)), "components", narrow=True)
        # What a first member does not show: members of other components in the same bucket.
        labelled = shared.join(components, "id", "left").select("key", "id", "n_shingles", F.coalesce("component", "id").alias("of"))
        labelled = materialise(labelled, "labelled", narrow=True)
        mixed = labelled.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.count("*").alias("n")).where("low != high").select("key", "n")
        mixed = materialise(mixed, "mixed", narrow=True)
        left = materialise(labelled.join(mixed.where(F.col("n") <= SMALL), "key"), "left", narrow=True)
        right = left.select("key", F.col("id").alias("b"), F.col("n_shingles").alias("pivot_n"), F.col("of").alias("other"))
        pairs = left.join(right, "key").where("id < b and of != other").where(sizes).select(F.col("id").alias("a"), "b").distinct()
        pairs = pairs.join(star, ["a", "b"], "left_anti").join(star.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        found = self._confirmed(self._agreeing(pairs))
        counts = mixed.where(F.col("n") > SMALL)
        if not counts.isEmpty():
            large = join_dealt(labelled.drop("of"), counts.select("key", F.lit(True).alias("large")), "key", F.col("id"), counts=counts)
            found = found.unionByName(self._in_families(materialise(large.drop("large"), "large", narrow=True), counts, components))
        return components if found.isEmpty() else self._joined(components, found)

    def _in_families(self, large: DataFrame, counts: DataFrame, components: DataFrame) -> DataFrame:
        """Links between components of each family of documents that share large buckets."""
        first = materialise(large.groupBy("key").agg(F.min("id").alias("b")), "first", narrow=True)
        families = connected_components(join_dealt(large, first, "key", F.col("id"), counts=counts).select(F.col("id").alias("a"), "b").distinct()).withColumnRenamed("component", "family")
        ids = large.select("id", "n_shingles").distinct().join(families, "id").join(components, "id", "left").select("id", "n_shingles", "family", F.coalesce("component", "id").alias("of"))
        ids = materialise(ids, "family", narrow=True)
        parts = ids.groupBy("family", "of").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
        parts = parts.groupBy("family").agg(F.max_by("of", F.struct("n", -F.col("of"))).alias("main"), F.max("n").alias("most"), F.max_by("size", F.struct("n", -F.col("of"))).alias("most_size"), F.sum("n").alias("n"), F.sum("size").alias("size"))

        def blocks(n, size):
            return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size * 8 / BLOCK_BYTES), F.lit(1)).cast("int")

        parts = parts.where("n > most").select("family", "n", "main", blocks(F.col("n"), F.col("size")).alias("all_blocks"), blocks(F.col("n") - F.col("most"), F.col("size") - F.col("most_size")).alias("out_blocks"))
        parts = materialise(parts, "parts", narrow=True)
        ids = join_dealt(ids, parts.drop("n"), "family", F.col("id"), counts=parts.select("family", "n"))
        out = F.pmod(F.xxhash64("id"), F.col("out_blocks")).cast("int")
        every = F.pmod(F.xxhash64("id"), F.col("all_blocks")).cast("int")
        outside = ids.where("of != main").select("family", out.alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), F.lit(True).alias("outside"), "id", "of")
        inside = ids.select("family", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("i"), every.alias("j"), F.lit(False).alias("outside"), "id", "of")
        rows = outside.unionByName(inside).join(self._full_sets(ids.select("id").distinct()), "id")
        percent = self.percent
        return materialise(rows.groupBy("family", "i", "j").applyInArrow(lambda t: _block_links(t, percent), "a long, b long"), "links")

    def _joined(self, components: DataFrame, links: DataFrame) -> DataFrame:
        """Components joined by further links: components of the graph whose nodes are the components."""
        a, b = (components.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
        between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        joined = materialise(connected_components(between), "joined", narrow=True)
        members = components.groupBy("component").agg(F.count("*").alias("n"))
        final = joined.select(F.col("id").alias("component"), F.col("component").alias("final"))
        known = join_dealt(components, final, "component", F.col("id"), "left", counts=members).select("id", F.coalesce("final", "component").alias("component"))
        alone = joined.join(components.select("id"), "id", "left_anti").select("id", "component")
        return materialise(known.unionByName(alone), "components", narrow=True)

    def _full_sets(self, ids: DataFrame) -> DataFrame:
        """(id, shingles) of the given documents, from their texts."""
        ids = materialise(ids, "ids", narrow=True)
        texts = sieve(self.docs.withColumnRenamed("doc_id", "id"), F.col("id"), ids).join(ids, "id", "left_semi")
        return materialise(texts.mapInArrow(_set_batches(self.size), "id long, shingles binary"), "sets")

    def _tested(self, pairs: DataFrame, values: DataFrame, test, label: str, make=None) -> DataFrame:
        """The pairs (a, b) whose values (id, value) pass `test`; `make` turns the values of rows that are needed into others.

        A document has a row for each pair it is `a` of, and as `b` one for each PARTNERS of its partners. Rows of one pivot and part
        meet in a task, the pivot's value first. Only values of documents in a pair are shuffled.
        """
        given, many = dealt(pairs, "b", F.col("a"), PARTNERS)
        partners = given.select(F.col("a").alias("id"), "b", "_part", "a")
        pivots = handed_out(pairs.select("b").distinct(), "b", many).select(F.col("b").alias("id"), "b", "_part", F.lit(None).cast("long").alias("a"))
        roles = materialise(partners.unionByName(pivots), "roles", narrow=True)
        rows = sieve(values, F.col("id"), roles.select("id")).join(roles, "id").select("b", "_part", "a", "value")
        rows = rows if make is None else rows.mapInArrow(make, "b long, _part int, a long, value binary")
        both = rows.repartition("b", "_part").sortWithinPartitions("b", "_part", F.col("a").asc_nulls_first())
        return materialise(both.mapInArrow(_pair_batches(test), "a long, b long"), label)

    def _agreeing(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose signatures agree in AGREE of their places."""
        return self._tested(materialise(pairs, "pairs", narrow=True), self.nodes.select("id", F.col("signature").alias("value")), _agree, "star")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets, made from the texts, are alike enough."""
        texts = self.docs.select(F.col("doc_id").alias("id"), F.col("text").alias("value"))
        return self._tested(pairs, texts, _linked(self.percent), "links", _value_batches(self.size))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    return NearDuplicates(docs, size, percent).run()


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document of each group of near duplicates: the one with the least doc_id."""
    gone = near_duplicates(docs, size, percent).where("not kept").select("doc_id").distinct()
    return without(docs, F.col("doc_id"), gone)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), PAIRS_OF_WORDS)


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, said FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS said FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT said, count(*) AS df FROM s GROUP BY said),
r AS (
  SELECT s.doc_id, s.said, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df, s.said) AS pos FROM s JOIN f ON s.said = f.said JOIN n ON s.doc_id = n.doc_id
), rare AS (SELECT * FROM r WHERE pos <= n - (80 * n + 99) // 100 + 1),
pair AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM rare x JOIN rare y ON x.said = y.said AND x.doc_id < y.doc_id
  WHERE least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80
), common AS (
  SELECT a, b, na, nb, count(*) AS c FROM pair JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.said = y.said GROUP BY a, b, na, nb
), link AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN least_of ON d.doc_id = least_of.a
"""
