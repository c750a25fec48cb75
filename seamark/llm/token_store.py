"""A content-addressed store for token-id streams.

Rolling hashes over windows of ids cut every document's stream into chunks, so equal passages give equal chunks. Each unique
chunk is stored once, in the row of the least doc_id that holds it; all other uses refer to it by its hash. Rows are Parquet
files in ascending order of doc_id, range by range; a row is the document's recipe (chunk hashes and lengths), the data of the
chunks it owns, and the root of a Merkle tree over its chunks. The manifest has one Merkle root for each range and one above.
An id takes 2 bytes, or 4 where the vocabulary has ids beyond 65535; the manifest says which.

Reading resolves references by a join on the hash, of shared chunks only, and checks each chunk against its hash and each
document against its root.

Defined results: a null text is empty (the end id alone); null doc_ids come first; rows that repeat a doc_id are stored each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Ranges, join_dealt, local_rows, materialise, new_folder, scratch, sieve, small_batches
from .tokens import encoder, tokenizer_path

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
#: Chunks: window of the rolling hash (a power of two), mean, least and most ids.
WINDOW, MEAN, LEAST, MOST = 16, 256, 64, 2048
#: Documents of one range of the store, which is sorted and written by one task, row by row, and ranges of one block of starts.
RANGE_DOCS, BLOCK_RANGES = 4_000, 4_096
#: Documents with one shared chunk that one task gives its ids to.
BORROWERS = 1_000
HASH = 16


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: where the rolling hash of the last WINDOW ids has its top bits clear."""
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    step, factor = 1, 0x01000193
    while step < WINDOW:  # the hash of 2 * step ids from two of step ids
        h[step:] = h[step:] + h[:-step] * np.uint32(factor)
        step, factor = 2 * step, factor * factor & 0xFFFFFFFF
    return np.flatnonzero(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - (MEAN.bit_length() - 1))) == 0) + 1


def cut_points(n: int, places: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids, from its marks. Marks before LEAST don't count, so the ids of the document before it,
    which the hash of its first WINDOW ids may hold, make no difference."""
    if n <= 2 * LEAST:
        return [n]
    ends, last = [], 0
    for m in places:
        if m - last < LEAST:
            continue
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            last = m
            ends.append(m)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunk_hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=HASH).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last one goes up as it is; no leaves: the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        pairs = [hashlib.sha256(b"\x01" + leaves[i] + leaves[i + 1]).digest() for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(leaves) & ~1 :]
    return hashlib.sha256(b"\x00" + leaves[0]).digest()


def id_width(path: str) -> int:
    """Bytes of an id of a vocabulary."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab().values(), default=0) < 1 << 16 else 4


#: `ends` has 4 bytes and `hashes` HASH bytes for each chunk, `data` 2 or 4 bytes for each id.
ENCODED = "segment int, doc_id long, n_tokens long, ends binary, hashes binary, data binary"


def _encode_batches(path: str, ranges: Ranges, width: int):
    end = np.array([END_ID], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ends, hashes, data = [], [], []
            texts = enc.encode_many([t or "" for t in b.column("text").to_pylist()])
            ids = np.concatenate([x for one in texts for x in (one, end)])
            n = [len(one) + 1 for one in texts]
            raw, found, begin = ids.astype(f"<u{width}").tobytes(), marks(ids), 0
            borders = np.searchsorted(found, np.cumsum([0, *n]), "right").tolist()
            for size, low, high in zip(n, borders, borders[1:], strict=False):
                cuts = cut_points(size, (found[low:high] - begin).tolist() if high > low else [])
                part = raw[width * begin : width * (begin + size)]
                at = [0, *(width * c for c in cuts)]
                ends.append(np.array(cuts, "<u4").tobytes())
                hashes.append(b"".join([chunk_hash(part[a:z]) for a, z in zip(at, at[1:], strict=False)]))
                data.append(part)
                begin += size
            doc = b.column("doc_id")
            segment = np.where(doc.is_null().to_numpy(zero_copy_only=False), 0, ranges.numbers(doc.fill_null(0).to_numpy())).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ends, pa.binary()), pa.array(hashes, pa.binary()), pa.array(data, pa.binary())],
                names=["segment", "doc_id", "n_tokens", "ends", "hashes", "data"],
            )

    return run


#: `stored`: a byte for each chunk, 1 if its ids are in `data` (empty: all are); `shared`: hashes of own chunks that others look up.
STORED = "segment int, doc_id long, n_tokens long, start_in_segment long, ends binary, hashes binary, stored binary, shared binary, root binary, data binary"


def split_hashes(hashes: bytes) -> list[bytes]:
    return [hashes[i : i + HASH] for i in range(0, len(hashes), HASH)]


def each_hash(hashes: Column) -> Column:
    """array<binary> of the distinct hashes in a row of hashes."""
    n = F.octet_length(hashes) / HASH
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(hashes, i * HASH + 1, F.lit(HASH))))


def _store_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by segment, doc_id, kind: the references of a document come before it."""
        segment = before = doc = None
        foreign: set[bytes] = set()
        shared: set[bytes] = set()
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
        names = ["segment", "doc_id", "n_tokens", "start_in_segment", "ends", "hashes", "stored", "shared", "root", "data"]
        for b in batches:
            out = []
            for seg, d, kind, note, borrowed, n, ends, hashes, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if seg != segment:
                    segment, before, doc = seg, 0, object()
                if d != doc:
                    doc, foreign, shared = d, set(), set()
                if kind == 0:
                    (foreign if borrowed else shared).add(note)
                    continue
                each = split_hashes(hashes)
                stored = mine = b""
                if foreign or len(set(each)) < len(each):  # the chunks that a document repeats are stored once too
                    kept, parts, flags, at = set(foreign), [], bytearray(), 0
                    for h, z in zip(each, np.frombuffer(ends, "<u4").tolist(), strict=True):
                        flags.append(h not in kept)
                        if h not in kept:
                            kept.add(h)
                            parts.append(data[width * at : width * z])
                        at = z
                    stored, data = bytes(flags), b"".join(parts)
                if shared:
                    mine = b"".join(h for h in dict.fromkeys(each) if h in shared)
                out.append((segment, doc, n, before, ends, hashes, stored, mine, merkle_root(each), data))
                before += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


class TokenStore:
    """Write documents to a store and read them back. `path`: in the shared folder if not given."""

    def __init__(self, spark: SparkSession, path: str | None = None, vocabulary: str | None = None):
        self.spark = spark
        self.path = path or new_folder(spark, "token-store")
        self.vocabulary = vocabulary or tokenizer_path(VOCABULARY)
        small_batches(spark)

    def write(self, docs: DataFrame) -> None:
        spark, width = self.spark, id_width(self.vocabulary)
        docs = docs.select(F.col("doc_id").cast("long"), "text")
        n = docs.count()
        ranges = Ranges(docs, "doc_id", n, max(1, -(-n // RANGE_DOCS)))
        with scratch(spark):
            encoded = materialise(docs.mapInArrow(_encode_batches(self.vocabulary, ranges, width), ENCODED), "encoded")
            uses = encoded.select("segment", "doc_id", F.explode(each_hash(F.col("hashes"))).alias("hash"))
            # A chunk is owned by the least doc_id that has it. Only chunks of several documents go further.
            owners = uses.groupBy("hash").agg(F.min(F.struct("doc_id", F.col("segment").alias("of"))).alias("owner"), F.count("*").alias("n")).where("n > 1")
            owners = materialise(owners.select("hash", F.col("owner.doc_id").alias("owner"), "owner.of", "n"), "owners")
            shared = sieve(uses, F.col("hash"), owners.select("hash"))
            borrowed = join_dealt(shared, owners.drop("n"), "hash", F.col("doc_id"), counts=owners.select("hash", "n"))
            borrowed = materialise(borrowed.where(~F.col("doc_id").eqNullSafe(F.col("owner"))), "borrowed")
            lent = borrowed.select(F.col("of").alias("segment"), F.col("owner").alias("doc_id"), "hash").distinct()
            notes = borrowed.select("segment", "doc_id", "hash", F.lit(True).alias("borrowed")).unionByName(lent.withColumn("borrowed", F.lit(False)))
            both = encoded.withColumn("kind", F.lit(1)).unionByName(notes.withColumn("kind", F.lit(0)), allowMissingColumns=True)
            both = both.select("segment", "doc_id", "kind", "hash", "borrowed", "n_tokens", "ends", "hashes", "data")
            rows = both.repartitionById(ranges.n, F.col("segment")).sortWithinPartitions("segment", "doc_id", "kind").mapInArrow(_store_batches(width), STORED)
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/rows")
        self.manifest_rows().withColumn("width", F.lit(width)).write.mode("overwrite").json(f"{self.path}/manifest")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.path}/rows")

    def manifest_rows(self) -> DataFrame:
        """One row for each range: documents, ids and the Merkle root over its documents' roots in order."""

        def roots(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table: dict[int, list] = {}
            for b in groups:
                for r in b.to_pylist():
                    table.setdefault(r["segment"], []).append((r["start_in_segment"], r["n_tokens"], r["root"]))
            for segment, docs in table.items():
                docs.sort()
                root = merkle_root([x[2] for x in docs]).hex()
                yield pa.RecordBatch.from_pylist([{"segment": segment, "n_docs": len(docs), "n_tokens": sum(x[1] for x in docs), "root": root}], schema=pa.schema([("segment", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.string())]))

        narrow = self.rows().select("segment", "start_in_segment", "n_tokens", "root")
        return narrow.repartition("segment").mapInArrow(roots, "segment int, n_docs long, n_tokens long, root string")

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema("segment int, n_docs long, n_tokens long, root string, width int").json(f"{self.path}/manifest")

    def manifest(self) -> tuple[list[tuple[int, int, int, str]], str]:
        """(segment, n_docs, n_tokens, root) of every range in order, and the root over them. For inspection: reading needs no such list."""
        found = sorted((r["segment"], r["n_docs"], r["n_tokens"], r["root"]) for r in self._manifest().collect())
        return found, merkle_root([bytes.fromhex(x[3]) for x in found]).hex()

    def _starts(self) -> DataFrame:
        """(segment, before): ids of all ranges before. Sums of blocks of ranges, one number each, reach the driver."""
        sizes = self._manifest().select("segment", "n_tokens", F.floor(F.col("segment") / BLOCK_RANGES).cast("int").alias("block"))
        blocks, before = sorted((r["block"], r["n"]) for r in sizes.groupBy("block").agg(F.sum("n_tokens").alias("n")).collect()), [0]
        for _, n in blocks:
            before.append(before[-1] + n)
        table = local_rows(self.spark, {"block": ([b for b, _ in blocks], pa.int32()), "earlier": (before[:-1], pa.int64())})
        earlier = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("block").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return sizes.withColumn("here", earlier).join(F.broadcast(table), "block").select("segment", (F.col("earlier") + F.col("here")).alias("before"))

    def read(self, with_ids: bool = False) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, rebuilt from the files and checked. `ids`: 4 bytes each."""
        rows, width = self.rows(), (self._manifest().agg(F.max("width")).first()[0] or 2)
        columns = ["segment", "doc_id", "kind", "hash", "n_tokens", "start_in_segment", "ends", "hashes", "stored", "root", "data"]
        kept = rows.withColumn("kind", F.lit(1)).withColumn("hash", F.lit(None).cast("binary"))
        whole = kept.where("octet_length(stored) = 0").select(*columns)
        lacking = kept.where("octet_length(stored) > 0")
        offered = rows.where("octet_length(shared) > 0").mapInArrow(_offer_batches(width), "hash binary, data binary")
        wanted = lacking.select("doc_id", F.explode(each_hash(F.col("hashes"))).alias("hash"))
        found = join_dealt(wanted, offered, "hash", F.col("doc_id"), most=BORROWERS).select("doc_id", F.lit(0).alias("kind"), "hash", "data")
        rest = found.unionByName(lacking, allowMissingColumns=True).select(*columns)
        rest = rest.repartition("doc_id").sortWithinPartitions("doc_id", "kind", "start_in_segment")
        schema = "segment int, doc_id long, start_in_segment long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
        made = whole.mapInArrow(_rebuild_batches(with_ids, width), schema).unionByName(rest.mapInArrow(_rebuild_batches(with_ids, width), schema))
        return made.join(self._starts(), "segment").select("doc_id", (F.col("before") + F.col("start_in_segment")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def _parts(ends: bytes, each: list[bytes], stored: bytes, data: bytes, width: int = 2) -> Iterator[tuple[bytes, bytes | None]]:
    """(hash, data) of the chunks of a stored row; data is None where it is a reference."""
    at = used = 0
    for i, (h, z) in enumerate(zip(each, np.frombuffer(ends, "<u4").tolist(), strict=True)):
        if stored and not stored[i]:
            yield h, None
        else:
            yield h, data[used : used + width * (z - at)]
            used += width * (z - at)
        at = z


def _offer_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ends, hashes, stored, shared, data in zip(*(b.column(c).to_pylist() for c in ("ends", "hashes", "stored", "shared", "data")), strict=True):
                offered = set(split_hashes(shared))
                out += [(h, part) for h, part in _parts(ends, split_hashes(hashes), stored, data, width) if part is not None and h in offered]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["hash", "data"])

    return run


def _rebuild_batches(with_ids: bool, width: int):
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
    names = ["segment", "doc_id", "start_in_segment", "n_tokens", "ids_crc32", "ids"][: 5 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: object = object()
        known: dict[bytes, bytes] = {}
        for b in batches:
            out = []
            for segment, d, kind, hash_, n, start, ends, hashes, stored, root, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if d != doc:
                    doc, known = d, {}
                if kind == 0:
                    known[hash_] = data
                    continue
                each, parts = split_hashes(hashes), []
                for h, part in _parts(ends, each, stored, data, width):
                    if part is None:
                        part = known[h]
                    elif stored:
                        known[h] = part
                    if chunk_hash(part) != h:
                        raise ValueError(f"doc_id {doc}: a chunk differs from its hash {h.hex()}")
                    parts.append(part)
                if merkle_root(each) != root:
                    raise ValueError(f"doc_id {doc}: the recipe differs from its root")
                ids = np.frombuffer(b"".join(parts), f"<u{width}").astype("<u4").tobytes()
                if len(ids) != 4 * n:
                    raise ValueError(f"doc_id {doc}: {len(ids) // 4} ids instead of {n}")
                out.append((segment, doc, start, n, zlib.crc32(ids)) + (ids,) * with_ids)
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = TokenStore(spark)
    store.write(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return store.read()
