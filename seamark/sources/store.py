"""An index in a folder of Parquet tables: upserts, deletes, file vectors, segments, postings, exports, statistics, printed results.

A commit writes only what it adds: a folder v<n> with new rows of any of the tables, and `gone`, the keys whose rows of earlier
versions no longer count. A manifest, moved into place last, names the versions that live, so a reader sees all of a commit or
nothing of it, and a failed commit leaves the index as it was. Reading is an anti-join of the rows with the newest `gone` of their key;
versions after the last `gone` are read without one.
When more than MOST_VERSIONS live, the live rows are written as one version and the old folders are deleted. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..functions import text as T
from ..functions import vector as V
from ..operators import knn, lexical, pooling, segments
from ..schemas import FILE_EMBEDDINGS, GONE, LENGTHS, POSTINGS, SEGMENTS, STORED_CHUNKS
from ..shared import delete_folder, file_system, may_be_in, no_rows

#: Of each table its schema, the column that its rows go by, and the kinds of `gone` that end them.
TABLES = {
    "chunks": (STORED_CHUNKS, "file_path", ("file",)),
    "postings": (POSTINGS, "file_path", ("file",)),
    "lengths": (LENGTHS, "file_path", ("file",)),
    "files": (FILE_EMBEDDINGS, "file_path", ("file", "vector")),
    "segments": (SEGMENTS, "chunk_id", ("chunk",)),
}
MOST_VERSIONS = 16


class Store:
    """`mode`: how vectors are kept (none: floats, int8: unit range, binary: signs). A store keeps the mode it was made with."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "none"):
        self.spark, self.path = spark, path.rstrip("/")
        self.mode = self._manifest()[1] or Q.parse_mode(mode)

    # Versions

    def _manifest(self) -> tuple[list[int], str | None, int]:
        """(live versions, mode, number of the manifest)."""
        fs, at = file_system(self.spark, f"{self.path}/manifests")
        numbers = [int(x.getPath().getName()[:-5]) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")] if fs.exists(at) else []
        if not numbers:
            return [], None, 0
        stream = fs.open(file_system(self.spark, f"{self.path}/manifests/{max(numbers)}.json")[1])
        said = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return said["versions"], said["mode"], max(numbers)

    def _commit(self, tables: dict[str, DataFrame], alone: bool = False) -> None:
        """Add a version; `alone`: it is all there is. The manifest and versions before the last are deleted."""
        versions, _, number = self._manifest()
        n = number + 1
        sort = {"postings": "term", "segments": "chunk_id"}
        for name, rows in tables.items():
            rows = rows.repartitionByRange(F.col(sort[name])).sortWithinPartitions(sort[name]) if name in sort else rows
            rows.write.mode("overwrite").parquet(f"{self.path}/v{n}/{name}")
        said = json.dumps({"versions": [n] if alone else [*versions, n], "mode": self.mode})
        fs, at = file_system(self.spark, f"{self.path}/manifests/{n}.json")
        _, temporary = file_system(self.spark, f"{self.path}/manifests/_{uuid.uuid4().hex}")
        stream = fs.create(temporary, True)
        stream.write(bytearray(said.encode()))
        stream.close()
        if not fs.rename(temporary, at):
            raise RuntimeError(f"another writer made {at}")
        if number:
            delete_folder(self.spark, f"{self.path}/manifests/{number}.json")
        if alone:
            for v in versions:
                delete_folder(self.spark, f"{self.path}/v{v}")
        elif len(versions) + 1 > MOST_VERSIONS:
            self.compact()

    def _part(self, version: int, table: str, schema: str) -> DataFrame | None:
        fs, at = file_system(self.spark, f"{self.path}/v{version}/{table}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{version}/{table}") if fs.exists(at) else None

    def read(self, table: str) -> DataFrame:
        """The live rows of a table."""
        schema, key, kinds = TABLES[table]
        parts, gone, newest = [], None, 0
        for v in self._manifest()[0]:
            if (part := self._part(v, table, schema)) is not None:
                parts.append((v, part.withColumn("_v", F.lit(v))))
            if (part := self._part(v, "gone", GONE)) is not None:
                part = part.where(F.col("kind").isin(*kinds)).select("key", F.lit(v).alias("at"))
                gone, newest = part if gone is None else gone.unionByName(part), v
        # Only what a later version may have ended is joined.
        old, live = (reduce(DataFrame.unionByName, some) if some else None for some in ([x for v, x in parts if v < newest], [x for v, x in parts if v >= newest]))
        if old is not None:
            last = gone.groupBy("key").agg(F.max("at").alias("at"))
            old = old.join(last, (F.col(key) == F.col("key")) & (F.col("_v") < F.col("at")), "left_anti")
            live = old if live is None else old.unionByName(live)
        return no_rows(self.spark, schema) if live is None else live.drop("_v")

    def compact(self) -> None:
        """The live rows as one version, for which old folders make room."""
        self._commit({name: self.read(name) for name in TABLES}, alone=True)

    @staticmethod
    def _gone(kind: str, keys: DataFrame) -> DataFrame:
        return keys.select(F.lit(kind).alias("kind"), F.col(keys.columns[0]).alias("key")).distinct()

    # Chunks

    def _stored(self, chunks: DataFrame) -> DataFrame:
        v = V.normalise(F.col("embedding"))
        made = {"none": ("embedding", v), "int8": ("embedding_i8", Q.int8_unit(v)), "binary": ("embedding_bits", Q.binary_words(v))}[self.mode]
        kinds = {"embedding": "array<float>", "embedding_i8": "array<tinyint>", "embedding_bits": "array<bigint>"}
        names = [f.name for f in no_rows(self.spark, STORED_CHUNKS).schema]
        # In two steps: within a lambda function a name is first looked for among the new columns of its own select.
        out = chunks.select(*[c for c in names if c not in kinds], made[1].alias("_made"))
        return out.select(*[F.col("_made").alias(c) if c == made[0] else F.lit(None).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in names])

    @staticmethod
    def _lexical(chunks: DataFrame) -> dict[str, DataFrame]:
        """Postings and lengths, made where the chunks are."""
        tokens = lexical.document_tokens(chunks, "id", ["content", "file_path"], ["file_path"])
        return {"postings": lexical.placed_postings(tokens, ["file_path"]), "lengths": tokens.select("id", "file_path", F.size("tokens").cast("long").alias("dl"))}

    def _waiting(self):
        """(Hadoop's file system, the folder that is there while chunks may have no postings yet)."""
        return file_system(self.spark, f"{self.path}/waiting")

    def apply(self, chunks: DataFrame | None = None, deleted: DataFrame | None = None, postings: bool = True) -> None:
        """One commit: chunks of the given files take the place of all their old ones, and all that belongs to `deleted` (file_path) goes.

        Vectors are normalised and kept by the store's mode; postings and lengths follow the chunks, file vectors of changed files are
        made anew, segments of chunks that are no more go. Only rows of the given files are read and written. Without `postings` those
        (several times the texts) are left to the first lexical search.
        """
        tables, gone = {}, []
        paths = [x.select("file_path") for x in (chunks, deleted) if x is not None]
        touched = paths[0] if len(paths) == 1 else paths[0].unionByName(paths[1])
        old = self.read("chunks").select("id", "file_path").join(touched.distinct(), "file_path", "left_semi").select("id")
        gone.append(self._gone("file", touched))
        if chunks is not None:
            chunks = chunks.persist()
            tables["chunks"] = self._stored(chunks)
            if postings:
                tables |= self._lexical(chunks)
            else:
                fs, at = self._waiting()
                fs.mkdirs(at)
            tables["files"] = self._file_vectors(chunks)
            old = old.join(chunks.select("id"), "id", "left_anti")
        gone.append(self._gone("chunk", old))
        tables["gone"] = gone[0].unionByName(gone[1])
        self._commit(tables)
        if chunks is not None:
            chunks.unpersist()

    def upsert_chunks(self, chunks: DataFrame, postings: bool = True) -> None:
        self.apply(chunks, postings=postings)

    def delete_files(self, paths: DataFrame) -> None:
        self.apply(deleted=paths)

    def nearest(self, queries: DataFrame, k: int, threshold: float | None = None, query: tuple[str, str] = ("query_id", "embedding")) -> DataFrame:
        """(query_id, id, distance, rank) over the stored vectors, as they are stored: cosine, or the share of bits that differ."""
        rows = self.read("chunks")
        if self.mode == "none":
            return knn.search(queries, rows, k, threshold, query)
        if self.mode == "int8":
            rows = rows.select(F.col("id").alias("_id"), F.col("embedding_i8").alias("_vec"), F.lit(None).cast("double").alias("_scale"), F.lit(None).cast("double").alias("_min")).where("_vec is not null")
            return knn.nearest(queries, rows, k, knn.by_codes("cosine"), threshold, query)
        bits = queries.select(F.col(query[0]).alias("query_id"), F.size(query[1]).alias("dims"), Q.binary_words(F.col(query[1])).alias("bits"))
        dims = bits.agg(F.max("dims")).first()[0] or 1
        rows = rows.select(F.col("id").alias("_id"), F.col("embedding_bits").alias("_vec")).where("_vec is not null")
        found = knn.nearest(bits, rows, k, knn.by_bits, None if threshold is None else threshold * dims, ("query_id", "bits"), kind=int)
        return found.withColumn("distance", F.col("distance") / dims)

    def lexical_index(self) -> lexical.StoredIndex:
        """Postings and lengths of the live chunks. Chunks that have none get them first."""
        fs, at = self._waiting()
        if fs.exists(at) or self.read("lengths").isEmpty():
            ids = self.read("chunks").select("id").join(self.read("lengths").select("id"), "id", "left_anti")
            if not ids.isEmpty():
                self._commit(self._lexical(self._these(self.read("chunks"), ids)))
            fs.delete(at, True)
        return lexical.StoredIndex(self.read("postings"), self.read("lengths"))

    @staticmethod
    def _these(chunks: DataFrame, ids: DataFrame) -> DataFrame:
        """Chunks of these ids (id); the texts of few others are shuffled."""
        return may_be_in(chunks, "id", ids).join(ids, "id", "left_semi")

    # Vectors of files, segments

    @staticmethod
    def _file_vectors(chunks: DataFrame) -> DataFrame:
        return pooling.mean_vectors(chunks.withColumn("embedding", V.normalise(F.col("embedding"))), "file_path", "embedding", F.col("end_line")).select("file_path", "embedding", "chunk_count", F.col("total_lines").cast("int").alias("total_lines"))

    def compute_file_vectors(self) -> int:
        """All file vectors anew, from the stored chunks (upserts keep them up to date)."""
        chunks = self.read("chunks")
        back = F.coalesce("embedding", Q.from_int8_unit(F.col("embedding_i8")), F.flatten(F.transform("embedding_bits", lambda w: Q.from_binary_words(F.array(w), 32))))
        self._commit({"files": self._file_vectors(chunks.withColumn("embedding", back)), "gone": self._gone("vector", self.read("files").select("file_path"))})
        return self.read("files").count()

    def replace_segments(self, rows: DataFrame) -> None:
        """(chunk_id, segment_idx, text, segment_vec): quantised, in place of the old segments of the same chunks; sorted for look-ups."""
        q = rows.withColumn("q", Q.int8_minmax(V.normalise(F.col("segment_vec"))))
        new = q.select("chunk_id", F.col("segment_idx").cast("int").alias("segment_idx"), "text", F.col("q.q").alias("emb_i8"), F.col("q.scale").cast("float").alias("scale"), F.col("q.min").cast("float").alias("min"))
        self._commit({"segments": new, "gone": self._gone("chunk", rows.select("chunk_id"))})

    def preindex(self, embedder, most: int | None = None) -> int:
        """Segments of all chunks that have none yet: cut, embedded, normalised, quantised, stored. `most`: pool each chunk to so many."""
        chunks = self.read("chunks").select("id", "content")
        if self.has_segments():
            done = self.read("segments").select(F.col("chunk_id").alias("id")).distinct()
            chunks = self._these(chunks, chunks.select("id").join(done, "id", "left_anti"))
        rows = embedder.embed(segments.segment_chunks(chunks), "text", "segment_vec").where("segment_vec is not null")
        rows = rows if most is None else segments.pool(rows, most)
        rows = rows.persist()
        n = rows.select("chunk_id").distinct().count()
        if n:
            self.replace_segments(rows)
        rows.unpersist()
        return n

    def has_segments(self) -> bool:
        return not self.read("segments").isEmpty()

    # Whole index

    def clear(self) -> None:
        delete_folder(self.spark, self.path)

    def stats(self) -> tuple[int, int, int]:
        """(files, chunks, bytes on disk)."""
        r = self.read("chunks").agg(F.countDistinct("file_path"), F.count("*")).first()
        fs, at = file_system(self.spark, self.path)
        return r[0], r[1], fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    def export_vectors(self, path: str) -> None:
        self.read("chunks").where("embedding is not null").select("id", "embedding").repartitionByRange(F.col("id")).sortWithinPartitions("id").write.mode("overwrite").parquet(path)

    def export_segments(self, path: str) -> None:
        self.read("segments").repartitionByRange(F.col("chunk_id")).sortWithinPartitions("chunk_id", "segment_idx").write.mode("overwrite").parquet(path)

    def write_metadata(self, repo: str, at: str) -> None:
        fs, target = file_system(self.spark, f"{self.path}/metadata.json")
        stream = fs.create(target, True)
        stream.write(bytearray(json.dumps({"path": repo, "indexed_at": at}).encode()))
        stream.close()


class Buffer:
    """Changes that are held back and committed together: after `most` of them, at `flush`, and before anything is read."""

    def __init__(self, store: Store, most: int = 32):
        self.store, self.most, self.held = store, most, []

    def upsert(self, chunks: DataFrame) -> None:
        self._add((chunks, None))

    def delete(self, paths: DataFrame) -> None:
        self._add((None, paths.select("file_path")))

    def _add(self, change: tuple) -> None:
        self.held.append(change)
        if len(self.held) >= self.most:
            self.flush()

    def flush(self) -> None:
        """Of each file the last change counts."""
        held, self.held = self.held, []
        chunks = deleted = None
        for new, gone in held:
            paths = (gone if new is None else new.select("file_path")).distinct()
            chunks = None if chunks is None else chunks.join(paths, "file_path", "left_anti").select(*chunks.columns)
            deleted = None if deleted is None else deleted.join(paths, "file_path", "left_anti")
            if new is not None:
                chunks = new if chunks is None else chunks.unionByName(new)
            else:
                deleted = paths if deleted is None else deleted.unionByName(paths)
        if held:
            self.store.apply(chunks, deleted)

    def read(self, table: str) -> DataFrame:
        self.flush()
        return self.store.read(table)


def read_vectors(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, embedding) of an export, all or those of the given (id) rows."""
    rows = spark.read.schema("id string, embedding array<float>").parquet(path)
    return rows if ids is None else rows.join(ids, "id", "left_semi")


def metadata_json(metadata: Column) -> Column:
    """A map of metadata as JSON text; null and empty maps are empty texts."""
    return F.when(F.size(metadata) > 0, F.to_json(metadata)).otherwise(F.lit(""))


def parse_metadata(text: Column) -> Column:
    """The map that JSON text holds; what is none is an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def by_ids(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids (query_id, id, rank) with their chunks, in rank order; ids without a chunk drop out."""
    return ranked.join(chunks, "id")


def page(rows: DataFrame, order: str, offset: int, n: int) -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(n)


def context_lines(content: Column, lines: int = 5, width: int = 80) -> Column:
    """The first lines of a chunk; longer ones end in an ellipsis."""
    first = F.slice(F.split(content, "\n"), 1, lines)
    return F.transform(first, lambda x: F.when(F.octet_length(x) > width, F.concat(F.substring(x, 1, width - 3), F.lit("..."))).otherwise(x))


NO_RESULTS = "No results found"


def printed(results: DataFrame, style: str = "default", queries: DataFrame | None = None) -> DataFrame:
    """(query_id, output): results of each query as text, in order of rank. Styles: default, quiet, context, json. `queries` (query_id)
    without a result get NO_RESULTS, or an empty JSON array.

    Results of a query are few (its limit), so each output is one small value.
    """
    place = F.concat(F.col("file"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    if style == "json":
        row = F.struct("file", "start", "end", "score", "content", "is_test")
        out = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", row.alias("r")))).alias("x")).select("query_id", F.to_json(F.transform("x", lambda r: r["r"])).alias("output"))
    else:
        line = {"quiet": F.col("file"), "context": F.concat(place, F.format_string(" (%.2f)", "score"), F.lit("\n"), F.array_join(context_lines(F.col("content")), "\n"))}.get(style, place)
        out = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("x")).select("query_id", F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("output"))
    if queries is None:
        return out
    return queries.select("query_id").distinct().join(out, "query_id", "left").select("query_id", F.coalesce("output", F.lit("[]" if style == "json" else NO_RESULTS)).alias("output"))


def repo_id(path: Column) -> Column:
    return T.short_hash(path, 12)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by partial maxima: a key's rows are never gathered."""
    names = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("_row")).select(*[F.col(f"_row.`{c}`") for c in names])
