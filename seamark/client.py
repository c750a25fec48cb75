"""One object for an index of a directory: index it, search it, watch its changes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import paths as P
from .functions import text as T
from .functions.embedding import Embedder, HashingEmbedder
from .operators import chunking, search, segments
from .sources import files
from .sources.store import Store
from .streaming import watch

THRESHOLD = 0.65


class Client:
    """`root`: the directory; `home`: where indexes are, each in repos/<id of its directory>."""

    def __init__(self, spark: SparkSession, root: str, home: str, embedder: Embedder | None = None, reranker=None, config: chunking.Config = chunking.Config(), mode: str = "none"):
        self.spark, self.root, self.embedder, self.reranker, self.config = spark, root.rstrip("/"), embedder or HashingEmbedder(), reranker, config
        name = spark.range(1).select(T.short_hash(F.lit(self.root))).first()[0]
        self.store = Store(spark, f"{home.rstrip('/')}/repos/{name}", mode)

    def chunks(self, scanned: DataFrame) -> DataFrame:
        """Chunks with vectors of (file_path, content) rows, as the store takes them."""
        made = chunking.chunk_files(scanned, self.config)
        made = made.withColumn("indexed", F.concat_ws("\n\n", F.when(F.col("description") != "", F.col("description")), "content"))
        made = self.embedder.embed(made, "indexed", "embedding")
        return made.select("id", "file_path", "content", "start_line", "end_line", "embedding", F.create_map(F.lit("description"), "description").alias("metadata"), P.is_test_file(F.concat(F.lit("/"), "file_path")).alias("is_test"))

    def index(self, smart_skip: bool = True) -> dict[str, int]:
        """Index the directory: files are chunked and embedded and take the place of what is there, files that are gone go, in one commit.

        Counts: files processed, those without a chunk (errors), files of the old index that went, chunks.
        """
        scanned = files.scan(self.spark, self.root, smart_skip).select("file_path", "content").persist()
        made = self.chunks(scanned).persist()
        gone = self.store.read("files").select("file_path").join(scanned.select("file_path"), "file_path", "left_anti").persist()
        n, went, chunks, with_chunks = scanned.count(), gone.count(), made.count(), made.select("file_path").distinct().count()
        self.store.apply(made, gone)
        self.store.write_metadata(self.root, self.spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ssXXX\")").first()[0])
        for x in (scanned, made, gone):
            x.unpersist()
        return {"processed": n, "errors": n - with_chunks, "removed": went, "chunks": chunks}

    def preindex(self, most: int | None = None) -> int:
        """Segments of chunks that have none, for late interaction; how many chunks got some."""
        return self.store.preindex(self.embedder, most)

    def search(self, queries: DataFrame | str, limit: int = 10, threshold: float = THRESHOLD, options: search.SearchOptions | None = None) -> DataFrame:
        """Results (query_id, rank, file, start, end, score, content, is_test) for (query_id, query) rows, or for one text."""
        if isinstance(queries, str):
            queries = self.spark.sql("SELECT 0L AS query_id, :q AS query", args={"q": queries})
        asked = self.embedder.embed(queries.select("query_id", "query"), "query", "embedding")
        opts = replace(options or search.SearchOptions(), limit=limit, threshold=threshold)
        chunks, has_segments, terms = self.store.read("chunks"), opts.use_late and self.store.has_segments(), None
        if has_segments:
            said = queries.select("query_id", F.posexplode(T.query_terms(F.col("query"))).alias("term_idx", "term"))
            terms = self.embedder.embed(said, "term", "term_vec").select("query_id", "term_idx", "term_vec")

        def make_segments(ids: DataFrame) -> DataFrame:
            some = chunks.select("id", "content").join(ids.select(F.col("chunk_id").alias("id")), "id", "left_semi")
            return self.embedder.embed(segments.segment_chunks(some), "text", "segment_vec").select("chunk_id", "segment_idx", "segment_vec")

        index = search.Index(chunks, self.store.read("segments") if has_segments else None, self.store.read("files"), self.store.lexical_index() if opts.use_hybrid else None, make_segments)
        return search.search(asked, index, opts, terms, self.reranker)

    def watch(self, changes: str, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Follow a folder of change logs (see streaming.watch)."""
        return watch.watch(watch.change_stream(self.spark, changes), self.store, self.chunks, checkpoint, once)

    def close(self) -> None:
        """Nothing stays open; the index stays."""
