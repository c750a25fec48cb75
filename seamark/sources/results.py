"""Evaluation inputs: datasets with graded judgments, and the printed results of search tools."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..schemas import DATASET
from ..shared import file_system


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, category, file, rel, grep_patterns): one row a judgment."""
    data = spark.read.schema(DATASET).option("multiLine", True).json(path)
    queries = data.select(F.posexplode("queries").alias("query_id", "q"))
    return queries.select("query_id", "q.query", "q.category", "q.grep_patterns", F.explode_outer("q.judgments").alias("j")).select("query_id", "query", "category", "grep_patterns", "j.file", "j.rel")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def file_of_line(line: Column) -> Column:
    """The path before :a-b, :line: or a first colon; a drive letter's colon is part of the path."""
    return F.regexp_extract(F.trim(strip_ansi(line)), r"^((?:[A-Za-z]:[\\/])?[^:]+)", 1)


#: Lines of tools that are no results.
BANNERS = r"^\s*(\[DEBUG\]|No results|Found \d+|Searching|Indexing|Loading|Warning:|Error:|[-=*]{3,})"


def is_banner(line: Column) -> Column:
    return strip_ansi(line).rlike(BANNERS)


def parse_lines(lines: DataFrame, order: str = "line_no", line: str = "line", key: str = "query_id") -> DataFrame:
    """(query_id, file, rank): files of printed results, the first line of each basename. Banners are no results."""
    rows = lines.where(~is_banner(F.col(line))).select(key, order, file_of_line(F.col(line)).alias("file")).where("file != ''")
    return first_by_basename(rows, key, order)


def parse_json(outputs: DataFrame, output: str = "output", key: str = "query_id") -> DataFrame:
    """The same from a JSON array of {file, start, end, score}."""
    rows = outputs.select(key, F.posexplode(F.from_json(output, "array<struct<file:string,start:int,end:int,score:double>>")).alias("line_no", "r")).select(key, "line_no", "r.file")
    return first_by_basename(rows.where("file is not null"), key, "line_no")


def first_by_basename(rows: DataFrame, key: str, order: str) -> DataFrame:
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, P.basename(F.col("file"))).orderBy(order))).where("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).select(key, "file", "rank")


def line_range(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included) of a text."""
    return F.array_join(F.slice(F.split(content, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def sanitise_id(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_-]", "_")


#: Distinct patterns that go over the files at once, and what makes a pattern more than plain text.
PATTERNS, SPECIAL = 4096, r"[\\^$.|?*+()\[\]{}]"


def grep(files: DataFrame, patterns: DataFrame, k: int) -> DataFrame:
    """(query_id, file_path, ord, rank): files that match a query's patterns (query_id, ord, pattern) in their order, until a pattern has
    brought k distinct files.

    The files are read once for a block of distinct patterns. Of a pattern's files the first 2 k are enough: fewer than k came before
    it, or it isn't looked at.
    """
    distinct, found = patterns.select("pattern").where("pattern is not null").distinct(), None
    block: list[str] = []
    for r in distinct.toLocalIterator():
        block.append(r[0])
        if len(block) == PATTERNS:
            found, block = _with_more(found, files, block, 2 * k), []
    found = _with_more(found, files, block, 2 * k)
    first_files = found.withColumn("_n", F.row_number().over(Window.partitionBy("pattern").orderBy("file_path"))).where(F.col("_n") <= 2 * k).drop("_n")
    hits = patterns.join(first_files, "pattern").select("query_id", "ord", "file_path")
    first = hits.groupBy("query_id", "file_path").agg(F.min("ord").alias("ord"))
    before = F.coalesce(F.sum(F.lit(1)).over(Window.partitionBy("query_id").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = first.withColumn("before", before).where(F.col("before") < k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "file_path"))).where(F.col("rank") <= k).select("query_id", "file_path", "ord", "rank")


def _with_more(found: DataFrame | None, files: DataFrame, block: list[str], most: int) -> DataFrame:
    one = files.select("file_path", "content").where("content is not null").mapInArrow(_matches(block, most), "pattern string, file_path string")
    return one if found is None else found.unionByName(one)


def _matches(patterns: list[str], most: int):
    """Of each pattern the first `most` files that a task has. Plain texts are found by one automaton if the library for it is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = [p for p in patterns if not re.search(SPECIAL, p)]
        others = [(p, re.compile(p)) for p in patterns if re.search(SPECIAL, p)]
        try:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for p in plain:
                automaton.add_word(p, p)
            automaton.make_automaton()
            search = (lambda text: {p for _, p in automaton.iter(text)}) if plain else lambda text: set()
        except ImportError:
            search = lambda text: {p for p in plain if p in text}
        held: dict[str, list[str]] = {}
        for b in batches:
            for path, text in zip(b.column("file_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for p in search(text) | {p for p, find in others if find.search(text)}:
                    held.setdefault(p, []).append(path)
            for p, paths in held.items():
                if len(paths) > 2 * most:
                    held[p] = sorted(paths)[:most]
        rows = [(p, path) for p, paths in held.items() for path in sorted(paths)[:most]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["pattern", "file_path"])

    return run


def attempts(patterns: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, attempts): how many patterns a searcher tries until k files are there. `found`: what `grep` gave."""
    last = found.groupBy("query_id").agg(F.count("*").alias("files"), F.max("ord").alias("last"))
    tried = patterns.select("query_id", "ord").join(last, "query_id", "left").where(F.col("last").isNull() | (F.col("files") < k) | (F.col("ord") <= F.col("last")))
    return tried.groupBy("query_id").agg(F.count("*").alias("attempts"))


def save_report(spark: SparkSession, path: str, dataset: str, at: str, results: DataFrame, summaries: DataFrame) -> None:
    """A report as one indented JSON object: dataset, timestamp, tools, results, summaries. A report is a dataset's queries times tools."""
    rows, sums = ([r.asDict() for r in x.collect()] for x in (results, summaries))
    said = json.dumps({"dataset": dataset, "timestamp": at, "tools": sorted({r["tool"] for r in sums}), "results": rows, "summaries": sums}, indent=2, default=str)
    fs, target = file_system(spark, path)
    stream = fs.create(target, True)
    stream.write(bytearray(said.encode()))
    stream.close()
