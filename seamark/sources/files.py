"""Files as rows: a directory scan with the engine's file rules, ignore files, and repository metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

IGNORE_FILES = (".gitignore", ".seamarkignore")


def read_ignore_patterns(spark: SparkSession, root: str) -> list[str]:
    """The defaults, then the lines of the root's ignore files, without blank lines and comments (a few lines on the driver)."""
    out = list(P.IGNORED)
    for name in IGNORE_FILES:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):  # hidden files are none to Spark's readers
            stream = fs.open(at)
            lines = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            stream.close()
            out += [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
    return out


def scan(spark: SparkSession, root: str, smart_skip: bool = True, patterns: list[str] | None = None) -> DataFrame:
    """(file_path relative to the root, content, is_test) of code files of 1 byte to 1 MB that no pattern ignores.

    The size is a filter of the scan itself, so larger files are not read. In trees of more than MANY_FILES files the low-value ones go.
    """
    prefix = root.removeprefix("file://").rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length").between(1, P.MOST_BYTES))
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    relative = F.substring(plain, F.lit(len(prefix) + 2), F.length("path"))
    rows = files.withColumn("file_path", relative)
    rows = rows.where(P.is_code_file(F.col("file_path")) & ~P.should_ignore(F.col("file_path"), read_ignore_patterns(spark, root) if patterns is None else patterns))
    if smart_skip and rows.select("file_path").count() > P.MANY_FILES:
        rows = rows.where(~P.should_smart_skip(F.col("file_path")))
    return rows.select("file_path", F.decode("content", "UTF-8").alias("content"), P.is_test_file(F.concat(F.lit("/"), F.lit(prefix.strip("/")), F.lit("/"), F.col("file_path"))).alias("is_test"))


def repositories(spark: SparkSession, home: str) -> DataFrame:
    """(path, indexed_at) of every readable repos/*/metadata.json."""
    return spark.read.schema("path string, indexed_at string").option("mode", "DROPMALFORMED").option("multiLine", True).json(f"{home.rstrip('/')}/repos/*/metadata.json").where("path is not null")
