"""Folders and small tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a new local one in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="seamark-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, the path in it)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def local_rows(spark: SparkSession, columns: dict[str, tuple[list, pa.DataType]]) -> DataFrame:
    """A small table from the driver, as Arrow: no Python runs on the executors for it."""
    return spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, (values, kind) in columns.items()}))


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table, for which no Python runs on the executors."""
    return spark.read.schema(schema).parquet(_empty_folder(spark))


def _empty_folder(spark: SparkSession) -> str:
    path = f"{shared_root(spark)}/nothing"
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    return path


#: Bits of a sieve: at most 4 MB are broadcast.
SIEVE_BITS = 1 << 25


def may_be_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be in `keys` (one column): surely those that are, and few others. The join that follows shuffles only those."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    marked = keys.select(spot(F.col(keys.columns[0])).alias("_spot"))
    made = marked.groupBy(F.bitmap_bucket_number("_spot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    at = F.bitmap_bit_position(spot(F.col(key)))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    tested = rows.withColumn("_bucket", F.bitmap_bucket_number(spot(F.col(key)))).join(F.broadcast(made), "_bucket")
    return tested.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)
