"""What the training-data operators share: shared-folder tables, bounded Arrow batches and a distributed row index."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete_folder, local_rows, new_folder, shared_root  # noqa: F401

#: Rows of an Arrow batch between the JVM and Python: bounds a worker's memory when texts are very long.
BATCH_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to `rows` (never raises it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


#: Folders of intermediate tables, one list for each `scratch` around the call (in this thread).
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("_OPEN", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at the end, by success or failure; a result is written by `kept`."""
    mine: list[str] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in mine:
            delete_folder(spark, path)


def materialise(df: DataFrame, label: str, codec: str = "zstd", narrow: bool = False) -> DataFrame:
    """Write to the shared folder and read back: lineage ends at files that survive the loss of executors.

    `narrow`: rows of a few numbers; they are written by as many tasks as the cluster has cores, at most twice that.
    """
    path = new_folder(df.sparkSession, label)
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    return _written(df, path, codec, narrow)


def kept(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """The same for what a `scratch` is to leave: it belongs to the scratch around that one, if there is one."""
    path = new_folder(df.sparkSession, label)
    if len(_OPEN.get()) > 1:
        _OPEN.get()[-2].append(path)
    return _written(df, path, "zstd", narrow)


def _written(df: DataFrame, path: str, codec: str, narrow: bool) -> DataFrame:
    if narrow:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """`name`, with as many underscores before it as it takes to be none of `columns` (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bits of a sieve: at most 4 MB are broadcast, however many keys there are (with very many it lets more through).
SIEVE_BITS = 1 << 25


def sieve_flag(rows: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """Adds `flag`, false where the key surely isn't in `keys` (one column) or is null, true where it is (and for few others).

    The bits are made where the keys are and are of bounded size. `key` may use columns of `rows` only.
    """
    spot, bucket, bits = (free_name([*rows.columns, flag, *keys.columns], n) for n in ("_spot", "_bucket", "_bits"))

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))

    marked = keys.select(place(F.col(f"`{keys.columns[0]}`")).alias(spot))
    made = marked.groupBy(F.bitmap_bucket_number(spot).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias(bits))
    names = rows.columns
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    tested = rows.withColumn(spot, F.when(key.isNotNull(), place(key))).withColumn(bucket, F.bitmap_bucket_number(spot)).join(F.broadcast(made), bucket, "left")
    return tested.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(flag))


def sieve(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows whose key may be in `keys` (one column): surely those that are, and few others. Null keys don't pass.

    Put before a join it keeps the other rows from being shuffled.
    """
    flag = free_name(rows.columns, "_may_be")
    return sieve_flag(rows, key, keys, flag).where(F.col(flag)).drop(flag)


def without(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows whose key is not in `keys` (one column, a written table). Only rows that may be in it are shuffled."""
    flag, name = (free_name([*rows.columns, *keys.columns], n) for n in ("_may_be", "_gone"))
    keys = keys.select(F.col(f"`{keys.columns[0]}`").alias(name))
    marked = sieve_flag(rows, key, keys, flag)
    return marked.where(~F.col(flag)).drop(flag).unionByName(marked.where(F.col(flag)).drop(flag).join(keys, key == F.col(name), "left_anti"))


#: Rows of one key that one task joins with what belongs to the key; a key with more is dealt to several tasks.
KEY_ROWS = 20_000


def dealt(rows: DataFrame, key: str, by: Column, most: int = KEY_ROWS, counts: DataFrame | None = None, part: str = "_part") -> tuple[DataFrame, DataFrame | None]:
    """Rows with a column `part`, and (key, _parts) for keys with several parts, or None if no key has more than `most` rows.

    Such a key gets so many parts that each has about `most` rows; `by` says which part a row is in. Other rows are in part 0.
    `counts` (key, n) may be given; else they are summed on the map side. Keys with several parts are at most one in `most` rows.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    many = counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_parts"))
    if many.isEmpty():
        return rows.withColumn(part, F.lit(0)), None
    many = materialise(many, "hot-keys", narrow=True)
    both = rows.join(many, key, "left")
    return both.withColumn(part, F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))).drop("_parts"), many


def handed_out(table: DataFrame, key: str, many: DataFrame | None, part: str = "_part") -> DataFrame:
    """A table with one row a key, repeated for each part that `dealt` made of the key."""
    if many is None:
        return table.withColumn(part, F.lit(0))
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    return table.join(many, key, "left").withColumn(part, F.explode(parts)).drop("_parts")


def join_dealt(rows: DataFrame, table: DataFrame, key: str, by: Column, how: str = "inner", most: int = KEY_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """rows join table on `key`, where `table` has one row a key and some keys may have very many rows."""
    left, many = dealt(rows, key, by, most, counts)
    if many is None:
        return rows.join(table, key, how)
    return left.join(handed_out(table, key, many), [key, "_part"], how).drop("_part")


#: Keys that are sampled for each range, and bounds that are held as a list.
RANGE_SAMPLE, MOST_BOUNDS = 16, 65_536


class Ranges:
    """Ranges of a column of longs with about equally many rows, numbered in order. The same rows give the same ranges.

    Bounds are quantiles of the keys that a hash picks, about RANGE_SAMPLE for each range. Beyond MOST_BOUNDS ranges the span between
    two bounds is cut into `steps` parts of equal width, so there may be any number of ranges, and the driver and the plan hold
    MOST_BOUNDS numbers at most. Null keys are in range 0.
    """

    def __init__(self, rows: DataFrame, key: str, n_rows: int, ranges: int):
        self.key, spans = key, max(1, min(ranges, MOST_BOUNDS, n_rows))
        self.steps = -(-ranges // spans) if spans == MOST_BOUNDS else 1
        share = min(1.0, RANGE_SAMPLE * spans / max(1, n_rows))
        some = rows.select(F.col(f"`{key}`").alias("k")).where(F.col("k").isNotNull() & (F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))))
        found = some.groupBy("k").agg(F.count("*").alias("n")).toArrow().sort_by("k")
        keys, seen = found.column("k").to_numpy().astype(np.int64), np.cumsum(found.column("n").to_numpy())
        at = np.searchsorted(seen, np.arange(1, spans) * (int(seen[-1]) / spans if len(seen) else 0), "left")
        self.bounds = np.unique(keys[np.minimum(at + 1, len(keys) - 1)]) if len(keys) else keys
        edges = np.concatenate([keys[:1], self.bounds, keys[-1:]]).astype(np.float64) if len(keys) else np.zeros(2)
        self.low, self.width = edges[:-1], np.maximum(1.0, np.ceil(np.diff(edges) / self.steps))
        self.n = (len(self.bounds) + 1) * self.steps

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        span = np.searchsorted(self.bounds, keys, "right")
        if self.steps == 1:
            return span.astype(np.int32)
        inside = np.floor((keys.astype(np.float64) - self.low[span]) / self.width[span])
        return (span * self.steps + np.clip(inside, 0, self.steps - 1)).astype(np.int32)

    def column(self) -> Column:
        """The same by built-in functions: a binary search in a constant array."""
        key = F.col(f"`{self.key}`")

        def constant(xs: np.ndarray, kind: str) -> Column:
            return F.from_json(F.lit("[" + ",".join(map(repr, xs.tolist())) + "]"), f"array<{kind}>")

        span = F.lit(0)
        if len(self.bounds):
            bounds, n = constant(self.bounds, "bigint"), len(self.bounds)
            steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
            span = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))
        if self.steps > 1:
            inside = F.floor((key.cast("double") - F.get(constant(self.low, "double"), span)) / F.get(constant(self.width, "double"), span))
            span = span * self.steps + F.greatest(F.lit(0), F.least(F.lit(self.steps - 1), inside.cast("int")))
        return F.when(key.isNull(), F.lit(0)).otherwise(span).cast("int")


def global_index(df: DataFrame, keys: list[Column], name: str, label: str = "indexed") -> DataFrame:
    """Add a gapless 0-based position in the order of `keys`, without ever sorting in one task.

    Rows are range-partitioned and sorted, the sorted rows are written once, the row counts of the range partitions
    (one number each) give the offsets. Ties are put in some order, fixed by the written rows.
    """
    spark = df.sparkSession
    ordered = materialise(
        df.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((int(p), total))
        total += n
    if not offsets:
        return ordered.withColumn(name, F.col("_at")).drop("_at")
    table = F.broadcast(local_rows(spark, {"_part": ([x[0] for x in offsets], pa.int64()), "_before": ([x[1] for x in offsets], pa.int64())}))
    return (
        ordered.withColumn("_part", part)
        .join(table, "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_before", "_at")
    )
