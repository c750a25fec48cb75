"""Scalar, binary and unit quantisation as column expressions.

Two min-max variants differ in rounding: segments truncate toward zero, the store rounds half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import doubles, once

MODES = {"int8": "int8", "scalar": "int8", "binary": "binary", "bit": "binary"}


def parse_mode(name: str) -> str:
    """none, int8 or binary."""
    return MODES.get(name.strip().lower(), "none")


def int8_minmax(v: Column, rounded: bool = False) -> Column:
    """struct<q array<tinyint>, scale double, min double>; a constant vector has scale 1/255."""
    def ranged(x: Column) -> Column:
        low, high = F.array_min(x), F.array_max(x)
        return F.struct(x.alias("x"), (F.when(high == low, F.lit(1.0)).otherwise(high - low) / 255.0).alias("scale"), low.alias("min"))

    def coded(r: Column) -> Column:
        def q(x: Column) -> Column:
            y = (x - r["min"]) / r["scale"]
            y = F.round(y) - 128 if rounded else y - 128
            return F.greatest(F.lit(-128.0), F.least(F.lit(127.0), y)).cast("int").cast("tinyint")

        return F.struct(F.transform(r["x"], q).alias("q"), r["scale"].alias("scale"), r["min"].alias("min"))

    return once(once(doubles(v), ranged), coded)


def from_int8_minmax(q: Column, scale: Column, low: Column) -> Column:
    return F.transform(q, lambda x: ((x.cast("double") + 128) * scale + low).cast("float"))


def int8_unit(v: Column) -> Column:
    """Clamped to [-1, 1], times 127, truncated."""
    return F.transform(doubles(v), lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 127).cast("int").cast("tinyint"))


def from_int8_unit(q: Column) -> Column:
    return F.transform(q, lambda x: (x.cast("double") / 127).cast("float"))


def binary_words(v: Column, bits: int = 32) -> Column:
    """array<bigint>: a bit is set where the element is above 0, the first element highest. `bits` elements to a word."""
    words = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / bits).cast("int")))

    def word(w: Column) -> Column:
        part = F.slice(v, w * bits + 1, bits)
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1) + (x > 0).cast("bigint"))

    return F.transform(words, word)


def binary_bytes(v: Column) -> Column:
    """The bits packed 8 to a byte, as binary."""
    hexes = F.transform(binary_words(v, 8), lambda w: F.lpad(F.hex(w), 2, "0"))
    return F.unhex(F.array_join(hexes, ""))


def from_binary_words(words: Column, dims: int, bits: int = 32) -> Column:
    """+1 and -1 for each bit."""
    def bit(i: Column) -> Column:
        in_word = F.least(F.lit(bits), F.lit(dims) - F.floor(i / bits).cast("int") * bits)
        w = F.element_at(words, F.floor(i / bits).cast("int") + 1)
        return F.when(F.getbit(w, (in_word - 1 - i % bits).cast("int")) == 1, F.lit(1.0)).otherwise(F.lit(-1.0)).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), bit)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def mixed_dot(x: Column, q: Column, scale: Column, low: Column) -> Column:
    """dot of a float vector with a min-max quantised one, without building the latter: scale * sum(q x) + (128 scale + min) * sum(x)."""
    xs = doubles(x)
    total = F.aggregate(xs, F.lit(0.0), lambda acc, y: acc + y)
    qx = F.aggregate(F.zip_with(doubles(q), xs, lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y)
    return scale * qx + (scale * 128 + low) * total
