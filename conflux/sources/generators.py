"""Generated relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = 0xFFFFFFFF
# Odd multipliers below 2^31, so that the product with a word of 32 bits fits a long.
_FACTORS = 0x7FEB352D, 0x2C1B3C6D


def _mixed(word: Column) -> Column:
    """A word of 32 bits for a word of 32 bits, one to one, in integer arithmetic that can't overflow."""
    for factor, shift in zip(_FACTORS, (16, 15), strict=True):
        word = ((word.bitwiseXOR(F.shiftright(word, shift))) * F.lit(factor)).bitwiseAND(F.lit(_WORD))
    return word.bitwiseXOR(F.shiftright(word, 16))


def random_key(number: Column, start: int, end: int, seed: int = 0) -> Column:
    """An integer from ``start`` up to, but not including, ``end`` that depends on the row's number and the seed only.

    All integers are about as frequent. As no state is kept between rows, a row has the same key on every machine, in any
    partition, and again if its task is run again.
    """
    if not 0 < end - start < 1 << 31:
        raise ValueError("end must be greater than start, by less than 2^31")
    number = number.cast("long")
    low, high = number.bitwiseAND(F.lit(_WORD)), F.shiftrightunsigned(number, 32)
    seeded = low.bitwiseXOR(_mixed(F.lit(seed & _WORD).cast("long")))
    drawn = _mixed(_mixed(seeded).bitwiseXOR(high))
    return (F.shiftright(drawn * F.lit(end - start), 32) + start).cast("int")


def random_keys(
    spark: SparkSession, rows: int, start: int, end: int, seed: int = 0, key: str = "key"
) -> DataFrame:
    """``rows`` integers drawn evenly from ``start`` up to, but not including, ``end``; duplicates occur."""
    return spark.range(rows).select(random_key(F.col("id"), start, end, seed).alias(key))
