"""Sets of whole numbers as bitmaps, which take one bit for each number between the least and the largest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a bitmap, which takes 4 KB, and how many bitmaps may be broadcast: 64 MB.
BITS, BITMAPS = 32_768, 16_384


def bitmaps_of(numbers: DataFrame, column: str) -> DataFrame | None:
    """The numbers as bitmaps of BITS each, or None if they spread over more than BITMAPS of them."""
    bucket = F.bitmap_bucket_number(column)
    span = numbers.agg(F.min(bucket).alias("low"), F.max(bucket).alias("high")).first()
    if span.low is None or span.high - span.low >= BITMAPS:
        return None
    return numbers.filter(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits")
    )


def with_number_in(rows: DataFrame, number: Column, bitmaps: DataFrame) -> DataFrame:
    """The rows whose number is in the bitmaps, which are broadcast, and those without a number."""
    numbered = rows.withColumn("_number", number)
    at = F.bitmap_bit_position("_number").cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("_byte").bitwiseAND(F.expr("shiftleft(1, _bit)")) != 0
    met = numbered.withColumn("_bucket", F.bitmap_bucket_number("_number")).join(
        F.broadcast(bitmaps.select(F.col("bucket").alias("_bucket"), "bits")), "_bucket", "left"
    )
    found = met.withColumns({"_byte": byte, "_bit": at.bitwiseAND(F.lit(7))})
    return found.filter(F.col("_number").isNull() | bit).select(*rows.columns)
