"""Sets of element ids as bitmaps: one binary per bucket of 32768 ids.

Spark numbers the bits of positive values from 1 on, so an id goes in as id + 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(ids: DataFrame, by: list[str] | None = None, element: str = "element_id") -> DataFrame:
    """(by..., bucket, bits) of the non-negative ids."""
    keyed = ids.select(*(by or []), F.bitmap_bucket_number(F.col(element) + 1).alias("bucket"), F.bitmap_bit_position(F.col(element) + 1).alias("bit"))
    return keyed.groupBy(*(by or []), "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def union(bitmaps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The union of all bitmaps of a group."""
    return bitmaps.groupBy(*(by or []), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The AND of two sets of bitmaps (bucket, bits), bucket by bucket."""
    both = a.select("bucket", "bits", F.lit(1).alias("side")).unionByName(b.select("bucket", "bits", F.lit(2).alias("side")))
    met = both.groupBy("bucket").agg(F.count_distinct("side").alias("sides"), F.bitmap_and_agg("bits").alias("bits"))
    return met.where("sides = 2").select("bucket", "bits")


def popcount(bitmaps: DataFrame, by: list[str] | None = None) -> DataFrame:
    return bitmaps.groupBy(*(by or [])).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def members(bitmaps: DataFrame, by: list[str] | None = None, ascending: bool = False) -> DataFrame:
    """The ids of each set, in ascending order if asked; bytes without a bit are skipped."""
    cells = bitmaps.select(*(by or []), "bucket", "bits", F.explode(F.sequence(F.lit(0), F.octet_length("bits") - 1)).alias("i"))
    byte = F.conv(F.hex(F.expr("substring(bits, i + 1, 1)")), 16, 10).cast("int")
    bits = cells.withColumn("byte", byte).where("byte > 0").select(*(by or []), "bucket", "i", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    found = bits.where(F.getbit("byte", F.col("b")) == 1).select(*(by or []), ((F.col("bucket") - 1) * 32768 + F.col("i") * 8 + F.col("b")).alias("element_id"))
    return found.orderBy(*(by or []), "element_id") if ascending else found


def intersect_count(a: DataFrame, b: DataFrame, element: str = "element_id") -> DataFrame:
    """How many distinct ids of `a` are in `b`: a semi-join, no bitmap needed."""
    return a.select(element).distinct().join(b.select(element).distinct(), element, "left_semi").agg(F.count("*").alias("n"))


def test(bitmaps: DataFrame, probes: DataFrame, element: str = "element_id") -> DataFrame:
    """Each probe and whether its bit is set."""
    asked = probes.select(element, F.bitmap_bucket_number(F.col(element) + 1).alias("bucket"), F.bitmap_bit_position(F.col(element) + 1).alias("bit"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
    return asked.join(bitmaps, "bucket", "left").select(element, F.coalesce(is_set, F.lit(False)).alias("is_set"))
