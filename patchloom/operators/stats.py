"""Hash statistics: patches per hash and the smallest location, and the top k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import unsigned


def require_locations(occurrence: DataFrame) -> DataFrame:
    """The occurrences, with a run-time error on one without a location."""
    none = F.col("x").isNull() | F.col("y").isNull()
    return occurrence.withColumn("x", F.when(none, F.raise_error(F.lit("an occurrence has no location")).cast("double")).otherwise(F.col("x")))


def hash_stats(occurrence: DataFrame) -> DataFrame:
    """(hash, n_patches, rep): distinct patches, and the least (x, y) over all occurrences.

    First by (patch, hash), so that duplicates and locations shrink map-side; then by hash.  A NaN
    coordinate sorts above all numbers; -0.0 equals 0.0.
    """
    per_patch = occurrence.groupBy("hash", "patch_id").agg(F.min(F.struct("x", "y")).alias("rep"))
    return per_patch.groupBy("hash").agg(F.count("*").alias("n_patches"), F.min("rep").alias("rep"))


def hash_degree(incidences: DataFrame) -> DataFrame:
    return incidences.groupBy("hash").agg(F.count("*").alias("degree"))


def min_location(occurrence: DataFrame) -> DataFrame:
    return occurrence.groupBy("hash").agg(F.min(F.struct("x", "y")).alias("rep"))


def top_k(stats: DataFrame, k: int) -> DataFrame:
    """The k hashes in most patches, ties by ascending unsigned hash; fewer if there are not as many."""
    return stats.orderBy(F.desc("n_patches"), unsigned("hash")).limit(k)
