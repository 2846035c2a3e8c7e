"""From nested patches or plain tables to occurrences, incidences and the patch list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import checkpoint
from ..schema import NESTED


def explode_patches(nested: DataFrame) -> DataFrame:
    """(patch_id, occ) or (patch_id, hashes) -> occurrences; a column `slot` stays."""
    ids = ["patch_id", *(["slot"] if "slot" in nested.columns else [])]
    if "occ" in nested.columns:
        return nested.select(*ids, F.posexplode("occ").alias("pos", "o")).select(*ids, "pos", "o.hash", "o.x", "o.y")
    none = F.lit(None).cast("double")
    return nested.select(*ids, F.posexplode("hashes").alias("pos", "hash")).select(*ids, "pos", "hash", none.alias("x"), none.alias("y"))


def distinct_ids(nested: DataFrame) -> DataFrame:
    """The nested patches; an error if an id is null or repeats (one narrow aggregation)."""
    bad = nested.groupBy("patch_id").agg(F.count("*").alias("n")).where("n > 1 or patch_id is null").limit(1).collect()
    if bad:
        raise ValueError("a patch id is null" if bad[0]["patch_id"] is None else f"patch id repeats: {bad[0]['patch_id']}")
    return nested


def with_slots(nested: DataFrame, order: list[str]) -> DataFrame:
    """The nested patches with `slot`: their place, from 0, in the order of the given columns."""
    ids = checkpoint(nested.select("patch_id", *(c for c in order if c != "patch_id")).repartitionByRange(*order).sortWithinPartitions(*order))
    return nested.join(dense(ids, "slot").select("patch_id", "slot"), "patch_id")


def slot_list(occurrence: DataFrame) -> DataFrame:
    """(slot, patch_id), one row a slot; an error if a slot stands for two patches or a patch has two slots."""
    one = occurrence.groupBy("slot").agg(F.min("patch_id").alias("patch_id"), F.max("patch_id").alias("other"))
    of_patch = one.groupBy("patch_id").count().where("count > 1").limit(1).count()
    if of_patch or one.where("slot is null or patch_id <> other").limit(1).count():
        raise ValueError("slots and patch ids do not pair off")
    return one.select("slot", "patch_id")


def dense(kept: DataFrame, name: str) -> DataFrame:
    """The rows of a range-partitioned, sorted checkpoint with their place from 0; a count by partition reaches the driver."""
    placed = kept.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    starts, total = [], 0
    for part, n in sorted(placed.groupBy("_part").count().collect()):
        starts.append((part, total))
        total += n
    bases = kept.sparkSession.createDataFrame(starts, "_part int, _start long")
    return placed.join(F.broadcast(bases), "_part").select(*kept.columns, (F.col("_start") + F.col("_place")).alias(name))  # a row per partition


def places(ids: DataFrame) -> DataFrame:
    """(patch_id, place): distinct ids with their place, from 0, in ascending order."""
    return dense(checkpoint(ids.select("patch_id").repartitionByRange("patch_id").sortWithinPartitions("patch_id")), "place")


def nest_occurrences(occurrence: DataFrame) -> DataFrame:
    """Occurrences -> (patch_id, occ) in order of position."""
    row = F.struct("pos", "hash", "x", "y")
    sorted_rows = F.array_sort(F.collect_list(row))
    return occurrence.groupBy("patch_id").agg(F.transform(sorted_rows, lambda o: F.struct(o["hash"].alias("hash"), o["x"].alias("x"), o["y"].alias("y"))).alias("occ"))


def from_lists(spark: SparkSession, patches: list, ids: list | None = None, coords: list | None = None) -> DataFrame:
    """Patches in memory -> nested DataFrame; coordinates must mirror the shape of the patches."""
    ids = list(range(len(patches))) if ids is None else ids
    if len(ids) != len(patches):
        raise ValueError("as many ids as patches are needed")
    if len(set(ids)) != len(ids):
        raise ValueError("patch ids repeat")
    if coords is not None and [len(c) for c in coords] != [len(p) for p in patches]:
        raise ValueError("coordinates do not mirror the patches")
    points = coords or [[(None, None)] * len(p) for p in patches]
    return spark.createDataFrame([(i, [(h, x, y) for h, (x, y) in zip(p, c, strict=True)]) for i, p, c in zip(ids, patches, points, strict=True)], NESTED)


def from_table(table: DataFrame, patch: Column | str, element: Column | str, x: Column | str | None = None, y: Column | str | None = None) -> DataFrame:
    """Occurrences of any table: a column for the patch, one for the element and, if there are, two for the location."""
    def as_column(c):
        return F.col(c) if isinstance(c, str) else c

    place = [F.lit(None).cast("double") if c is None else as_column(c).cast("double") for c in (x, y)]
    return table.select(as_column(patch).cast("long").alias("patch_id"), F.lit(None).cast("int").alias("pos"), as_column(element).cast("long").alias("hash"), place[0].alias("x"), place[1].alias("y"))


def validate(occurrence: DataFrame) -> DataFrame:
    """The occurrences, with a run-time error on a null patch id or hash."""
    bad = F.col("patch_id").isNull() | F.col("hash").isNull()
    return occurrence.withColumn("hash", F.when(bad, F.raise_error(F.lit("a patch id or a hash is null")).cast("long")).otherwise(F.col("hash")))


def incidence(occurrence: DataFrame) -> DataFrame:
    """Distinct (patch_id, hash); duplicates fall away map-side first."""
    return occurrence.select("patch_id", "hash").distinct()


def patch_list(nested: DataFrame) -> DataFrame:
    """(patch_id, slot) of all patches, empty ones too; the slot is the id, which is the input position."""
    repeated = nested.groupBy("patch_id").agg(F.count("*").alias("n"))
    slot = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("patch id repeats: "), F.col("patch_id").cast("string"))).cast("long")).otherwise(F.col("patch_id"))
    return repeated.select("patch_id", slot.alias("slot"))


def patch_size(incidences: DataFrame) -> DataFrame:
    return incidences.groupBy("patch_id").agg(F.count("*").alias("size"))


def universe_size(incidences: DataFrame) -> DataFrame:
    return incidences.agg(F.count_distinct("hash").alias("n"))


def contiguous_slice(patches: DataFrame, total: int, parts: int) -> DataFrame:
    """patch_id (0 .. total - 1) and the part p that holds it: [total * p / parts, total * (p + 1) / parts)."""
    part = F.expr(f"((patch_id + 1) * {parts}L - 1) div {total}L")
    return patches.select("patch_id", part.alias("part"))


