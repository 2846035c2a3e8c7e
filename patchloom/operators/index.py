"""Dictionary encoding and the forward and inverted indexes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import checkpoint, unsigned
from .ingest import dense, incidence, validate


def dictionary(incidences: DataFrame) -> DataFrame:
    """(hash, element_id): dense ids from 0 in ascending unsigned hash order, without one task for all.

    Distinct hashes are range-partitioned and sorted once, and checkpointed; an id is the rows of the
    partitions before plus the place in its own.  Only a count per partition reaches the driver.
    """
    ranged = incidences.select("hash").distinct().repartitionByRange(unsigned("hash")).sortWithinPartitions(unsigned("hash"))
    return dense(checkpoint(ranged), "element_id").select("hash", "element_id")


def encode(incidences: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Incidences with element ids in place of hashes."""
    return incidences.join(dictionary(incidences) if words is None else words, "hash").select("patch_id", "element_id")


def reverse_map(words: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(words, "element_id").select("element_id", "hash")


def element_shard(words: DataFrame, shards: int) -> DataFrame:
    """The shard of each element: ranges of ceil(N / shards) ids."""
    n = words.agg(F.count("*")).first()[0]
    width = max(1, -(-n // shards))
    return words.select("element_id", F.expr(f"element_id div {width}L").alias("shard"))


def patch_csr(encoded: DataFrame) -> DataFrame:
    """(patch_id, elements) with ascending elements."""
    return encoded.groupBy("patch_id").agg(F.array_sort(F.collect_list("element_id")).alias("elements"))


def local_ids(encoded: DataFrame, elements: int, shards: int) -> DataFrame:
    """Encoded incidences as (shard, patch_id, local_id): ids count from 0 in each shard's range of ids."""
    width = max(1, -(-elements // shards))
    return encoded.select(F.expr(f"element_id div {width}L").alias("shard"), "patch_id", F.expr(f"element_id % {width}L").alias("local_id"))


def sub_csr(encoded: DataFrame, elements: int, shards: int) -> DataFrame:
    """(shard, patch_id, elements): the rows of each shard's part of the matrix, with ascending local ids."""
    return local_ids(encoded, elements, shards).groupBy("shard", "patch_id").agg(F.array_sort(F.collect_list("local_id")).alias("elements"))


def longest_rows(encoded: DataFrame, elements: int, shards: int) -> DataFrame:
    """(shard, longest): the greatest row length in each shard's part, counted without building the rows."""
    return local_ids(encoded, elements, shards).groupBy("shard", "patch_id").count().groupBy("shard").agg(F.max("count").alias("longest"))


def sorted_rows(encoded: DataFrame, by: str = "patch_id") -> DataFrame:
    """The index as sorted pairs in ranges of `by`: what CSR and inverted lists hold, without a row that grows with a hot key."""
    other = "element_id" if by == "patch_id" else "patch_id"
    return encoded.select(by, other).repartitionByRange(by, other).sortWithinPartitions(by, other)


def inverted_index(encoded: DataFrame) -> DataFrame:
    """(element_id, patches) with ascending patches."""
    return encoded.groupBy("element_id").agg(F.array_sort(F.collect_list("patch_id")).alias("patches"))


def patches_of(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The patches of the wanted elements; an empty list for an unknown one."""
    return wanted.select("element_id").join(index, "element_id", "left").select("element_id", F.coalesce("patches", F.array().cast("array<bigint>")).alias("patches"))


def patch_lookup(csr: DataFrame, wanted: DataFrame) -> DataFrame:
    """Elements and size of the wanted patches; size 0 for an empty one."""
    found = wanted.select("patch_id").join(csr, "patch_id", "left")
    elements = F.coalesce("elements", F.array().cast("array<bigint>"))
    return found.select("patch_id", elements.alias("elements"), F.size(elements).cast("long").alias("size"))


class PatchSet:
    """The indexes of one set of patches; built on demand, no algorithm state."""

    def __init__(self, occurrence: DataFrame):
        self.incidence = incidence(validate(occurrence))

    @cached_property
    def dictionary(self) -> DataFrame:
        return checkpoint(dictionary(self.incidence))

    @cached_property
    def encoded(self) -> DataFrame:
        return encode(self.incidence, self.dictionary)

    @cached_property
    def n(self) -> int:
        """The size of the universe."""
        return self.dictionary.count()

    @cached_property
    def m(self) -> int:
        """Patches with an element."""
        return self.incidence.select("patch_id").distinct().count()

    @property
    def csr(self) -> DataFrame:
        return patch_csr(self.encoded)

    @property
    def inverted(self) -> DataFrame:
        return inverted_index(self.encoded)
