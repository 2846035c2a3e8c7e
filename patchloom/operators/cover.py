"""Greedy minimum set cover, exactly in greedy order.

Each step selects the patch with most uncovered elements, ties to the smallest slot (patch id), until
all is covered.  cover_lazy proves many steps per Spark job: gains never grow, so whatever the best
patches of a round hold can be settled among themselves as long as the winner still beats the best
patch outside the batch.
"""

from __future__ import annotations

import heapq
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import checkpoint, shared_folder
from ..schema import SELECTION
from . import ingest
from .ingest import dense

#: Patches of a round's batch, and incidences of them that may reach the driver (16 bytes each, and as much to work on).
BATCH_PATCHES, BATCH_ELEMENTS = 500_000, 12_000_000
#: Newly covered elements that may be broadcast.
BROADCAST_ROWS = 500_000
#: Incidences of a group that one task may hold; larger groups are covered together, in rounds.
GROUP_ROWS = 2_000_000
#: The stages of a round, as they are timed.
STAGES = ("top", "collect", "settle", "subtract", "rewrite")


@dataclass
class Profile:
    """Winners, candidates and the seconds of each stage of each round."""

    rounds: list[dict] = field(default_factory=list)

    def report(self) -> str:
        names = ("candidates", "winners", "covered")
        lines = [f"{'round':>6} " + " ".join(f"{n:>11}" for n in (*names, *STAGES))]
        for i, r in enumerate(self.rounds, 1):
            lines.append(f"{i:>6} " + " ".join(f"{r[n]:>11}" for n in names) + " " + " ".join(f"{r.get(n, 0.0):>11.2f}" for n in STAGES))
        total = [sum(r.get(n, 0.0) for r in self.rounds) for n in STAGES]
        return "\n".join([*lines, f"{'all':>6} " + " " * 36 + " ".join(f"{t:>11.2f}" for t in total)])


class _Stopwatch:
    def __init__(self):
        self.took, self.at = {}, time.time()

    def lap(self, name: str) -> None:
        now = time.time()
        self.took[name], self.at = self.took.get(name, 0.0) + now - self.at, now


def greedy(slots: np.ndarray, codes: np.ndarray, offsets: np.ndarray, n: int, outside: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """(index, gain) of the winners in order; `outside` is the (gain, slot) to beat.

    Patch i holds the distinct elements codes[offsets[i]:offsets[i + 1]], numbered from 0 to n - 1.  A
    winner's new elements are looked up in the inverted lists and taken off all gains, each incidence
    once; the heap may hold a patch with a gain that it had before, and puts it back with the one it has.
    """
    sizes = np.diff(offsets)
    gains = sizes.copy()
    owner = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(codes, kind="stable")]
    begin = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=n))))
    covered = np.zeros(n, bool)
    some = np.flatnonzero(gains)
    heap = list(zip((-gains[some]).tolist(), slots[some].tolist(), some.tolist(), strict=True))
    heapq.heapify(heap)
    won = []
    while heap:
        stale, slot, i = heap[0]
        gain = int(gains[i])
        if gain != -stale:
            if gain:
                heapq.heapreplace(heap, (-gain, slot, i))
            else:
                heapq.heappop(heap)
            continue
        if outside and (-gain, slot) > (-outside[0], outside[1]):
            break
        heapq.heappop(heap)
        own = codes[offsets[i] : offsets[i + 1]]
        new = own[~covered[own]]
        covered[new] = True
        length = begin[new + 1] - begin[new]
        holders = owner[np.repeat(begin[new] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        np.subtract.at(gains, holders, 1)
        won.append((i, gain))
    return won


class _Steps:
    """The winners so far: those of one round in memory, those of several in a table of the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n, self.covered, self.held, self.folder = spark, 0, 0, [], None

    def add(self, patches: np.ndarray, gains: np.ndarray) -> None:
        covered = self.covered + np.cumsum(gains)
        steps = np.arange(self.n + 1, self.n + 1 + len(gains))
        self.flush()
        self.held = [pa.table([pa.array(c, pa.int64()) for c in (steps, patches, gains, covered)], schema=pa.schema([pa.field(f.name, pa.int64(), nullable=False) for f in SELECTION]))]
        self.n, self.covered = self.n + len(gains), int(covered[-1]) if len(covered) else self.covered

    def flush(self) -> None:
        for table in self.held:
            self.folder = self.folder or f"{shared_folder(self.spark)}/cover-{uuid.uuid4().hex}"
            self.spark.createDataFrame(table, SELECTION).write.mode("append").parquet(self.folder)
        self.held = []

    def result(self) -> DataFrame:
        if self.folder is None:
            return self.spark.createDataFrame(self.held[0], SELECTION) if self.held else self.spark.createDataFrame([], SELECTION)
        self.flush()
        return self.spark.read.schema(SELECTION).parquet(self.folder)


def _long_column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _ids(spark: SparkSession, ids: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"patch_id": pa.array(ids, pa.int64())}))


def _settle(slots: np.ndarray, own: pa.Table, outside: tuple[int, int] | None) -> list[tuple[int, int]]:
    """The winners among the batch `slots`, whose incidences are `own`."""
    codes, known = pd.factorize(_long_column(own, "hash"))
    patches = _long_column(own, "patch_id")
    order = np.argsort(patches, kind="stable")
    codes, patches = codes[order], patches[order]
    starts, ends = np.searchsorted(patches, slots, "left"), np.searchsorted(patches, slots, "right")
    if (starts[1:] != ends[:-1]).any():  # slots come by gain: their elements in that order
        codes = np.concatenate([codes[a:b] for a, b in zip(starts, ends, strict=True)])
    return greedy(slots, codes, np.concatenate(([0], np.cumsum(ends - starts))), len(known), outside)


def cover_lazy(incidences: DataFrame, partition_by: str = "patch", batch_patches: int = BATCH_PATCHES, batch_elements: int = BATCH_ELEMENTS, profile: Profile | None = None) -> DataFrame:
    """The selection (step, patch_id, gain, covered) of distinct incidences (patch_id, hash).

    Gains by patch are kept in a table.  Per round the best `batch_patches` of them, as far as their
    gains add up to `batch_elements`, go to the driver with their elements, and winners are settled there.
    Then the gains go down by the incidences of the newly covered elements alone; the incidences are
    rewritten without what is covered only when that is half of them.  A patch larger than the whole batch
    is selected without its elements leaving the cluster.  Null ids and hashes are an error.
    """
    spark = incidences.sparkSession
    key = {"patch": "patch_id", "element": "hash"}[partition_by]
    left = checkpoint(ingest.validate(incidences.select("patch_id", "hash")))
    gains = checkpoint(left.groupBy("patch_id").agg(F.count("*").alias("gain")))
    written = remaining = gains.agg(F.coalesce(F.sum("gain"), F.lit(0))).first()[0]
    if remaining > batch_elements:
        left = checkpoint(left.repartition(key))
    covered, steps = None, _Steps(spark)

    def alive() -> DataFrame:
        return left if covered is None else left.join(covered, "hash", "left_anti")

    while remaining:
        watch = _Stopwatch()
        top = gains.orderBy(F.desc("gain"), "patch_id").limit(batch_patches + 1).toArrow()
        slots, best = _long_column(top, "patch_id"), _long_column(top, "gain")
        size = min(len(slots), batch_patches, max(1, int(np.searchsorted(np.cumsum(best), batch_elements, "right"))))
        outside = (int(best[size]), int(slots[size])) if size < len(slots) else None
        slots, best = slots[:size], best[:size]
        watch.lap("top")
        if best[0] > batch_elements:
            won = [(0, int(best[0]))]
        else:
            # At most batch_elements rows; without an outside these are all that is left.
            own = (alive() if outside is None else alive().join(F.broadcast(_ids(spark, slots)), "patch_id")).toArrow()
            watch.lap("collect")
            won = _settle(slots, own, outside)
        winners, new = np.array([slots[i] for i, _ in won], np.int64), np.array([g for _, g in won], np.int64)
        steps.add(winners, new)
        watch.lap("settle")
        done = outside is None and best[0] <= batch_elements
        if not done:
            n = int(new.sum())
            gone = alive().join(F.broadcast(_ids(spark, winners)), "patch_id", "left_semi").select("hash").distinct()
            gone = checkpoint(gone)
            hinted = F.broadcast(gone) if n <= BROADCAST_ROWS else gone
            lost = alive().join(hinted, "hash", "left_semi").groupBy("patch_id").agg(F.count("*").alias("lost"))
            rest = F.col("gain") - F.coalesce("lost", F.lit(0))
            gains = checkpoint(gains.join(lost, "patch_id", "left").select("patch_id", rest.alias("gain")).where("gain > 0"))
            remaining = gains.agg(F.coalesce(F.sum("gain"), F.lit(0))).first()[0]
            watch.lap("subtract")
            if 2 * remaining <= written:
                left, covered, written = checkpoint(alive().join(hinted, "hash", "left_anti").repartition(key)), None, remaining
            else:
                covered = gone if covered is None else checkpoint(covered.unionByName(gone))
            watch.lap("rewrite")
        if profile is not None:
            profile.rounds.append({"candidates": size, "winners": len(won), "covered": steps.covered} | watch.took)
        if done:
            break
    return steps.result()


def cover_naive(incidences: DataFrame) -> DataFrame:
    """The same, one winner per job with all gains counted anew: the ground truth of the tests."""
    spark = incidences.sparkSession
    left, steps, covered = checkpoint(incidences.select("patch_id", "hash")), [], 0
    while best := left.groupBy("patch_id").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "patch_id").first():
        covered += best["gain"]
        steps.append((len(steps) + 1, best["patch_id"], best["gain"], covered))
        gone = left.where(F.col("patch_id") == best["patch_id"]).select("hash")
        left = checkpoint(left.join(gone, "hash", "left_anti"))
    return spark.createDataFrame(steps, SELECTION)


def cover_grouped(incidences: DataFrame, group: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Independent covers, one per value of `group` (a long): (group, step, patch_id, gain, covered).

    Groups of at most `group_rows` incidences are solved in a task each; all larger ones go through one
    cover_lazy on the whole cluster.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        codes, known = pd.factorize(rows["hash"])
        slots, of = np.unique(rows["patch_id"].to_numpy(), return_inverse=True)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(of))))
        won = greedy(slots, codes[np.argsort(of, kind="stable")], offsets, len(known))
        gains = np.array([g for _, g in won], np.int64)
        return pd.DataFrame({group: rows[group].iloc[0], "step": np.arange(1, len(won) + 1), "patch_id": [int(slots[i]) for i, _ in won], "gain": gains, "covered": np.cumsum(gains)})

    schema = f"{group} long, step long, patch_id long, gain long, covered long"
    distinct = checkpoint(ingest.validate(incidences).select(F.col(group).cast("long").alias(group), "patch_id", "hash").distinct())
    sizes = checkpoint(distinct.groupBy(group).count())
    heavy = sizes.where(F.col("count") > group_rows).select(F.col(group).alias("_heavy"))
    some = not heavy.isEmpty()
    same = F.col(group).eqNullSafe(F.col("_heavy"))
    rest = distinct.join(heavy, same, "left_anti") if some else distinct
    every = rest.groupBy(group).applyInPandas(solve, schema)
    return every.unionByName(_cover_together(distinct.join(heavy, same, "left_semi"), group)) if some else every


def _cover_together(rows: DataFrame, group: str) -> DataFrame:
    """The covers of all groups as one: in a disjoint union each group's winners keep their order.

    Patches get dense slots by (patch_id, group), so ties within a group fall to the smaller id.
    """
    slots = checkpoint(_numbered(rows.select("patch_id", group).distinct(), ["patch_id", group], "_slot"))
    elements = checkpoint(_numbered(rows.select("hash", group).distinct(), ["hash", group], "_element"))
    own, other = rows.alias("r"), F.col(f"r.{group}")
    joined = own.join(slots.alias("s"), (F.col("r.patch_id") == F.col("s.patch_id")) & other.eqNullSafe(F.col(f"s.{group}")))
    joined = joined.join(elements.alias("e"), (F.col("r.hash") == F.col("e.hash")) & other.eqNullSafe(F.col(f"e.{group}")))
    won = cover_lazy(joined.select(F.col("_slot").alias("patch_id"), F.col("_element").alias("hash")))
    named = won.select(F.col("patch_id").alias("_slot"), "gain", F.col("step").alias("_step")).join(slots, "_slot")
    order = Window.partitionBy(group).orderBy("_step")  # the winners of a group, not its rows
    return named.select(group, F.row_number().over(order).cast("long").alias("step"), "patch_id", "gain", F.sum("gain").over(order).alias("covered"))


def _numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct rows with dense numbers in their order: ranges are sorted, and counted on the driver by partition."""
    kept = checkpoint(rows.repartitionByRange(*by).sortWithinPartitions(*by))
    return dense(kept, name)


def summary(selection: DataFrame) -> DataFrame:
    """One row: patches selected, elements covered."""
    return selection.agg(F.count("*").alias("selected"), F.coalesce(F.sum("gain"), F.lit(0)).alias("covered"), F.coalesce(F.max("step"), F.lit(0)).alias("iterations"))


def newly_covered(incidences: DataFrame, patch_id: int, selected: DataFrame) -> DataFrame:
    """Elements of a patch that the selected patches (patch_id) do not cover."""
    done = incidences.join(selected, "patch_id", "left_semi").select("hash").distinct()
    return incidences.where(F.col("patch_id") == patch_id).select("hash").join(done, "hash", "left_anti")


def gains_after(incidences: DataFrame, selected: DataFrame) -> DataFrame:
    """(patch_id, gain) of the patches that still cover something after the selected ones."""
    done = incidences.join(selected, "patch_id", "left_semi").select("hash").distinct()
    return incidences.join(done, "hash", "left_anti").groupBy("patch_id").agg(F.count("*").alias("gain"))


def best_patch(gains: DataFrame) -> DataFrame:
    """The patch with the greatest gain, ties to the smallest id."""
    best = F.max(F.struct(F.col("gain").alias("gain"), (-F.col("patch_id")).alias("slot"))).alias("b")
    return gains.agg(best).where("b is not null").select((-F.col("b.slot")).alias("patch_id"), F.col("b.gain").alias("gain"))


class PatchSelector:
    """The library's front: PatchSelector("patch" or "element").select(patches).

    `patches` are occurrences (patch_id, hash, ...) or nested patches (patch_id, hashes or occ), whose ids must
    not repeat.  Equal gains fall to the smaller patch id, or, if there is a column `slot` (see
    ingest.with_slots), to the smaller slot: the input position.
    """

    def __init__(self, partition_by: str = "patch"):
        if partition_by not in ("patch", "element"):
            raise ValueError("partition_by is 'patch' or 'element'")
        self.partition_by, self.profile = partition_by, Profile()

    def select(self, patches: DataFrame) -> DataFrame:
        self.profile = Profile()
        occurrence = ingest.explode_patches(ingest.distinct_ids(patches)) if "pos" not in patches.columns and {"occ", "hashes"} & set(patches.columns) else patches
        if "slot" not in occurrence.columns:
            return cover_lazy(ingest.incidence(ingest.validate(occurrence)), self.partition_by, profile=self.profile)
        slots = checkpoint(ingest.slot_list(occurrence))
        by_slot = ingest.validate(occurrence).select(F.col("slot").alias("patch_id"), "hash")
        won = cover_lazy(ingest.incidence(by_slot), self.partition_by, profile=self.profile).withColumnRenamed("patch_id", "slot")
        return won.join(slots, "slot").select(*SELECTION.names)
