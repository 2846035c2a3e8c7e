"""Hash statistics over a stream of occurrences.

State is one row per (patch, hash) with its least location, so duplicates of a patch count once however
late they come.  Each trigger reads the whole state (complete mode) and adds it up by hash, so it costs
as much as the state is large: set the trigger's interval by that, not by the rows of a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import top_k


def start_hash_stats(occurrences: DataFrame, k: int, publish: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Call `publish(top_k, batch)` after each trigger; both aggregations stay exact under retries."""
    per_patch = occurrences.groupBy("hash", "patch_id").agg(F.min(F.struct("x", "y")).alias("rep"))

    def settle(rows: DataFrame, batch: int) -> None:
        stats = rows.groupBy("hash").agg(F.count("*").alias("n_patches"), F.min("rep").alias("rep"))
        publish(top_k(stats, k), batch)

    writer = per_patch.writeStream.outputMode("complete").foreachBatch(settle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def cover_each_batch(occurrences: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Greedy cover is not incremental: all incidences so far are solved anew after each trigger."""
    from ..operators.cover import cover_lazy

    seen = occurrences.groupBy("patch_id", "hash").agg(F.count("*").alias("n"))

    def settle(rows: DataFrame, batch: int) -> None:
        publish(cover_lazy(rows.select("patch_id", "hash")), batch)

    return seen.writeStream.outputMode("complete").foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
