"""What several operators share: checkpoints, byte-level text statistics and skew-free ranks."""

from __future__ import annotations

import math
import re
import sys
import tempfile
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised pass handles; a longer document gets a pass of its own.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one if it names none and runs locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Arrow batches hold BATCH_BYTES or so: what a Python worker holds at once.

    A batch is otherwise 10,000 rows of up to 64 MB, on both sides.  A lower limit of the session's is kept.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", conf.get(key)) or 0) if re.fullmatch(r"\d+b?", conf.get(key)) else 0
    if now > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until `docs` has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def broadcast_below(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """`df` with a broadcast hint if it is shown to hold at most `rows` rows, else as it is."""
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if small else df), small


def left_join_hot(rows: DataFrame, small: DataFrame, key: str, total: int, counts: DataFrame, spread: Column, most: int = 1000) -> DataFrame:
    """`rows` left-joined with `small` (at most one row a key) without a task for a hot or null key.

    `counts` holds (key, count) of `rows`.  Keys with over one in `most` of the `total` rows, so fewer
    than `most`, are broadcast with what `small` has for them; their rows, and those with a null key,
    are dealt by `spread` (a long hash of the row) in the shuffled join that serves the other keys.
    """
    other = [c for c in small.columns if c != key]
    hot = counts.where(F.col(key).isNotNull() & (F.col("count") * most > total)).select(key)
    light = checkpoint(hot.join(small, key, "left").select(key, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in other)))
    marked = rows.join(F.broadcast(light), key, "left")
    salt = F.when(F.col("_hot") | F.col(key).isNull(), spread.bitwiseOR(F.lit(1))).otherwise(F.lit(0))
    joined = marked.withColumn("_salt", salt).join(small.withColumn("_salt", F.lit(0).cast("long")), [key, "_salt"], "left")
    return joined.select(*rows.columns, *(F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in other))


def drop_rows(docs: DataFrame, grouped: DataFrame, most: int = 200_000) -> DataFrame:
    """One row of `docs` for each root in `grouped` (doc_id, h, root; one row each): the smallest id, null ids last.

    h is xxhash64 of the text.  The rows that go leave by an anti-join: broadcast if there are at most
    `most` of them, so that the texts stay where they are, else shuffled by id and text, which no group of
    copies makes hot.  Of rows that repeat an id and a text one stays.
    """
    found = checkpoint(grouped)
    own_h, id_, h = unused(docs, "own_h", "drop_id", "drop_h")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")
    best = found.groupBy("root").agg(F.min(order).alias("o"), F.count("*").alias("count"))
    best = checkpoint(best.where("count > 1"))
    # A hot root's keeper is broadcast; the others meet their rows by shuffle.
    total = found.count()
    marked = left_join_hot(found, best.select("root", F.col("o.doc_id").alias("best_id"), F.col("o.h").alias("best_h"), F.lit(True).alias("some")), "root", total, best, F.xxhash64("doc_id", "h"))
    other = F.col("some") & ~(F.col("doc_id").eqNullSafe(F.col("best_id")) & F.col("h").eqNullSafe(F.col("best_h")))
    gone = checkpoint(marked.where(other).select(F.col("doc_id").alias(id_), F.col("h").alias(h)).distinct())
    gone, _ = broadcast_below(gone, most)
    kept = docs.withColumn(own_h, F.xxhash64("text")).join(gone, (F.col(own_h) == F.col(h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left_anti")
    if found.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", own_h])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id's decimal text, mod 3; null ids count as remainder 1 (held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3, F.lit(1))


def cached(name: str, make: Callable):
    """What `make` gives, made once in a process.

    It is kept outside this subpackage, whose functions are pickled with the globals that they use.
    """
    box = sys.modules.setdefault("_patchloom_tables", types.ModuleType("_patchloom_tables"))
    if not hasattr(box, name):
        setattr(box, name, make())
    return getattr(box, name)


# --- texts as bytes ---------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets in them; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges [a, b) whose texts hold about `limit` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> list:
    """The powers of the multiplier and of its inverse, up to n at least."""
    held = cached("powers", list)
    if not held or len(held[0]) <= n:
        held.clear()
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            held.append(np.cumprod(steps, dtype=np.uint64))
    return held


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Spans:
    """Hashes of spans of an integer array: polynomials by prefix sums, then mixed with the length."""

    def __init__(self, values: np.ndarray):
        terms = (values.astype(np.uint64) + np.uint64(1)) * _powers(len(values))[0][: len(values)]
        self._prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._prefix[ends] - self._prefix[starts]) * _powers(len(self._prefix))[1][starts]
        return mix64(h ^ mix64((ends - starts).astype(np.uint64) + np.uint64(0x51ED)))


def word_spans(mark: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `mark` that don't cross a text's edge, and their number by text."""
    begin = np.zeros(len(mark) + 1, bool)
    begin[offsets] = True
    before, after = np.zeros(len(mark), bool), np.zeros(len(mark), bool)
    before[1:], after[:-1] = mark[:-1], mark[1:]
    starts = np.flatnonzero(mark & (~before | begin[:-1]))
    ends = np.flatnonzero(mark & (~after | begin[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some texts and the offsets in them; bytes that are no UTF-8 count as U+FFFD."""
    d, o = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    points = np.frombuffer(d.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((d & 0xC0) != 0x80)))[o]
    if at[-1] != len(points):
        parts = [np.frombuffer(d[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(o[:-1], o[1:], strict=True)]
        points, at = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    return points, at


class Texts:
    """Words, lines and their 64-bit hashes of some texts, by whole-array passes over the bytes.

    A pass holds some 40 to 60 bytes for each byte of its texts, and a text is in one pass whole, so a
    text of 10 MB takes about half a gigabyte.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.in_word = ~_SPACE[self.data]
        self.starts, self.ends, self.n_words = word_spans(self.in_word, self.offsets)
        self._spans = None

    @property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def count(self, which: np.ndarray) -> np.ndarray:
        """True bytes of a mask, by text."""
        total = np.concatenate(([0], np.cumsum(which, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span."""
        if self._spans is None:
            self._spans = Spans(self.data)
        return self._spans.hashes(starts, ends)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, text index and word count of all lines between newlines."""
        newline = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate((self.offsets[:-1], newline + 1)))
        ends = np.sort(np.concatenate((newline, self.offsets[1:])))
        per = 1 + np.diff(np.searchsorted(newline, self.offsets))
        words = np.searchsorted(self.starts, ends) - np.searchsorted(self.starts, starts)
        return starts, ends, np.repeat(np.arange(self.n), per), words


def word_counts(batches, text: str = "text", name: str = "size"):
    """For mapInArrow: every batch with the number of words as one more column."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        sizes = [Texts(data, offsets[a : b + 1]).n_words for a, b in slices(offsets)]
        column = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())
        keep = [c for c in batch.schema.names if c not in (text, name)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], names=[*keep, name])


# --- ranks and running sums without a task per key ----------------------------------------------


def running(df: DataFrame, by: list[str], key: str, order: list[str], buckets: int, value: Column, name: str, counted: DataFrame | None = None) -> DataFrame:
    """`df` with the sum of `value` over the rows that come before, in each `by` group, as `name`.

    Rows are ordered by `key` (a uniform long hash) and then `order`.  A group is cut into `buckets`
    ranges of the key, so no task holds a whole group: sums by range first, then within each range.
    The `by` columns hold no null.  `counted` may give the same rows without what is heavy in `df`.
    """
    width = (1 << 63) // max(buckets, 2) + 1

    def ranged(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_range", F.expr(f"shiftrightunsigned({key}, 1) div {width}L")).withColumn("_value", value.cast("long"))

    cut = ranged(df)
    sums = (cut if counted is None else ranged(counted)).groupBy(*by, "_range").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, "_range").orderBy(F.expr(f"shiftrightunsigned({key}, 1)"), *order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    joined = local.join(bases, [*by, "_range"])
    return joined.withColumn(name, F.col("_base") + F.col("_local")).drop("_range", "_value", "_local", "_base")


def buckets_for(rows: int) -> int:
    """About as many ranges as each holds rows: neither grows like the rows."""
    return max(1, math.isqrt(rows))
