"""Shards by a k-d tree over document metadata, cut at weighted medians.

The coordinates of a document are its size (log), its code points per byte (which tells scripts and
languages apart) and its share of newlines, so equal texts share all coordinates.  A node is
cut along its widest dimension where half of its bytes lie on either side, until leaves hold the
target bytes.  The median is found by byte histograms of a fixed number of bins, refined around the
median; ties at the cut (a source with a third of all rows, a group of copies) are cut by a hash of the
text, and a group of equal texts by a hash of the id - only if it is too heavy to go to one side whole.

The law is `bytes`: shards hold nearly equal bytes.  Slots count from 0 in each shard.

Edge cases: a null text has 1 byte (none plus 1) and the checksum of the empty text; null ids
hash as a value of their own; equal rows are interchangeable; an empty table gives an
empty result; columns of the input beside doc_id and text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, checkpoint, running

SHARDS = 16
BINS = 1024
#: A group of equal texts goes whole to one side of a cut if that moves the cut by at most this share of the node.
WHOLE = 0.01
DIMENSIONS = ("x0", "x1", "x2")


def _unit(*columns) -> Column:
    """A hash of the columns as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def metadata(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, size, text_crc32, the coordinates, and the hashes that order ties: of the text (u), of the row (v)."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = docs.select(*carried, F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.char_length(text).alias("chars"), lines.alias("lines"))
    return rows.select(
        *carried,
        "doc_id",
        "size",
        "text_crc32",
        (F.log2("size") / 40).alias("x0"),
        (F.col("chars") / F.col("size")).alias("x1"),
        (F.col("lines") / F.col("size")).alias("x2"),
        _unit("h", "size").alias("u"),
        _unit("doc_id", "h").alias("v"),
        F.xxhash64("doc_id", "h").alias("key"),
    )


@dataclass
class Level:
    """The cuts of one level, by node: rows at or above (x, u, v) go right, x being of dimension `dim`."""

    dim: list[int]
    x: list[float]
    u: list[float]
    v: list[float]


def _of_node(values: list) -> Column:
    """The value for the row's node, from a literal array of at most SHARDS values."""
    return F.element_at(F.array(*(F.lit(x) for x in values)), F.col("node") + 1)


def _coordinate(dim: list[int]) -> Column:
    return F.element_at(F.array(*DIMENSIONS), _of_node(dim) + 1)


def _medians(rows: DataFrame, want: dict[int, float]) -> dict[int, tuple]:
    """For each node of `rows` (node, size, x): the first x at which the bytes up to and with it pass `want`.

    Returns (x, bytes before it, bytes of it).  Histograms of BINS bins between the least and the
    greatest value narrow the range until it holds one value; each pass is one aggregation over all
    nodes, and what reaches the driver is bounded by nodes * BINS.
    """
    ranges = {r["node"]: (r["lo"], r["hi"]) for r in rows.groupBy("node").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    n_nodes, out, before = max(ranges, default=0) + 1, {}, dict.fromkeys(ranges, 0.0)
    while ranges:
        # A node that is done has an empty range.
        low = _of_node([float(ranges[n][0]) if n in ranges else 1.0 for n in range(n_nodes)])
        high = _of_node([float(ranges[n][1]) if n in ranges else 0.0 for n in range(n_nodes)])
        inside = rows.withColumn("low", low).withColumn("high", high).where("x >= low and x <= high")
        part = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
        hist = inside.groupBy("node", part.alias("bin")).agg(F.sum("size").alias("bytes"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for n in list(ranges):
            for r in sorted((r for r in hist if r["node"] == n), key=lambda r: r["bin"]):
                if before[n] + r["bytes"] > want[n]:
                    break
                before[n] += r["bytes"]
            else:
                before[n] -= r["bytes"]
            if r["lo"] == r["hi"]:
                out[n] = (r["lo"], before[n], float(r["bytes"]))
                del ranges[n]
            else:
                ranges[n] = (r["lo"], r["hi"])
    return out


def build_tree(rows: DataFrame, shards: int = SHARDS, whole: float = WHOLE) -> tuple[list[Level], DataFrame]:
    """The cuts by level, root first, and `rows` with their `shard`; node n has the children 2n and 2n + 1.

    Each level is checkpointed, so that plans don't nest.
    """
    levels: list[Level] = []
    placed = rows.withColumn("node", F.lit(0))
    for depth in range((shards - 1).bit_length()):
        spread = placed.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(c).alias(f"{k}_{c}") for c in DIMENSIONS for k, f in (("lo", F.min), ("hi", F.max)))).collect()
        level = Level(*([z] * 2**depth for z in (0, 0.0, 0.0, 0.0)))
        levels.append(level)
        total, half = {r["node"]: float(r["bytes"]) for r in spread}, {r["node"]: r["bytes"] / 2 for r in spread}
        for r in spread:
            level.dim[r["node"]] = max(range(len(DIMENSIONS)), key=lambda k: (r[f"hi_{DIMENSIONS[k]}"] - r[f"lo_{DIMENSIONS[k]}"], -k))
        of_dim = placed.withColumn("x", _coordinate(level.dim))
        at_x = _medians(of_dim.select("node", "size", "x"), half)
        for n, (x, _, _) in at_x.items():
            level.x[n] = float(x)
        on_x = of_dim.where(F.col("x") == _of_node(level.x))
        at_u = _medians(on_x.select("node", "size", F.col("u").alias("x")), {n: half[n] - at_x[n][1] for n in at_x})
        heavy = {}
        for n, (u, earlier, own) in at_u.items():
            left = half[n] - at_x[n][1] - earlier  # bytes of the group of equal texts that belong left
            level.u[n] = float(u)
            if min(left, own - left) <= whole * total[n]:
                level.v[n] = -1.0 if left <= own - left else 2.0
            else:
                heavy[n] = left
        if heavy:
            on_u = on_x.where((F.col("u") == _of_node(level.u)) & _of_node([n in heavy for n in range(2**depth)]))
            for n, (v, _, _) in _medians(on_u.select("node", "size", F.col("v").alias("x")), heavy).items():
                level.v[n] = float(v)
        placed = checkpoint(_descend(placed, level))
    return levels, placed.withColumnRenamed("node", "shard")


def _descend(placed: DataFrame, level: Level) -> DataFrame:
    here = placed.withColumn("_x", _coordinate(level.dim)).withColumn("_cx", _of_node(level.x)).withColumn("_cu", _of_node(level.u)).withColumn("_cv", _of_node(level.v))
    right = F.expr("_x > _cx or (_x = _cx and (u > _cu or (u = _cu and v >= _cv)))")
    return here.withColumn("node", F.col("node") * 2 + right.cast("int")).drop("_x", "_cx", "_cu", "_cv")


def shard_of(levels: list[Level]):
    """The shard for (x0, x1, x2, u, v), as a column function: one opaque step, however deep the tree."""

    @F.pandas_udf("int")
    def descend(x0: pd.Series, x1: pd.Series, x2: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
        x, u, v = np.column_stack((x0, x1, x2)), u.to_numpy(), v.to_numpy()
        node = np.zeros(len(x), np.int64)
        for level in levels:
            dim, cx, cu, cv = (np.asarray(c)[node] for c in (level.dim, level.x, level.u, level.v))
            own = x[np.arange(len(x)), dim]
            node = 2 * node + ((own > cx) | ((own == cx) & ((u > cu) | ((u == cu) & (v >= cv)))))
        return pd.Series(node, dtype="int32")

    return descend(*DIMENSIONS, "u", "v")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of every document, and its coordinates."""
    if shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    rows = checkpoint(metadata(docs))
    n = rows.count()
    _, placed = build_tree(rows, shards)
    slots = running(placed, ["shard"], "key", ["doc_id", "size", "text_crc32"], buckets_for(n), F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_corpus(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with their columns, size, text_crc32, law, shard and slot, which replace any so named.

    The tree is found on the metadata alone; the texts move once, to the range of a shard in which a row
    gets its slot.
    """
    rows = checkpoint(metadata(docs))
    n = rows.count()
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "text")
    levels, counted = build_tree(rows, shards)
    placed = metadata(packed, "doc").withColumn("shard", shard_of(levels))
    slots = running(placed, ["shard"], "key", ["doc_id", "size", "text_crc32"], buckets_for(n), F.lit(1), "slot", counted)
    made = ("size", "text_crc32", "law", "shard", "slot")
    own = [c for c in docs.columns if c not in made]
    return slots.select(*(F.col("doc").getField(c).alias(c) for c in own), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")
