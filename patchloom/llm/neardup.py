"""Near-duplicates by similarity: SimHash with pivot distance tables, verified on shingle sets.

A text's set holds the hashes of its 5-word shingles (ASCII letters lower-cased; the whole text if it
has fewer words).  Two documents are linked if their sets have a Jaccard similarity of 0.8 or more,
counted exactly on the sets.  Equal sets are one node.  Nodes are dealt to buckets by BANDS bands of ROWS
minima; a pair at 0.8 shares no bucket with a chance of 7e-6, a closer one with less.

First every node of a bucket is compared with two of its members, the most copied one and the one with
the smallest hash: pairs in proportion to the rows, which connect most of a group however large.  Buckets
that then still hold several components are opened.  There each node has a wide SimHash fingerprint and a
row of Hamming distances to reference fingerprints, members of the bucket far apart from each other; a
pair whose rows differ by more than RADIUS in any coordinate is discarded, then one whose fingerprints do,
and the survivors' sets are compared.  A bucket gives links that connect its components, never all pairs.

Fingerprints have 512 bits because 64 can't tell 0.8 from 0.5: a pair at 0.8 differs in 15 % of the bits
on average, with a spread of 1.6 % at 512 bits, so RADIUS (23 %) loses less than one in a million, and a
pair at 0.6 or less is mostly discarded.  Sets of under LEAST_SET shingles skip that filter.

An opened bucket of over CHUNK rows (or CHUNK_SHINGLES shingles) is cut into chunks that meet pairwise;
the rows of its largest component meet the others' chunks only.  So its work grows with the rows that the
first round left apart times the bucket's rows, and is spread over tasks.

Edge cases: null and empty texts are one node; repeated rows keep one row; null ids come last; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, broadcast_below, checkpoint, drop_rows, mix64, slices, small_batches, text_bytes
from .simhash import _LOWER, components, majority

SHINGLE = 5
BANDS, ROWS = 30, 5
#: Words of 64 bits of a fingerprint, bits that a pair at 0.8 may differ in, and the least set they speak for.
WIDE, RADIUS, LEAST_SET = 8, 118, 32
#: Reference fingerprints of a bucket, at most.
PIVOTS = 16
#: Rows and shingles of an opened bucket that meet in one task, about.
CHUNK, CHUNK_SHINGLES = 4000, 2_000_000
#: Candidates whose text hashes may be broadcast.
MANY_CANDIDATES = 200_000

_RNG = np.random.default_rng(5)
_FLIPS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FACTORS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingle_sets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and their number by text."""
    t.data = _LOWER[t.data]
    words = t.hashes(t.starts, t.ends)
    n = np.where(t.n_words >= SHINGLE, t.n_words - SHINGLE + 1, np.minimum(t.n_words, 1))
    first = np.cumsum(t.n_words) - t.n_words
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    span = np.repeat(np.minimum(t.n_words, SHINGLE), n)
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE if len(at) else 0):
        longer = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(at + k, len(words) - 1)])
        h = np.where(k < span, longer, h)
    doc = np.repeat(np.arange(t.n), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=t.n)


def set_keys(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h), dtype=np.uint64)))
    ends = np.cumsum(n)
    return mix64(total[ends] - total[ends - n] + mix64(n.astype(np.uint64)))


def bands(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One row a text: its BANDS band keys, each of its band alone; zeros for an empty set."""
    out = np.zeros((len(n), BANDS), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        starts, x = (np.cumsum(n) - n)[some], (h >> np.uint64(32)).astype(np.uint32)
        for k in range(BANDS):
            key = np.full(len(some), k, np.uint64)
            for j in range(k * ROWS, (k + 1) * ROWS):
                least = np.minimum.reduceat((x ^ _FLIPS[j]) * _FACTORS[j], starts)
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(1))
            out[some, k] = key
    return out


def wide_fingerprints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One row a text: its SimHash fingerprint of WIDE * 64 bits over the set."""
    return np.column_stack([majority(mix64(h + np.uint64(w + 1) * np.uint64(0xD6E8FEB86659FD93)), n) for w in range(WIDE)])


def _lists(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _signed(batches):
    for batch in batches:
        keys, counts, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.uint64)]
        data, offsets = text_bytes(batch.column("text"))
        for a, b in slices(offsets):
            h, n = shingle_sets(Texts(data, offsets[a : b + 1]))
            keys.append(set_keys(h, n))
            counts.append(n)
            rows.append(bands(h, n))
        every = np.concatenate(rows)
        made = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64)), _lists(every.ravel(), np.full(len(every), BANDS))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *made], names=["doc_id", "h", "node", "n", "bands"])


def _sets(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in slices(offsets):
            h, n = shingle_sets(Texts(data, offsets[a : b + 1]))
            fp = _lists(wide_fingerprints(h, n).ravel(), np.full(len(n), WIDE))
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(h, n).view(np.int64)), _lists(h, n), fp], names=["node", "set", "fp"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(one, "a").join(two, "b").where(both * 5 >= (F.size("set_a") + F.size("set_b") - both) * 4).select("a", "b")


# --- opened buckets -----------------------------------------------------------------------------


def hamming(fps: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ one).sum(axis=1, dtype=np.int16)


def distance_table(fps: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Hamming distances of all rows to references among them: each the farthest from those before it."""
    columns, nearest = [], np.full(len(fps), np.iinfo(np.int16).max, np.int16)
    at = 0
    while len(columns) < most and nearest[at]:
        columns.append(hamming(fps, fps[at]))
        nearest = np.minimum(nearest, columns[-1])
        at = int(np.argmax(nearest))
    return np.column_stack(columns)


class Bucket:
    """Nodes with their components, sets and fingerprints; `links` names the components that near pairs connect."""

    def __init__(self, node: np.ndarray, root: np.ndarray, side: np.ndarray | None, flat: np.ndarray, offsets: np.ndarray, fps: np.ndarray):
        self.node, self.side, self.flat, self.offsets, self.fps = node, side, flat, offsets, fps
        self.root, self.label = np.unique(root, return_inverse=True)
        self.n = np.diff(offsets)
        self.small = self.n < LEAST_SET

    def near(self, r: int, others: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Of `others`, those that sizes, pivots and fingerprints don't tell apart from r; nearest first."""
        n = self.n[others]
        others = others[np.minimum(n, self.n[r]) * 5 >= np.maximum(n, self.n[r]) * 4]
        if self.small[r]:
            return others
        others = others[self.small[others] | (np.abs(table[others] - table[r]).max(axis=1, initial=0) <= RADIUS)]
        apart = hamming(self.fps[others], self.fps[r])
        keep = np.flatnonzero(self.small[others] | (apart <= RADIUS))
        return others[keep[np.argsort(apart[keep], kind="stable")]]

    def similar(self, r: int, others: np.ndarray) -> np.ndarray:
        """Which of `others` have a Jaccard similarity of 0.8 or more with r."""
        mine, n = self.flat[self.offsets[r] : self.offsets[r + 1]], self.n[others]
        theirs = np.concatenate([self.flat[self.offsets[k] : self.offsets[k + 1]] for k in others])
        found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        both = np.add.reduceat(found.astype(np.int64), np.cumsum(n) - n)
        return both * 5 >= (n + len(mine) - both) * 4

    def links(self, block: int = 64):
        table, rows = distance_table(self.fps), np.arange(len(self.node))
        for r in rows:
            others = rows[r + 1 :]
            others = others[self.label[others] != self.label[r]]
            if self.side is not None:
                others = others[self.side[others] != self.side[r]]
            others = self.near(r, others, table) if len(others) else others
            while len(others):
                first, others = others[:block], others[block:]
                for k in first[self.similar(r, first)]:
                    if self.label[k] != self.label[r]:
                        yield self.root[self.label[r]], self.root[self.label[k]]
                        self.label[self.label == self.label[k]] = self.label[r]
                others = others[self.label[others] != self.label[r]]


def whole_groups(batches, names: tuple):
    """Tables of whole groups of equal `names`, from batches sorted by them, with the starts of the groups."""
    held: list = []

    def starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for c in names:
            x = table.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if batch.num_rows:
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            at = starts(table)
            if at[-1]:
                yield table.slice(0, int(at[-1])), at[:-1]
            held = [table.slice(int(at[-1]))]
    if held:
        yield held[0], starts(held[0])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def open_links(batches):
    """For mapInArrow over rows sorted by (v, i, j), those beside the largest component first."""
    for table, starts in whole_groups(batches, ("v", "i", "j")):
        found = []
        for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
            rows = table.slice(int(a), int(b - a))
            node, root, side = (rows.column(c).to_numpy() for c in ("node", "root", "side"))
            if len(node) > 1 and (root != root[0]).any():
                flat, offsets = _flat(rows.column("set"))
                fps, _ = _flat(rows.column("fp"))
                # In a task of one chunk all rows meet; of two, the rows of one side those of the other.
                one = rows.column("i")[0] == rows.column("j")[0]
                found += Bucket(node, root, None if one else side, flat, offsets, fps.reshape(-1, WIDE)).links()
        if found:
            pairs = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def left_apart(shared: DataFrame, sets: DataFrame, roots: DataFrame, chunk: int = CHUNK, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """Links between components in `roots` of which near nodes share a bucket."""
    marked = checkpoint(shared.select("v", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    of_root = marked.groupBy("v", "root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    of_bucket = of_root.groupBy("v").agg(F.count("*").alias("roots"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.max(F.struct("m", "s", "root")).alias("top")).where("roots > 1")

    def pieces(m: str, s: str):
        return F.greatest(F.ceil(F.expr(m) / chunk), F.ceil(F.expr(s) / chunk_shingles), F.lit(1)).cast("int")

    # The largest component's rows are in chunks of their own, numbered from `others` on, that don't meet each other.
    buckets = of_bucket.select("v", F.col("top.root").alias("largest"), pieces("m - top.m", "s - top.s").alias("others"), pieces("top.m", "top.s").alias("own"))
    opened = marked.join(buckets, "v")
    alone = F.col("root") == F.col("largest")
    few = (F.col("others") == 1) & (F.col("own") == 1)  # a small bucket is one chunk
    at = F.when(few, F.lit(0)).when(alone, F.col("others") + F.pmod(F.xxhash64("node"), F.col("own")).cast("int")).otherwise(F.pmod(F.xxhash64("node"), F.col("others")).cast("int"))
    meet = F.when(few, F.array(F.lit(0))).when(alone, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("own") - 1))
    placed = opened.select("v", "node", "root", alone.alias("alone"), at.alias("at"), F.explode(meet).alias("o"))
    tasks = placed.select("v", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), (F.col("at") > F.col("o")).alias("side"), "node", "root", "alone")
    dealt = tasks.join(sets, "node").repartition("v", "i", "j").sortWithinPartitions("v", "i", "j", "alone", "node")
    return dealt.select("v", "i", "j", "side", "node", "root", "set", "fp").mapInArrow(open_links, "a long, b long")


def near_components(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, h (hash of the text), node and root (the smallest node it reaches) of every document."""
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    signed = checkpoint(own.mapInArrow(_signed, "doc_id long, h long, node long, n long, bands array<long>"))
    nodes = signed.groupBy("node").agg(F.min(F.struct("h", "n", "bands")).alias("x"), F.count("*").alias("copies")).select("node", "copies", "x.h", "x.n", "x.bands")
    dealt = nodes.where("n > 0").select("node", "copies", "h", "n", F.explode("bands").alias("v"))
    # Partial aggregation and a join that adaptive execution splits: no task holds a hot bucket.
    member = F.struct(F.xxhash64("node").alias("o"), "node", "n")
    heads = dealt.groupBy("v").agg(F.count("*").alias("m"), F.max(F.struct("copies", F.xxhash64("node").alias("o"), "node", "n")).alias("top"), F.min(member).alias("low")).where("m > 1")
    heads = heads.select("v", F.array(F.struct("top.node", "top.n"), F.struct("low.node", "low.n")).alias("heads"))
    shared = checkpoint(dealt.join(heads, "v").select("v", "node", "h", "n", "heads"))
    few, _ = broadcast_below(shared.select("h").distinct(), MANY_CANDIDATES)
    sets = checkpoint(own.select("h", "text").join(few, "h", "left_semi").dropDuplicates(["h"]).mapInArrow(_sets, "node long, set array<long>, fp array<long>"))
    # Sizes alone settle that some pairs are below 0.8.
    alike = F.least("n", "o.n") * 5 >= F.greatest("n", "o.n") * 4
    met = shared.select("node", "n", F.explode("heads").alias("o")).where((F.col("node") != F.col("o.node")) & alike)
    tested = met.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()
    links = checkpoint(verified(tested, sets.select("node", "set")))
    first = checkpoint(components(links))
    # The smallest root of the components that belong together stands for all their nodes.
    second = components(left_apart(shared, sets, first, chunk)).select(F.col("node").alias("root"), F.col("root").alias("over"))
    alone = second.join(first.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("over").alias("root"))
    roots = first.join(second, "root", "left").select("node", F.coalesce("over", "root").alias("root")).unionByName(alone)
    return signed.select("doc_id", "h", "node").join(roots, "node", "left").select("doc_id", "h", "node", F.coalesce("root", "node").alias("root"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id (null ids last)."""
    return drop_rows(docs, near_components(docs).select("doc_id", "h", "root"))
