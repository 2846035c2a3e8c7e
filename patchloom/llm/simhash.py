"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit where over half of the XXH64 hashes of the 3-word shingles have it.  Equal
fingerprints are one node.  Two fingerprints at 3 or fewer differing bits agree in at least two of
five bit blocks, so each is dealt to the ten buckets of its block pairs.  In a bucket every
fingerprint has a row of Hamming distances to reference fingerprints (the pivots); by the triangle
inequality a pair whose rows differ by more than 3 in any coordinate is discarded, and the others are
verified by their differing bits.  (A distance table alone can't deal work out: one coordinate of
random fingerprints tells only about six pairs of ten apart, so without blocks all pairs would meet.)

A bucket yields links from each member to the first of its group, never all pairs, and a bucket of
over BUCKET_ROWS is cut into chunks of which each two meet in one task.  Components follow from the
links by contraction in parts and alternating star passes, with reliable checkpoints.

The contract's 3 bits of 3-word shingles miss most near copies at a similarity of 0.8; the pipeline's
stage is neardup.near_dedup, which searches by similarity with the fingerprints and tables made here.

Edge cases: a null or empty text has fingerprint zero, linked like any other; repeated rows are one
node and keep their own result rows; null ids get the smallest non-null id of their component, or
null if there is none; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, checkpoint, drop_rows, left_join_hot, slices, small_batches, text_bytes

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Widths of the five blocks, high bits first.
BLOCKS = (13, 13, 13, 13, 12)
PIVOTS = 24
#: Fingerprints of a bucket that meet in one task, at most.
BUCKET_ROWS = 20_000
#: Edges that one task contracts, about.
PART_EDGES = 100_000
#: Edges up to which the smallest neighbours are broadcast; beyond it only those of hubs are.
HUB_EDGES = 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- fingerprints -----------------------------------------------------------------------------


def shingle_hashes(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the texts, and the number of shingles by text."""
    length = t.ends - t.starts
    # Words, lower-cased, each with one space behind it, in one buffer.
    to = np.concatenate(([0], np.cumsum(length + 1)))
    flat = np.full(int(to[-1]), 32, np.uint8)
    flat[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = _LOWER[t.data[t.in_word]]
    buffer = memoryview(flat.tobytes())
    n = np.where(t.n_words >= SHINGLE, t.n_words - SHINGLE + 1, np.minimum(t.n_words, 1))
    first = np.cumsum(t.n_words) - t.n_words
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    last = at + np.repeat(np.minimum(t.n_words, SHINGLE), n)
    digest = xxhash.xxh64_intdigest
    spans = zip(to[at].tolist(), (to[last] - 1).tolist(), strict=True)
    return np.fromiter((digest(buffer[a:b], SEED) for a, b in spans), np.uint64, len(at)), n


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of n[i] hashes: bits set in over half of them."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # Eight counters of a byte each add up in one word, so runs are cut at 255.
    pieces = -(-n[some] // 255)
    owner = np.repeat(np.arange(len(some)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(n[some]) - n[some])[owner] + 255 * within
    runs = np.cumsum(pieces) - pieces
    half = n[some]
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), runs, axis=0)
        for byte in range(8):
            out[some] |= (2 * counts[:, byte] > half).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    parts = [majority(*shingle_hashes(Texts(data, offsets[a : b + 1]))) for a, b in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _add_fingerprints(batches, text: str, name: str):
    for batch in batches:
        rest = [c for c in batch.schema.names if c not in (name, text)]
        fp = pa.array(fingerprints(*text_bytes(batch.column(text))).view(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), fp], names=[*rest, name])


# --- candidate buckets ------------------------------------------------------------------------


def _block_pairs() -> list[tuple[int, int, int]]:
    """For each two blocks: a mask of their bits."""
    low = [64 - sum(BLOCKS[: k + 1]) for k in range(len(BLOCKS))]
    bits = [((1 << w) - 1) << s for w, s in zip(BLOCKS, low, strict=True)]
    return [bits[a] | bits[b] for a, b in combinations(range(len(BLOCKS)), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints."""
    return np.random.default_rng(20).integers(0, 1 << 64, n, dtype=np.uint64)


def distance_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def near(one: int, table_one: np.ndarray, fps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of `fps` are within MAX_BITS of `one`: the pivot test, then the verification."""
    passed = np.arange(len(fps))
    for columns in (slice(0, 4), slice(4, None)):
        gap = np.abs(table[passed, columns] - table_one[columns]).max(axis=1)
        passed = passed[gap <= MAX_BITS]
    return passed[np.bitwise_count(fps[passed] ^ one) <= MAX_BITS]


def links_of(fps: np.ndarray, refs: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect each group of one bucket: a walk that drops what it has reached."""
    table, left, links = distance_table(fps, refs), np.arange(len(fps)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            hit = near(fps[x], table[x], fps[left], table[left])
            if len(hit):
                found = left[hit]
                links += [(int(fps[root]), int(fps[y])) for y in found]
                queue += found.tolist()
                left = np.delete(left, hit)
    return links


def bucket_links(batches, n_pivots: int = PIVOTS):
    """For mapInArrow over rows sorted by (k, m, i, j): links of all buckets, pairs at once in small ones."""
    refs = pivots(n_pivots)
    names, carry = ("k", "m", "i", "j"), None

    def solve(cols: dict, n: int):
        change = np.zeros(n, bool)
        change[0] = True
        for c in names:
            change[1:] |= cols[c][1:] != cols[c][:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, n))
        fp = cols["fp"].view(np.uint64)
        two = starts[sizes == 2]
        if len(two):
            a, b = distance_table(fp[two], refs), distance_table(fp[two + 1], refs)
            two = two[np.abs(a - b).max(axis=1) <= MAX_BITS]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS]
            yield fp[two], fp[two + 1]
        found = [x for s, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True) for x in links_of(fp[s : s + size], refs)]
        if found:
            pairs = np.array(found, np.uint64)
            yield pairs[:, 0], pairs[:, 1]

    def out(pairs):
        for a, b in pairs:
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*names, "fp")}
        if carry is not None:
            cols = {c: np.concatenate((carry[c], v)) for c, v in cols.items()}
        n = len(cols["fp"])
        if not n:
            continue
        same = np.ones(n, bool)
        for c in names:
            same &= cols[c] == cols[c][-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        carry = {c: v[cut:] for c, v in cols.items()}
        if cut:
            yield from out(solve({c: v[:cut] for c, v in cols.items()}, cut))
    if carry is not None and len(carry["fp"]):
        yield from out(solve(carry, len(carry["fp"])))


def candidate_links(nodes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, enough to connect every group."""
    masks = _block_pairs()
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("m")) for k, m in enumerate(masks)))
    dealt = nodes.select("fp", F.inline(keys))
    # Counted by partial aggregation and joined back, so a hot bucket never comes into one task whole:
    # the join streams it, and adaptive execution splits it.
    counted = dealt.join(dealt.groupBy("k", "m").agg(F.count("*").alias("n")).where("n > 1"), ["k", "m"])
    chunks = F.ceil(F.col("n") / bucket_rows).cast("int")
    # Chunk c of a large bucket meets every chunk: tasks (c, 0..c) as the later, (c.., c) as the earlier.
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    met = F.expr("transform(sequence(0, chunks - 1), o -> struct(least(own, o) as i, greatest(own, o) as j))")
    tasks = counted.withColumn("chunks", chunks).withColumn("own", own).select("fp", "k", "m", F.inline(met))
    return tasks.repartition("k", "m", "i", "j").sortWithinPartitions("k", "m", "i", "j", "fp").mapInArrow(bucket_links, "a long, b long")


# --- components -------------------------------------------------------------------------------


def forest(batches):
    """For mapInArrow over edges (u, v): the links of every node to the smallest one that this part's edges reach."""
    root: dict = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]  # halves the path; every node on it is known
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    out = [(x, find(x)) for x in root]
    stars = np.array([(x, r) for x, r in out if x != r], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], names=["u", "v"])


def components(links: DataFrame, max_rounds: int = 60, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, root) for every linked node: the smallest node it can reach.

    Parts of about `part_edges` edges are contracted to stars by a task each; one part is all it takes
    for so few edges.  Otherwise passes of star contraction join the parts' stars: a large-star step
    links each larger neighbour of a node to the smallest one around it; a small-star step does so for the
    smaller neighbours.  Each pass is checkpointed; it ends when nothing changes.
    """

    def with_lowest(edges: DataFrame, n: int, own: bool) -> DataFrame:
        """The edges with the smallest neighbour `low` of u (u itself too if `own`); a hub is no task's alone."""
        low = edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("count"))
        if own:
            low = low.withColumn("low", F.least("u", "low"))
        if n <= HUB_EDGES:  # so at most twice as many nodes
            return edges.join(F.broadcast(low.drop("count")), "u")
        low = checkpoint(low)
        return left_join_hot(edges, low.drop("count"), "u", n, low, F.xxhash64("v"))

    def contracted(edges: DataFrame, n: int) -> DataFrame:
        return checkpoint(edges.coalesce(max(1, -(-n // part_edges))).mapInArrow(forest, "u long, v long"))

    def state(edges: DataFrame):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = checkpoint(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"))
    n = edges.count()
    edges = contracted(edges, n)
    if n > part_edges:
        before = state(edges)
        for _ in range(max_rounds):
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = with_lowest(both, 2 * before[0], True).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
            near = with_lowest(large, 2 * before[0], False)
            small = near.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))))
            # A pass has at most twice the edges of the one before.
            edges = contracted(small.where("u <> v").distinct(), 2 * before[0])
            after = state(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def simhash_components(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint (long), root (smallest fingerprint reached) and component_id of every document."""
    fps = checkpoint(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _add_fingerprints(b, "text", "fp"), "doc_id long, fp long"))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("count")))
    roots = components(candidate_links(nodes.select("fp"), bucket_rows)).withColumnRenamed("node", "fp")
    linked = checkpoint(nodes.join(roots, "fp", "left").select("fp", "first_id", "count", F.coalesce("root", "fp").alias("root")))
    ids = checkpoint(linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("count"), F.sum("count").alias("rows")))
    n, total = ids.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    table = left_join_hot(linked.select("fp", "root"), ids.select("root", "component_id"), "root", n, ids, F.xxhash64("fp"))
    found = left_join_hot(fps, table, "fp", total, nodes, F.xxhash64("doc_id"))
    return found.select("doc_id", F.col("fp").alias("fingerprint"), "root", "component_id")


def fingerprint_dedup(docs: DataFrame) -> DataFrame:
    """One document of each component of fingerprints, with all its columns: the one with the smallest id (null ids last).

    Rows that repeat an id and a text are settled among themselves, so one row stays.  neardup.near_dedup
    is the wider search, by similarity.
    """
    narrow = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    found = checkpoint(narrow.mapInArrow(lambda b: _add_fingerprints(b, "text", "fp"), "doc_id long, h long, fp long"))
    roots = components(candidate_links(found.select("fp").distinct())).withColumnRenamed("node", "fp")
    return drop_rows(docs, found.join(roots, "fp", "left").select("doc_id", "h", F.coalesce("root", "fp").alias("root")))
