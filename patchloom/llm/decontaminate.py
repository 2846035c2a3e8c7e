"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

Texts are lower-cased words of letters and digits.  A fixed mask looks at some of the tokens from a
position on and ignores the others; its hash is a seed.  Seeds of the benchmark and of the documents
are joined; each hit names a diagonal (document position less item position), and around it the two
texts are compared token by token.  A document leaks an item if, on some diagonal, WINDOW consecutive
tokens of the item (all of a shorter one) agree with it in IDENTITY of the places or more.

With up to one substitution in five, every window of 8 to 20 tokens holds a seed of one of the masks, and
every window of ALONE tokens or more one of the first mask (checked in the tests), so a leak with
substitutions only is not missed, and the second mask is looked at only if there are items so short.

An item of fewer than LEAST tokens must agree in all of them, its seed being all its tokens; one of
fewer than LEAST_INSIDE tokens, which any text may hold, leaks only as a whole document.

Edge cases: null or empty texts leak nothing, and an item without a token is leaked by none;
null ids are ids like any other; items that repeat an id are reported as one; empty tables give an empty
result; columns beside the id and the text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, checkpoint, unused

#: Offsets of the tokens that a seed looks at; from ALONE tokens on the first mask alone will do.
MASKS, ALONE = ((0, 1, 2, 4), (0, 2, 5, 6)), 11
WINDOW, IDENTITY = 20, 0.8
#: Items shorter than this are matched whole; those shorter than LEAST_INSIDE only by whole documents.
LEAST, LEAST_INSIDE = 8, 4
#: Rows of benchmark seeds, items or hits that may be broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 200_000
#: Bits of the membership filter that thins out seeds before the join, for each benchmark seed, and 64-bit words of it at most.
FILTER_BITS, FILTER_WORDS = 16, 1 << 15


def tokens_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _short_mask(length: int) -> tuple:
    return tuple(range(length))


def _seed(mask: tuple) -> Column:
    """The seed of a mask at `pos`; null where it does not fit, and that of a very short item but for a document of its length."""
    size, pos = F.size("tokens"), F.col("pos")
    fits = (size == len(mask)) & (pos == 0) if len(mask) < LEAST_INSIDE else pos + mask[-1] < size
    return F.when(fits, F.xxhash64(*(F.get("tokens", pos + o) for o in mask)))


def seeds(rows: DataFrame, carried: list[str], masks: dict[int, tuple], bitmap: list[int] | None = None) -> DataFrame:
    """A row for each mask (by number) and position of `tokens`: the carried columns, m, pos and seed.

    With a bitmap only seeds in it.  Positions are rows of generated code, not steps of a lambda, and the
    tokens stay where they are until the seeds are taken.
    """
    placed = rows.select(*carried, "tokens", F.posexplode("tokens").alias("pos", "token"))
    every = F.array(*(F.struct(F.lit(m).alias("m"), _seed(mask).alias("seed")) for m, mask in masks.items()))
    if bitmap is None:
        return placed.select(*carried, "pos", F.inline(every)).where("seed is not null")
    words = F.lit(bitmap).cast("array<bigint>")
    some = reduce(Column.__or__, (F.coalesce(_member(words, len(bitmap), _seed(mask)), F.lit(False)) for mask in masks.values()))
    found = placed.where(some).select(*carried, "pos", F.inline(every)).where("seed is not null")
    return found.where(_member(words, len(bitmap), F.col("seed"))) if len(masks) > 1 else found


def _member(words: Column, n: int, seed: Column) -> Column:
    """Whether the bit of a seed is set; n is a power of two."""
    place = seed.bitwiseAND(F.lit(n * 64 - 1)).cast("int")
    return F.getbit(F.get(words, F.shiftright(place, 6)), place.bitwiseAND(F.lit(63))) == 1


def seed_filter(bench: DataFrame) -> list[int]:
    """A bitmap over the benchmark's seeds, about FILTER_BITS bits for each, as at most FILTER_WORDS words."""
    n = 1 << max(4, (bench.count() * FILTER_BITS // 64).bit_length())
    n = min(n, FILTER_WORDS)
    place = F.col("seed").bitwiseAND(F.lit(n * 64 - 1)).cast("int")
    bits = bench.select(place.alias("p")).selectExpr("p div 64 as w", "shiftleft(1L, p & 63) as b")
    found = {r["w"]: r["word"] for r in bits.groupBy("w").agg(F.bit_or("b").alias("word")).collect()}  # at most n rows
    return [found.get(k, 0) for k in range(n)]


def item_seeds(items: DataFrame, masks: tuple = MASKS) -> tuple[DataFrame, dict[int, tuple]]:
    """(item_id, m, item_pos, seed) of all items, and the masks by number that these seeds have."""
    size = F.size("tokens")
    lengths = [r[0] for r in items.where(size < ALONE).select(size.alias("n")).distinct().collect()]  # fewer than ALONE numbers
    parts, used = [], {}
    for k, mask in enumerate(masks):
        if k == 0 or any(n >= LEAST for n in lengths):
            parts.append(seeds(items.where(size >= (LEAST)), ["item_id"], {k: mask}))
            used[k] = mask
    for n in sorted(n for n in lengths if n < LEAST):
        used[len(masks) + n] = _short_mask(n)
        parts.append(seeds(items.where(size == n), ["item_id"], {len(masks) + n: _short_mask(n)}))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return checkpoint(every.withColumnRenamed("pos", "item_pos")), used


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple = MASKS, window: int = WINDOW, identity: float = IDENTITY) -> DataFrame:
    """doc_id, h (hash of the text), item_id, doc_start, item_start, matched, compared of every leaked item, best place first."""
    items = benchmark.select(F.col("item_id").alias("item_id"), tokens_of(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    items = checkpoint(items)
    given, used = item_seeds(items, masks)
    own = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").alias("text"))
    tokens = own.select("doc_id", "h", tokens_of(F.col("text")).alias("tokens"))
    found = seeds(tokens, ["doc_id", "h"], used, seed_filter(given))
    lookup, _ = broadcast_below(given, BROADCAST_ROWS)
    hits = found.join(lookup, ["m", "seed"]).select("doc_id", "h", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
    hits = hits.distinct()
    by_doc = hits.groupBy("doc_id", "h").agg(F.collect_list(F.struct("item_id", "diagonal")).alias("found"))
    small, _ = broadcast_below(checkpoint(by_doc.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "found")), BROADCAST_ROWS)
    again = own.join(small, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    again = again.select("doc_id", "h", tokens_of(F.col("text")).alias("tokens"), "found")
    pairs = again.select("doc_id", "h", "tokens", F.inline("found"))
    item_lookup, _ = broadcast_below(items.select(F.col("item_id").alias("_item"), F.col("tokens").alias("item")), BROADCAST_ROWS)
    placed = pairs.join(item_lookup, F.col("item_id").eqNullSafe(F.col("_item")))
    return _verify(placed, window, identity)


def _verify(placed: DataFrame, window: int, identity: float) -> DataFrame:
    first = F.greatest(F.lit(0), -F.col("diagonal"))
    last = F.least(F.size("item"), F.size("tokens") - F.col("diagonal")) - 1
    cut = placed.withColumn("first", first).withColumn("n", last - first + 1).withColumn("w", F.least(F.lit(window), F.size("item"))).where("n >= w")
    aligned = F.zip_with(F.slice("item", F.col("first") + 1, F.col("n")), F.slice("tokens", F.col("first") + F.col("diagonal") + 1, F.col("n")), lambda a, b: (a == b).cast("int"))
    same = cut.select("doc_id", "h", "item_id", "diagonal", "first", "n", "w", aligned.alias("same"))
    counts = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("w")), lambda s: F.struct(F.aggregate(F.slice("same", s + 1, F.col("w")), F.lit(0), lambda a, b: a + b).alias("matched"), (-s).alias("at")))
    best = same.withColumn("best", F.array_max(counts)).where(F.col("best.matched") >= F.when(F.col("w") < LEAST, F.col("w")).otherwise(F.ceil(F.col("w") * identity)))
    top = best.groupBy("doc_id", "h", "item_id").agg(F.max(F.struct(F.col("best.matched").alias("matched"), F.col("w").alias("compared"), (F.col("first") - F.col("best.at")).alias("item_start"), F.col("diagonal").alias("diagonal"))).alias("t"))
    return top.select("doc_id", "h", "item_id", (F.col("t.item_start") + F.col("t.diagonal")).alias("doc_start"), "t.item_start", "t.matched", "t.compared")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    id_, h = unused(docs, "leak_id", "leak_h")
    bad = checkpoint(leaks(docs, benchmark).select(F.col("doc_id").alias(id_), F.col("h").alias(h)).distinct())
    bad, _ = broadcast_below(bad, BROADCAST_ROWS)
    return docs.join(bad, (F.xxhash64("text") == F.col(h)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left_anti")
