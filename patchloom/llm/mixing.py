"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (ordered by a seeded hash) into a stream of words that is cut
into blocks of equal size, smaller ones in a source that would have under LEAST_BLOCKS.  Slot k of the schedule takes the golden-ratio point frac(k * phi), maps
it through the cumulative weights to a source and ranks it among that source's slots; slot r of a
source takes its block r, starting over at the end (a second epoch).  Every prefix of the schedule
so holds each source close to its weight.

Targets: the budget is `share` of all words; weights repeat 5, 2, 1 by the sources' code-point order,
null last; no target exceeds `most` times its source's words, and the excess is shared again.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a source of its own, sorted
last; rows that repeat an id are mixed on their own; equal rows are interchangeable; an empty table
gives an empty result; columns of the input beside doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_below, buckets_for, checkpoint, running, small_batches, unused, word_counts

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Slots of the schedule, about; with it the words of a block follow the corpus, to BLOCK_WORDS at most.
SLOTS, BLOCK_WORDS = 1 << 18, 1 << 16
#: Blocks of a source, at least (or one a word): a slot more or less is a hundredth of an epoch.
LEAST_BLOCKS = 100
GOLDEN = 0.6180339887498949
#: Slots whose ranks are counted in one task.
SLOT_RUN = 1 << 12
#: Sources whose targets may be broadcast.
MANY_SOURCES = 100_000
#: Keys of repeated rows that may be broadcast.
MANY_REPEATED = 200_000


def source_targets(sized: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """src (never null, ordered like the source), source_size and target of each source.

    Sharing the excess again until no target is above its cap ends with min(cap, level * weight), the
    level being the one at which the targets add up to the budget.  Sources in order of cap / weight
    are capped up to some rank; the level follows from what they leave to the others.
    """
    sums = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("src")) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (rank % len(weights) + 1).cast("int"))
    capped = sums.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    levels = capped.select(
        "*",
        (F.sum("source_size").over(every) * share).alias("budget"),
        F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)).alias("spent"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))).alias("open"),
    ).withColumn("level", (F.col("budget") - F.col("spent")) / F.col("open"))
    # The first source, by ratio, that its share does not fill sets the level.
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "src", "level"))).over(every)
    return levels.withColumn("final", F.coalesce(first["level"], F.max("cap").over(every))).select("src", "source_size", F.least("cap", F.col("final") * F.col("w")).alias("target"))


def source_block(block: int) -> Column:
    """The words of a source's blocks: `block`, or less for a small source."""
    return F.least(F.lit(block), F.greatest(F.lit(1), F.ceil(F.col("source_size") / LEAST_BLOCKS))).cast("long")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, src, n, b): slot `slot` takes block b of its source, for the n-th time from 0.

    A source's chance is its target over its mean block, so that a short last block counts; slots
    beyond MOST full epochs are void.
    """
    spark = targets.sparkSession
    t = targets.where("target > 0 and source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / source_block(block)))
    t = t.withColumn("want", F.col("target") * F.col("blocks") / F.col("source_size"))
    edges = Window.orderBy("src")
    t = t.withColumn("high", F.sum("want").over(edges)).withColumn("low", F.coalesce(F.lag("high").over(edges), F.lit(0.0)))
    t = checkpoint(t.withColumn("total", F.sum("want").over(Window.partitionBy())))
    slots = int(round(t.agg(F.max("total")).first()[0] or 0))
    if not slots:
        return spark.createDataFrame([], "slot long, src string, n long, b long")
    point = F.col("slot") * GOLDEN - F.floor(F.col("slot") * GOLDEN)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("at", point * F.lit(float(t.first()["total"])))
    # Points meet the sources of their unit cell; the cells of all sources are about as many as slots.
    cells = t.select("src", "low", "high", "blocks", F.explode(F.sequence(F.floor("low"), F.floor("high"))).alias("cell"))
    named = points.withColumn("cell", F.floor("at")).join(cells, "cell").where("at >= low and at < high")
    ranked = _ranks(named)
    return ranked.where(F.col("r") < F.col("blocks") * MOST).select("slot", "src", F.floor(F.col("r") / F.col("blocks")).alias("n"), (F.col("r") % F.col("blocks")).alias("b"))


def _ranks(named: DataFrame) -> DataFrame:
    """The rank of each slot among its source's, from the counts of earlier runs and the rank in its run."""
    cut = named.withColumn("run", F.floor(F.col("slot") / SLOT_RUN))
    before = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("src", "run").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = cut.withColumn("local", F.row_number().over(Window.partitionBy("src", "run").orderBy("slot")) - 1)
    return local.join(bases, ["src", "run"]).withColumn("r", F.col("base") + F.col("local"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, src, size and a shuffle key of every document, checkpointed."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    schema = T.StructType([narrow.schema["doc_id"], narrow.schema["source"], narrow.schema["crc"], T.StructField("size", T.LongType())])
    sized = small_batches(narrow).mapInArrow(word_counts, schema)
    src = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    return checkpoint(sized.select("doc_id", "crc", "size", src.alias("src"), F.xxhash64("doc_id", F.lit("mix")).alias("key")))


def mix_sources(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, crc, size, src, source_size, target and taken of every document."""
    sized = sized_documents(docs)
    n, words = sized.agg(F.count("*"), F.sum("size")).first()
    targets = checkpoint(source_targets(sized, share, most, weights))
    block = max(1, min(BLOCK_WORDS, -(-int((words or 0) * share) // SLOTS)))
    times = schedule(targets, block).groupBy("src", "b").agg(F.count("*").alias("times"))
    # src goes with its key range, so equal keys of two sources stay apart.
    placed = running(sized, ["src"], "key", ["doc_id", "size", "crc"], buckets_for(n or 0), F.col("size"), "begin")
    few, _ = broadcast_below(targets, MANY_SOURCES)  # one row a source
    placed = placed.join(few.select("src", source_block(block).alias("block")), "src")
    each = F.col("block")
    pieces = placed.select("*", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("begin") / each), F.floor((F.col("begin") + F.col("size") - 1) / each))).otherwise(F.array(F.lit(-1).cast("long")))).alias("b"))
    overlap = F.least(F.col("begin") + F.col("size"), (F.col("b") + 1) * each) - F.greatest(F.col("begin"), F.col("b") * each)
    taken = pieces.join(times, ["src", "b"], "left").groupBy("src", "doc_id", "crc", "size", "begin").agg(F.sum(F.when(F.col("size") > 0, overlap * F.coalesce("times", F.lit(0))).otherwise(0)).alias("taken"), (F.count("*")).alias("pieces"))
    # Empty documents with equal keys begin at the same word: as many rows as went in.
    rows = taken.withColumn("copies", F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("pieces"))).select("src", "doc_id", "crc", "size", "taken", F.explode(F.expr("sequence(1L, copies)")).alias("_copy")).drop("_copy")
    return rows.join(few, "src").select("doc_id", "crc", "size", "src", F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"))


def mix_corpus(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix as whole documents with all their columns: a document taken twice is there twice.

    Where the edge of a block cuts a document, it is in if at least half of its words are taken.  Rows that
    repeat an id, a text and a source together stand for exactly the copies that the mix takes of them.
    """
    mixed = mix_sources(docs, share, most).withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int"))
    # Rows that repeat an id, a text and a source are one key: their copies add up.
    id_, crc, of, copies, rows, copy = unused(docs, "mix_id", "mix_crc", "mix_src", "mix_copies", "mix_rows", "mix_copy")
    per_key = mixed.groupBy("doc_id", "crc", "src").agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    per_key = per_key.select(F.col("doc_id").alias(id_), F.col("crc").alias(crc), F.col("src").alias(of), copies, rows)
    src = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.crc32(F.coalesce("text", F.lit(""))) == F.col(crc)) & (src == F.col(of))
    per_key = checkpoint(per_key)
    every = docs.join(per_key.withColumn(copies, F.expr(f"{copies} div {rows}")).where(F.col(copies) > 0), same)
    # Of `rows` equal rows each stands for copies / rows, rounded down; one of them makes up the rest.
    rest = per_key.withColumn(copies, F.col(copies) % F.col(rows)).where(F.col(copies) > 0)
    rest, _ = broadcast_below(rest, MANY_REPEATED)
    if not rest.isEmpty():
        every = every.unionByName(docs.join(rest, same).dropDuplicates([id_, crc, of]))
    return every.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
