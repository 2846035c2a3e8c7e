"""Line deduplication by winnowing over line hashes.

A run is a sequence of lines; lines without a word have no place in it.  A line goes if it lies in a run
of RUN_WORDS words or more that also stands at an earlier place (smaller document, then position), and
no other line goes.  So the first copy of everything stays, and more documents never save a line.

A gram is the shortest run of lines from some line on that holds MATCH_WORDS words.  A window is the
shortest run from a line on, or up to a line, that holds RUN_WORDS words; windows cover every run of
so many words whole.  The smallest gram hash in a window is its fingerprint, which all copies of the
window share.  Fingerprints that occur twice are joined back to their places; around such a place the match
is extended both ways, window by window: every window that has the fingerprint is joined by its own hash
to its first place, and the lines of all other places are deleted.  (A fingerprint's first place won't do:
it may hold less of the run than a later one.)  Only hashes and positions move, so a first copy that
many documents repeat is a hot key with one row on the other side (broadcast, if it is that hot) and not a
document that meets them all.

Edge cases: lines are compared without blanks at their ends; lines without a word are kept, but those
inside a deleted run go with it; null texts have no lines; null ids sort first; rows that repeat an
id and a text count as one document and get the same result; an empty table gives an empty result;
columns beside doc_id and text are ignored, and kept by dedup_lines
(but one named `removed`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, Texts, checkpoint, left_join_hot, slices, small_batches, text_bytes, unused

RUN_WORDS, MATCH_WORDS = 50, 40


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))


def _lines(batches):
    """The lines with words of each text: hash of the trimmed line, words, and place among all lines."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        hashes, words, places, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in slices(offsets):
            t = Texts(data, offsets[a : b + 1])
            starts, _, doc, n = t.lines()
            some = np.flatnonzero(n)
            first = np.searchsorted(t.starts, starts[some])
            hashes.append(t.hashes(t.starts[first], t.ends[first + n[some] - 1]).view(np.int64))
            words.append(n[some].astype(np.int32))
            every = np.bincount(doc, minlength=t.n)
            places.append((some - (np.cumsum(every) - every)[doc[some]]).astype(np.int32))
            sizes.append(np.bincount(doc[some], minlength=t.n))
        n = np.concatenate(sizes)
        columns = [batch.column("doc_id"), batch.column("h"), *(_lists(np.concatenate(x), n) for x in (hashes, words, places))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "lines", "words", "at"])


def _smallest(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The place of the (first) smallest value of each range [start, end), by a table of power-of-two ranges."""
    level = [np.arange(len(values))]
    width = int((ends - starts).max(initial=1))
    while 2 << (len(level) - 1) <= width:
        half = 1 << (len(level) - 1)
        left = level[-1]
        right = left[np.minimum(np.arange(len(left)) + half, len(left) - 1)]
        level.append(np.where(values[right] < values[left], right, left))
    power = np.frexp((ends - starts).astype(np.float64))[1] - 1  # the largest power of two in the range
    table = np.stack(level)
    left, right = table[power, starts], table[power, ends - (1 << power)]
    return np.where(values[right] < values[left], right, left)


class Windows:
    """Of all texts of a batch: windows [start, end) of lines, the gram that each selects, and hashes of both."""

    def __init__(self, lines: np.ndarray, words: np.ndarray, offsets: np.ndarray, run_words: int, match_words: int):
        total = np.concatenate(([0], np.cumsum(words)))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        line = np.arange(len(lines))
        spans = Spans(lines.view(np.uint64))
        gram_end = np.searchsorted(total, total[:-1] + match_words)  # over a text's end, or past all, where none fits
        fits = gram_end <= offsets[1:][doc]
        self.gram = np.full(len(lines), np.iinfo(np.uint64).max, np.uint64)
        self.gram[fits] = spans.hashes(line[fits], gram_end[fits])
        ahead = np.searchsorted(total, total[:-1] + run_words)
        behind = np.searchsorted(total, total[1:] - run_words, "right") - 1
        forth, back = ahead <= offsets[1:][doc], behind >= offsets[:-1][doc]
        pairs = np.concatenate((np.column_stack((line[forth], ahead[forth])), np.column_stack((behind[back], line[back] + 1))))
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs.reshape(0, 2)
        self.start, self.end = pairs[:, 0], pairs[:, 1]
        self.doc, self.spans = doc[self.start] if len(pairs) else pairs[:, 0], spans
        self.selected = _smallest(self.gram, self.start, np.searchsorted(gram_end, self.end, "right")) if len(pairs) else self.start

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return self.spans.hashes(self.start[which], self.end[which])


def _windows_of(batch, run_words: int, match_words: int) -> Windows:
    lists = batch.column("lines")
    offsets = lists.offsets.to_numpy()
    lines, words = (batch.column(c).values.to_numpy()[offsets[0] : offsets[-1]] for c in ("lines", "words"))
    return Windows(lines, words.astype(np.int64), offsets - offsets[0], run_words, match_words)


def _fingerprints(run_words: int, match_words: int):
    """For mapInArrow: (key, doc_id, h, pos) of the selected grams."""

    def run(batches):
        for batch in batches:
            w = _windows_of(batch, run_words, match_words)
            at, first = np.unique(w.selected, return_index=True)
            doc = w.doc[first]
            index, start = pa.array(doc), batch.column("lines").offsets.to_numpy()
            pos = (at - (start - start[0])[doc]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(w.gram[at].view(np.int64)), batch.column("doc_id").take(index), batch.column("h").take(index), pa.array(pos)], names=["key", "doc_id", "h", "pos"])

    return run


def _repeated_windows(run_words: int, match_words: int):
    """For mapInArrow: (key, doc_id, h, first, last) of the windows whose fingerprint is among `pos`."""

    def run(batches):
        for batch in batches:
            w = _windows_of(batch, run_words, match_words)
            offsets = batch.column("lines").offsets.to_numpy()
            base, at = offsets - offsets[0], batch.column("at").values.to_numpy()[offsets[0] : offsets[-1]]
            wanted = np.zeros(len(w.gram), bool)
            own = batch.column("pos")
            cuts = own.offsets.to_numpy()
            wanted[own.values.to_numpy()[cuts[0] : cuts[-1]] + np.repeat(base[:-1], np.diff(cuts))] = True
            which = np.flatnonzero(wanted[w.selected]) if len(w.start) else np.zeros(0, np.int64)
            index = pa.array(w.doc[which])
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.hashes(which).view(np.int64)), batch.column("doc_id").take(index), batch.column("h").take(index), pa.array(at[w.start[which]]), pa.array(at[w.end[which] - 1])],
                names=["key", "doc_id", "h", "first", "last"],
            )

    return run


def _covered(batches):
    """For mapInArrow: the places that ranges first..last cover, of each row."""
    for batch in batches:
        first, last = batch.column("first"), batch.column("last")
        removed = []
        for a, b in zip(first, last, strict=True):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            edges = np.bincount(a, minlength=int(b.max()) + 2) - np.bincount(b + 1, minlength=int(b.max()) + 2)
            removed.append(np.flatnonzero(np.cumsum(edges) > 0).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(removed, pa.list_(pa.int32()))], names=["doc_id", "h", "removed"])


def repeated_lines(docs: DataFrame, run_words: int = RUN_WORDS, match_words: int = MATCH_WORDS) -> DataFrame:
    """doc_id, h (hash of the text) and the sorted positions `removed` of every document with repeated runs."""
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    lines = own.mapInArrow(_lines, "doc_id long, h long, lines array<long>, words array<int>, at array<int>")
    lines = checkpoint(lines.dropDuplicates(["doc_id", "h"]))
    prints = checkpoint(lines.mapInArrow(_fingerprints(run_words, match_words), "key long, doc_id long, h long, pos int"))
    twice = checkpoint(prints.groupBy("key").count().where("count > 1"))
    again = left_join_hot(prints, twice.select("key", F.lit(True).alias("again")), "key", prints.count(), twice, F.xxhash64("doc_id", "h", "pos")).where("again")
    met = again.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("pos")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "pos")
    both = lines.join(met, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "h", "lines", "words", "at", "pos")
    windows = checkpoint(both.mapInArrow(_repeated_windows(run_words, match_words), "key long, doc_id long, h long, first int, last int"))
    place = F.struct("doc_id", "h", "first")
    firsts = checkpoint(windows.groupBy("key").agg(F.min(place).alias("p"), F.count("*").alias("count")).where("count > 1"))
    placed = left_join_hot(windows, firsts.select("key", "p"), "key", windows.count(), firsts, F.xxhash64("doc_id", "h", "first"))
    later = placed.where(F.col("p").isNotNull() & ~place.eqNullSafe(F.col("p")))
    ranges = later.groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last")).alias("r"))
    return ranges.select("doc_id", "h", F.col("r.first").alias("first"), F.col("r.last").alias("last")).mapInArrow(_covered, "doc_id long, h long, removed array<int>")


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS, match_words: int = MATCH_WORDS) -> DataFrame:
    """The documents with their columns, `text` without the repeated runs, and `removed` (positions, or null)."""
    id_, h, gone = unused(docs, "line_id", "line_h", "line_removed")
    found = repeated_lines(docs, run_words, match_words).select(F.col("doc_id").alias(id_), F.col("h").alias(h), F.col("removed").alias(gone))
    joined = docs.join(found, (F.xxhash64("text") == F.col(h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left")
    pieces = F.split("text", "\n", -1)
    # Removed positions ascend: walk the gaps between them.
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(pieces)))
    gaps = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.slice(pieces, a + 2, b - a - 1))
    cleaned = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n"))
    rest = [c for c in docs.columns if c not in ("text", "removed")]
    return joined.select(*(F.col(f"`{c}`") for c in rest), cleaned.alias("text"), F.col(gone).alias("removed"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (positions from 0, comma-joined), kept_crc32 and kept_chars of every document."""
    done = dedup_lines(docs.select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n_all")))
    n_removed = F.coalesce(F.size("removed"), F.lit(0))
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n_all")).cast("long").alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(n_removed).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("kept_crc32"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("kept_chars"),
    )
