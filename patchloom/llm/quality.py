"""Quality rules by an isolation forest on rule statistics.

Every text gets the statistics of the usual heuristic rules (length, symbols, repeated lines and
words, capitals, punctuation).  An isolation forest is trees of random splits; a row labelled good
that few splits suffice to set apart is anomalous, and so is a document that ends where it does.
The splits are drawn at random, the rows that end at each leaf are counted over all rows labelled
good, and the score above which a document is rejected is calibrated on the scores of all labelled
rows, told apart in steps of 1 / GRID.  Nothing is fitted on a sample: executors count, and the
driver holds the leaves' counts and the histograms of scores, whose size the rows do not change.

Edge cases: a null or empty text has no words and fails the base rule; a null id is kept as null;
repeated rows each get their own (equal) result; an empty table gives an empty result; without
labelled rows only the base rule decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, broadcast_below, checkpoint, mix64, slices, small_batches, text_bytes

TREES, RULE_TREES, MAX_DEPTH = 100, 25, 10
LEAVES = 1 << MAX_DEPTH
#: Steps of the scores (0 to 1) that thresholds tell apart.
GRID = 1 << 14
#: Labelled ids that are broadcast to leave other texts out, where texts are read for the fit alone.
BROADCAST_ROWS = 200_000
#: Share of the good labelled rows that the threshold may reject.
GOOD_LOSS = 0.002
#: Share of the bad labelled rows that one more forest must catch to be used.
LEAST_GAIN = 0.02
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_upper", "n_punct", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(range(65, 91))] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?.,;:'\"()[]{}-_/\\~^@=+`")] = True


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The COUNTS of each text, one row a text."""
    t = Texts(data, offsets)
    out = np.zeros((t.n, len(COUNTS)), np.int64)
    out[:, 0] = t.n_words
    out[:, 1] = t.count(t.in_word & ((t.data & 0xC0) != 0x80))
    out[:, 2] = t.count(_SYMBOL[t.data])
    starts, ends, doc, words = t.lines()
    out[:, 7] = np.bincount(doc, minlength=t.n)
    some = words > 0
    key = mix64(t.hashes(starts[some], ends[some]) + mix64(doc[some].astype(np.uint64)))
    own = doc[some]
    _, first = np.unique(key, return_index=True)
    out[:, 3] = np.bincount(own, minlength=t.n) - np.bincount(own[first], minlength=t.n)
    if len(t.starts) >= 3:
        h, doc = t.hashes(t.starts, t.ends), t.word_doc
        key = mix64(mix64(h[:-2] + np.uint64(1)) + h[1:-1]) * np.uint64(3) + h[2:]
        key = mix64(key + mix64(doc[:-2].astype(np.uint64) + np.uint64(7)))
        at = np.flatnonzero(doc[:-2] == doc[2:])
        _, back, n = np.unique(key[at], return_inverse=True, return_counts=True)
        twice = at[n[back] > 1]
        seen = np.zeros(len(h), bool)
        for k in range(3):
            seen[twice + k] = True
        out[:, 4] = np.bincount(doc[seen], minlength=t.n)
    out[:, 5] = t.count(_UPPER[t.data])
    out[:, 6] = t.count(_PUNCT[t.data])
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Rates from the counts, so that a document's length alone says little."""
    c = counts.astype(np.float64)
    words, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1)
    return np.column_stack([np.log1p(c[:, 0]), c[:, 1] / words, c[:, 2] / words, c[:, 3] / np.maximum(c[:, 7], 1), c[:, 4] / words, c[:, 5] / chars, c[:, 6] / words])


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def _expected_path(n: np.ndarray | float):
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits, as arrays: feature, threshold and, where a path ends, its length.

    A split is drawn uniformly from its node's box, which starts as the box of all labelled rows, so
    it hangs on no row.  A path ends at the first node with at most one row labelled good, or at
    MAX_DEPTH; so a region without good rows ends a path early.  Without `rows` the lengths are left
    open until `count` gets the good rows of every leaf.
    """

    def __init__(self, rows: np.ndarray | None, low: np.ndarray, high: np.ndarray, columns: list[int], trees: int, seed: int = 7):
        rng = np.random.default_rng([seed, *columns])
        n = 2 * LEAVES - 1
        self.feature = np.full((trees, n), columns[0], np.int16)
        self.split = np.full((trees, n), np.inf)  # without a split all rows go left
        self.path = np.zeros((trees, n))
        self.norm = 1e-9
        chosen, tree = np.array(columns), np.arange(trees)[:, None]
        below = np.tile(low[chosen].astype(np.float64), (trees, 1, 1))
        above = np.tile(high[chosen].astype(np.float64), (trees, 1, 1))
        for depth in range(MAX_DEPTH):
            width, first = 1 << depth, (1 << depth) - 1
            able = above > below
            draw, at = rng.random((2, trees, width))
            nth = np.floor(draw * able.sum(2)).astype(np.int64) + 1
            f = np.argmax(np.cumsum(able, 2) >= nth[..., None], 2)
            place = np.arange(width)[None, :]
            a, b = below[tree, place, f], above[tree, place, f]
            at = a + at * (b - a)
            some = able.any(2)
            self.feature[:, first : first + width] = chosen[f]
            self.split[:, first : first + width] = np.where(some, at, np.inf)
            above_left, below_right = above.copy(), below.copy()
            above_left[tree, place, f] = np.where(some, at, b)
            below_right[tree, place, f] = np.where(some, at, a)
            below = np.stack((below, below_right), 2).reshape(trees, 2 * width, -1)
            above = np.stack((above_left, above), 2).reshape(trees, 2 * width, -1)
        if rows is not None:
            self.count(self.tally(rows))

    def leaves(self, x: np.ndarray):
        """The leaf (0 .. LEAVES - 1) of every row, tree by tree."""
        row = np.arange(len(x))
        for k in range(len(self.split)):
            node = np.zeros(len(x), np.int64)
            for _ in range(MAX_DEPTH):
                node = 2 * node + 1 + (x[row, self.feature[k, node]] > self.split[k, node])
            yield node - (LEAVES - 1)

    def tally(self, x: np.ndarray) -> np.ndarray:
        """How many rows end at each leaf, one line a tree."""
        return np.stack([np.bincount(leaf, minlength=LEAVES) for leaf in self.leaves(x)])

    def count(self, rows: np.ndarray) -> None:
        """The lengths of the paths, from the good rows of every leaf."""
        trees = len(self.split)
        ended = np.zeros((trees, LEAVES), bool)
        length = np.zeros((trees, LEAVES))
        for depth in range(MAX_DEPTH + 1):
            span, first = LEAVES >> depth, (1 << depth) - 1
            n = rows.reshape(trees, 1 << depth, span).sum(2)
            last = (n <= 1) | np.isinf(self.split[:, first : first + n.shape[1]])
            ends = np.repeat(last, span, 1) & ~ended
            length[ends] = np.repeat(depth + _expected_path(n), span, 1)[ends]
            ended |= ends
        self.path[:, LEAVES - 1 :] = length
        self.norm = max(float(_expected_path(rows[0].sum())), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that are set apart early."""
        total = np.zeros(len(x))
        for k, leaf in enumerate(self.leaves(x)):
            total += self.path[k, leaf + LEAVES - 1]
        return 2.0 ** (-total / len(self.split) / self.norm)


class RuleForests:
    """A forest for each rule statistic alone and one for all together, each with its threshold.

    A far outlier in one statistic is set apart at once in that statistic's forest, while most
    splits of the joint forest miss it.  A document is rejected if any score is above its threshold.
    """

    def __init__(self, forests: list[IsolationForest], thresholds: list[float]):
        self.forests, self.thresholds = forests, thresholds

    def excess(self, x: np.ndarray) -> np.ndarray:
        """The largest of score / threshold; above 1 the document is rejected."""
        return np.max([np.zeros(len(x)), *(f.score(x) / t for f, t in zip(self.forests, self.thresholds, strict=True))], axis=0)


def step(scores: np.ndarray) -> np.ndarray:
    """The step of each score: above (step - 1) / GRID, at most step / GRID."""
    return np.ceil(scores * GRID).astype(np.int32)


def calibrate(steps: np.ndarray, good: np.ndarray, bad: np.ndarray, n_bad: int, good_loss: float) -> tuple[int, float, float]:
    """The last step to keep, the threshold and its gain: the share of bad rows above, less ten times that of good ones.

    `good` and `bad` count the rows of each of the ascending steps.  At most `good_loss` of the good
    rows are above the threshold; it stands halfway to the next step above that has rows.
    """
    n_good = int(good.sum())
    last, at, gain = GRID, 1.0, 0.0
    if not n_good or not bad.sum():
        return last, at, gain
    good_to, bad_to = np.cumsum(good), np.cumsum(bad)
    least = int(np.searchsorted(good_to, min(n_good - 1, int(np.ceil(n_good * (1 - good_loss)))), "right"))
    for k in range(least, len(steps) - 1):
        caught, lost = (bad_to[-1] - bad_to[k]) / n_bad, (n_good - good_to[k]) / n_good
        if caught - 10 * lost > gain:
            last, at, gain = int(steps[k]), float(steps[k] + steps[k + 1] - 1) / 2 / GRID, caught - 10 * lost
    return last, at, gain


def verdicts(counts: np.ndarray, model: RuleForests | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, anomaly and kept of each line of counts."""
    failed = base_failed(counts)
    excess = model.excess(features(counts)) if model is not None and len(counts) else np.zeros(len(counts))
    return failed, excess, ~failed & ~(excess > 1)


def _counts(texts: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(texts)
    parts = [rule_counts(data, offsets[a : b + 1]) for a, b in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)


def _counted(batches):
    for batch in batches:
        counts = _counts(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])


def _kept(batches, model: RuleForests | None):
    for batch in batches:
        yield batch.filter(pa.array(verdicts(_counts(batch.column("text")), model)[2]))


_LONGS = ", ".join(f"{c} long" for c in ("doc_id", *COUNTS))


def _count(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every document, kept in the shared folder."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return checkpoint(rows.mapInArrow(_counted, _LONGS))


def _numbers(batch, names) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])


def _box(batches):
    """The least and largest of every feature, one row a batch."""
    for batch in batches:
        if batch.num_rows:
            x = features(_numbers(batch, COUNTS))
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*x.min(0), *x.max(0))], names=[f"f{k}" for k in range(2 * x.shape[1])])


def _tally(batches, forests: list[IsolationForest]):
    """(leaf, n): how many rows end at each leaf of all trees, counted through."""
    total = np.zeros(sum(len(f.split) for f in forests) * LEAVES, np.int64)
    for batch in batches:
        if batch.num_rows:
            x = features(_numbers(batch, COUNTS))
            total += np.concatenate([f.tally(x).ravel() for f in forests])
    leaf = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(total[leaf])], names=["leaf", "n"])


def _steps(batches, forests: list[IsolationForest]):
    for batch in batches:
        x = features(_numbers(batch, COUNTS)) if batch.num_rows else np.zeros((0, 1))
        steps = [pa.array(step(f.score(x)) if len(x) else np.zeros(0, np.int32), pa.int32()) for f in forests]
        yield pa.RecordBatch.from_arrays([batch.column("_good"), *steps], names=["_good", *(f"s{k}" for k in range(len(forests)))])


def _histogram(scored: DataFrame, forests: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Steps and their good and bad rows, for some of the forests; at most GRID rows of each reach the driver."""
    each = scored.select("_good", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("step")) for k in forests))).alias("s"))
    rows = each.groupBy("s.k", "s.step").agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")).orderBy("k", "step").toPandas()
    return {k: tuple(rows.loc[rows["k"] == k, c].to_numpy() for c in ("step", "good", "bad")) for k in forests}


def fit(counted: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS) -> RuleForests | None:
    """The forests and their thresholds, from all labelled rows of doc_id and COUNTS that pass the base rule.

    A label that is null is left out; an id labelled twice counts as bad if either label is 0.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("_good"))
    # Of documents that repeat an id, the one with the smallest counts.
    rows = counted.groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("c")).join(marks, "doc_id").select("_good", "c.*")
    rows = checkpoint(rows.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words"))
    n = int(rows.where("_good").count())
    if not n:
        return None
    width = features(np.ones((1, len(COUNTS)))).shape[1]
    names = [f"f{k}" for k in range(2 * width)]
    bounds = [(F.min if k < width else F.max)(c).alias(c) for k, c in enumerate(names)]
    box = np.array(rows.mapInArrow(_box, ", ".join(f"{c} double" for c in names)).agg(*bounds).first())
    groups = [[f] for f in range(width)] + [list(range(width))]
    forests = [IsolationForest(None, box[:width], box[width:], g, TREES if len(g) > 1 else RULE_TREES) for g in groups]
    tally = rows.where("_good").mapInArrow(lambda b: _tally(b, forests), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(sum(len(f.split) for f in forests) * LEAVES, np.int64)
    total[tally["leaf"].to_numpy()] = tally["n"].to_numpy()
    for f, own in zip(forests, np.split(total.reshape(-1, LEAVES), np.cumsum([len(f.split) for f in forests])[:-1]), strict=True):
        f.count(own)
    scored = checkpoint(rows.mapInArrow(lambda b: _steps(b, forests), "_good boolean, " + ", ".join(f"s{k} int" for k in range(len(forests)))))
    found = _histogram(scored, list(range(len(forests))))
    n_bad = left_bad = int(found[0][2].sum())
    if not n_bad:
        return RuleForests([], [])
    # The forest that tells most goes first; a later one only has to catch what is left.
    by_gain = sorted(found, key=lambda k: -calibrate(*found[k], n_bad, good_loss)[2])
    used, thresholds = [], []
    for k in by_gain:
        if left_bad <= LEAST_GAIN * n_bad:
            break
        steps, good, bad = _histogram(scored, [k])[k] if used else found[k]
        last, at, gain = calibrate(steps, good, bad, n_bad, good_loss)
        if gain > LEAST_GAIN:
            used.append(forests[k])
            thresholds.append(at)
            scored, left_bad = scored.where(F.col(f"s{k}") <= last), int(bad[steps <= last].sum())
    return RuleForests(used, thresholds)


def _judge(batches, model: RuleForests | None):
    """The rows of _count with base_failed, anomaly and kept."""
    for batch in batches:
        counts = _numbers(batch, COUNTS) if batch.num_rows else np.zeros((0, len(COUNTS)), np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, verdicts(counts, model))], names=[*batch.schema.names, "base_failed", "anomaly", "kept"])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly (above 1: rejected) and kept of every document."""
    counted = _count(docs)
    model = fit(counted, labels)
    return counted.mapInArrow(lambda b: _judge(b, model), f"{_LONGS}, base_failed boolean, anomaly double, kept boolean")


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    ids, few = broadcast_below(labels.where("doc_id is not null and quality is not null").select("doc_id").distinct(), BROADCAST_ROWS)
    model = fit(_count(docs.join(ids, "doc_id", "left_semi") if few else docs), labels)
    return small_batches(docs).mapInArrow(lambda b: _kept(b, model), docs.schema)
