"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of the words of a lexicon (insults learned from the labelled sample, and
a fixed list), how near they stand to a second-person word, shares of capitals, of exclamation and
other punctuation, of words in capitals, and of obfuscated words (letters with digits or signs inside).
Trees are boosted on one part of the learning rows; on the other part an isotonic map turns their
margins into probabilities.

All is learned from at most SAMPLE_ROWS labelled ids outside the held-out fold, in hash order; of
documents that repeat such an id the one with the smallest features teaches the trees.

Edge cases: a null or empty text has all features 0 and still a score; repeated rows get equal results;
an id that is labelled twice counts as toxic if either label is 1; without labels of both kinds every
score is the share of toxic ones (0 if none); null ids are held out; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, cached, checkpoint, code_points, fold, slices, small_batches, text_bytes, word_spans

SAMPLE_ROWS = 24_000
#: Learned words at most; a word is learned if so many toxic texts hold it and its odds are so high.
LEXICON_SIZE, LEAST_TEXTS, LEAST_LOG_ODDS = 400, 3, 2.0
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 64
#: Rows of a leaf at least: this share of the rows, up to so many.
LEAF_SHARE, LEAST_LEAF = 0.02, 20
THRESHOLD = 0.7

#: Plain insults that hold without any labels.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "pathetic", "worthless", "scum", "trash", "clown", "fool", "jerk", "hate", "ugly", "disgusting")
SECOND_PERSON = ("you", "your", "yours", "yourself", "ya", "u", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "usted", "ustedes", "tú", "tus")
#: Signs that stand for letters in obfuscated words.
LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Signs that may stand inside an obfuscated word, beside digits.
SIGNS = "@$*#!|"
NEAR = 5


class Characters:
    """What the characters of the basic plane are, by code point; what lies beyond counts as none of it."""

    def __init__(self):
        every = [chr(c) for c in range(0x10000)]
        self.lower = np.array([ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in every], np.uint32)
        self.letter, self.alnum, self.small, self.capital = (np.array([f(x) for x in every]) for f in (str.isalpha, str.isalnum, str.islower, str.isupper))
        self.sign = np.array([x.isdecimal() for x in every])
        self.sign[[ord(x) for x in SIGNS]] = True
        self.plain = self.lower.copy()
        self.plain[[ord(x) for x in LETTERS]] = [ord(x) for x in LETTERS.values()]
        self.blank = np.zeros(0x10000, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True


def word_hash(words: list[str]) -> np.ndarray:
    """The hashes by which words are looked up."""
    points, offsets = code_points(*text_bytes(_strings(words)))
    return Spans(points).hashes(offsets[:-1], offsets[1:])


def _strings(words: list) -> pa.Array:
    return pa.array(words, pa.large_string())


class Lexicon:
    """Weights of words and the fixed lists, for lookups by hash; a fixed insult weighs 1 at least if not learned."""

    def __init__(self, learned: dict[str, float]):
        weights = dict.fromkeys(INSULTS, 1.0) | {w: x or 1.0 for w, x in learned.items()}
        keys = word_hash(list(weights))
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], np.array(list(weights.values()))[order]
        self.fixed, self.you = np.sort(word_hash(list(INSULTS))), np.sort(word_hash(list(SECOND_PERSON)))

    def weigh(self, h: np.ndarray) -> np.ndarray:
        """The weight of each word, 0 if it is none of the lexicon's."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.weights[at], 0.0)


def _member(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def _cores(alnum: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans from the first to the last letter or digit of each word; empty ones without any."""
    at = np.append(np.flatnonzero(alnum), len(alnum))
    first = np.minimum(at[np.searchsorted(at, starts)], ends)
    last = np.searchsorted(at, ends) - 1
    return first, np.where(first < ends, at[last] + 1, first)


def _packed(points: np.ndarray, keep: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of what `keep` leaves of each span."""
    total = np.concatenate(([0], np.cumsum(keep)))
    return Spans(points[keep]).hashes(total[starts], total[ends])


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """The dense features, one row a text, by whole-array passes over the code points of some texts."""
    c = cached("characters", Characters)
    points, o = code_points(data, offsets)
    beyond = points > 0xFFFF
    raw = np.where(beyond, np.uint32(0xFFFF), points)
    n_texts, low, alnum, letter, sign = len(o) - 1, np.where(beyond, points, c.lower[raw]), c.alnum[raw], c.letter[raw], c.sign[raw]
    starts, ends, n_words = word_spans(~c.blank[raw], o)
    doc, n = np.repeat(np.arange(n_texts), n_words), np.maximum(n_words, 1)

    def per_text(mask: np.ndarray) -> np.ndarray:
        """True characters of a mask, by text."""
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[o])

    def in_words(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[ends] - total[starts]

    def by_text(words: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc[words], weights, minlength=n_texts)

    first, last = _cores(alnum, starts, ends)
    h = Spans(low).hashes(first, last)
    # Obfuscated: a run of signs with a letter on either side.
    runs = np.flatnonzero(sign[1:] & letter[:-1]) + 1
    others = np.append(np.flatnonzero(~sign), len(sign))
    behind = others[np.searchsorted(others, runs)]
    runs = runs[(behind < len(sign)) & letter[np.minimum(behind, len(sign) - 1)]]
    hidden = np.unique(np.searchsorted(starts, runs, "right") - 1)
    if len(hidden):
        a, b = starts[hidden], ends[hidden]
        plain = np.where(beyond, points, c.plain[raw])
        read = Spans(plain).hashes(*_cores(c.alnum[np.minimum(plain, 0xFFFF)] & ~beyond, a, b))
        known = _member(read, lexicon.keys)
        h[hidden] = np.where(known, read, _packed(low, alnum, a, b))
    weight = lexicon.weigh(h)
    hits, you, fixed = np.flatnonzero(weight), np.flatnonzero(_member(h, lexicon.you)), np.flatnonzero(_member(h, lexicon.fixed))
    strongest = np.zeros(n_texts)
    np.maximum.at(strongest, doc[hits], weight[hits])
    near = hits[:0]
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        left, right = you[np.maximum(at - 1, 0)], you[np.minimum(at, len(you) - 1)]
        close = [(doc[x] == doc[hits]) & (np.abs(x - hits) <= NEAR) for x in (left, right)]
        near = hits[close[0] | close[1]]
    shouted = np.flatnonzero((ends - starts > 2) & (in_words(c.capital[raw]) > 0) & (in_words(c.small[raw]) == 0))
    size = np.maximum(np.diff(o), 1)
    return np.column_stack(
        [
            100.0 * by_text(hits) / n,
            100.0 * by_text(fixed) / n,
            100.0 * by_text(hits, weight[hits]) / n,
            np.minimum(by_text(hits), 50).astype(np.float64),
            strongest,
            100.0 * by_text(near) / n,
            by_text(you) / n,
            per_text(c.capital[raw]) / size,
            by_text(shouted) / n,
            per_text(raw == ord("!")) / n,
            per_text(np.isin(raw, [ord(x) for x in "?.,;:"])) / n,
            by_text(hidden) / n,
            np.log1p(n_words),
        ]
    )


def features_of(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """The features of a column of texts, some slices of bytes at a time."""
    data, offsets = text_bytes(column)
    parts = [features(data, offsets[a : b + 1], lexicon) for a, b in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


N_FEATURES = 13


class BoostedTrees:
    """Logistic gradient boosting with histogram splits; trees are arrays of a full binary tree."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)])
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(rate / (1 - rate)))
        self.least = max(2, min(LEAST_LEAF, int(LEAF_SHARE * len(y))))
        self.feature = np.zeros((TREES, 2**DEPTH - 1), np.int64)
        self.split = np.full((TREES, 2**DEPTH - 1), np.inf)
        self.value = np.zeros((TREES, 2**DEPTH))
        margin = np.full(len(y), self.base)
        for k in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            leaf = self._grow(k, binned, y - p, p * (1 - p))
            margin += self.value[k, leaf]

    def _grow(self, k: int, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        node = np.zeros(len(g), np.int64)
        for depth in range(DEPTH):
            for at in range(2**depth):
                rows, place = np.flatnonzero(node == at), 2**depth - 1 + at
                best, choice = 1e-9, None
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f, edges in enumerate(self.edges):
                    if not len(edges) or len(rows) < 2 * self.least:
                        continue
                    size = len(edges) + 1
                    b = binned[rows, f]
                    left_g, left_h, left_n = (np.cumsum(np.bincount(b, weights=w, minlength=size))[:-1] for w in (g[rows], h[rows], None))
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    gain[(left_n < self.least) | (len(rows) - left_n < self.least)] = 0
                    if gain.max() > best:
                        best, choice = gain.max(), (f, int(gain.argmax()))
                if choice:
                    self.feature[k, place], self.split[k, place] = choice[0], self.edges[choice[0]][choice[1]]
                    node[rows] = 2 * at + (binned[rows, choice[0]] > choice[1])
                else:
                    node[rows] = 2 * at
        for leaf in range(2**DEPTH):
            rows = node == leaf
            self.value[k, leaf] = RATE * g[rows].sum() / (h[rows].sum() + 1)
        return node

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, row = np.full(len(x), self.base), np.arange(len(x))
        for k in range(TREES):
            node = np.zeros(len(x), np.int64)
            for depth in range(DEPTH):
                place = 2**depth - 1 + node
                node = 2 * node + (x[row, self.feature[k, place]] > self.split[k, place])
            total += self.value[k, node]
        return total


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing map from score to the share of y (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least score, greatest score
    for s, v in zip(score[order], y[order], strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([float(v), 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
            blocks[-1][3] = last[3]
    knots = [(x, b[0] / b[1]) for b in blocks for x in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, knots: tuple, prior: float):
        self.lexicon, self.trees, self.knots, self.prior = lexicon, trees, knots, prior

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        return np.interp(self.trees.margin(features_of(texts, self.lexicon)), *self.knots)


def learn_lexicon(marked: DataFrame) -> dict[str, float]:
    """Words and their log-odds, from the texts of (text, toxic) that hold them, by class."""
    words = F.array_distinct(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    n1, n0 = marked.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    counts = marked.select("toxic", F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    top = counts.withColumn("odds", F.round(odds, 6)).where((F.col("t") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_LOG_ODDS)).orderBy(F.desc("t"), "word").limit(LEXICON_SIZE)
    return {r["word"]: float(r["odds"]) for r in top.collect()}


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    known = labels.where("doc_id is not null and toxic is not null").where(fold() != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(sample_rows)
    # Read once for both models; at most sample_rows ids.
    marked = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    lexicon = Lexicon(learn_lexicon(marked.where(part == 0)))

    def dense(batches):
        for batch in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(features_of(batch.column("text"), lexicon).ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("part"), x], names=["doc_id", "toxic", "part", "x"])

    found = small_batches(marked).withColumn("part", part).mapInArrow(dense, "doc_id long, toxic int, part long, x array<double>")
    rows = found.groupBy("doc_id", "toxic", "part").agg(F.min("x").alias("x")).orderBy("doc_id").toPandas()
    y, part_of = rows["toxic"].to_numpy(np.float64), rows["part"].to_numpy()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, N_FEATURES)
    # Part 0 gave the lexicon, so its densities are too good to learn from: trees use part 1, the map part 2.
    grow, fit = part_of == 1, part_of == 2
    if len(set(y[grow])) < 2 or len(set(y[fit])) < 2:
        return ToxicityModel(lexicon, None, (), float(y.mean()) if len(y) else 0.0)
    trees = BoostedTrees(x[grow], y[grow])
    return ToxicityModel(lexicon, trees, isotonic(trees.margin(x[fit]), y[fit]), float(y.mean()))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels, sample_rows)

    def apply(batches):
        for batch in batches:
            score = np.clip(model.score(batch.column("text")), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held_out = (fold() == 1).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text").mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
