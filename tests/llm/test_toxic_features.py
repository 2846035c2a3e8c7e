"""The vectorised features against a plain version, and the trees' splits against all splits."""

import random
import re

import numpy as np
import pyarrow as pa

from patchloom.llm import toxicity
from patchloom.llm.common import text_bytes

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INSIDE = re.compile(r"(?<=[^\W\d_])[\d@$*#!|]+(?=[^\W\d_])")


def plain(text, learned):
    weights = dict.fromkeys(toxicity.INSULTS, 1.0) | learned
    raw = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, size = max(len(raw), 1), max(len(text), 1)
    hits, you, hidden, fixed, shouted = [], [], 0, 0, 0
    for i, r in enumerate(raw):
        w = EDGE.sub("", r.lower())
        if INSIDE.search(r):
            hidden += 1
            read = EDGE.sub("", r.lower().translate(str.maketrans(toxicity.LETTERS)))
            w = read if read in weights else re.sub(r"[\W_]", "", r.lower())
        if w in weights:
            hits.append((i, weights[w]))
        fixed += w in toxicity.INSULTS
        if w in toxicity.SECOND_PERSON:
            you.append(i)
        shouted += len(r) > 2 and r.isupper()
    near = sum(any(abs(i - k) <= toxicity.NEAR for k in you) for i, _ in hits)
    weight = [x for _, x in hits]
    signs = [sum(map(str.isupper, text)) / size, shouted / n, text.count("!") / n, sum(text.count(c) for c in "?.,;:") / n]
    return [100 * len(hits) / n, 100 * fixed / n, 100 * sum(weight) / n, min(len(hits), 50), max([0, *weight]), 100 * near / n, len(you) / n, *signs, hidden / n, np.log1p(len(raw))]


def test_features_equal_a_plain_version():
    rng = random.Random(1)
    pieces = ["you", "IDIOT", "id1ot", "m0r*n!", "st#pid", "«du»", "Straße", "ÜBEL", "tú,", "_fool_", "x3y", "3x", "a!", "!!!", "...", "漢字", "\U0001f600", "bad", "b@d", "A1B", "x" * 30, "ABC", "Été", "№5a", "a|b|c", "--", "q_r", "1a2"]
    blanks = [" ", "  ", "\n", "\t\r\n", " ", "\x0b"]
    texts = ["", " ", "you", "id1ot"] + ["".join(rng.choice(pieces) + rng.choice(blanks) for _ in range(rng.randrange(40))) for _ in range(300)]
    learned = {"bad": 3.5, "straße": 2.25, "x": 2.0, "moron": 4.0}
    found = toxicity.features_of(pa.array(texts), toxicity.Lexicon(learned))
    for text, row in zip(texts, found, strict=True):
        assert np.allclose(row, plain(text, learned)), (text, row, plain(text, learned))
    assert toxicity.features_of(pa.array([], pa.string()), toxicity.Lexicon({})).shape == (0, toxicity.N_FEATURES)
    assert not toxicity.features_of(pa.array([None, ""]), toxicity.Lexicon({})).any()


def test_broken_bytes_and_long_texts():
    data, offsets = text_bytes(pa.array(["you ok", "é" * 5, "idiot " * 200_000]))
    broken = data.copy()
    broken[7] = 0xFF
    rows = toxicity.features(broken, offsets, toxicity.Lexicon({}))
    assert rows[2][0] == 100 and rows[0][6] == 0.5


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (200, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(200) < 0.1)).astype(float)
    trees = toxicity.BoostedTrees(x, y)
    p = y.mean()
    g, h = y - p, np.full(200, p * (1 - p))
    best = max(
        (g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1), -f, -t)
        for f in range(3)
        for t in np.unique(x[:, f])[:-1]
        for left in [x[:, f] <= t]
        if min(left.sum(), (~left).sum()) >= trees.least
    )
    assert (trees.feature[0, 0], trees.split[0, 0]) == (-best[1], -best[2])
    assert ((trees.margin(x) > 0) == (y > 0.5)).mean() > 0.85
