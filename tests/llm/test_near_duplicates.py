"""The pipeline's near-duplicate stage against Jaccard similarities of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from patchloom.llm import neardup


@pytest.mark.parametrize("chunk", [neardup.CHUNK, 3])
def test_groups_whose_pairs_are_partly_near(spark, documents, chunk):
    """A chain of edits of one text: neighbours are near, ends are not; also with buckets cut into small chunks."""
    rng, texts = random.Random(4), []
    for g in range(3):
        words = [f"g{g}w{k}" for k in range(200)]
        for _ in range(25):
            words = list(words)
            for k in rng.sample(range(200), rng.choice((2, 3, 9))):
                words[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    found: dict = {}
    for r in neardup.near_components(documents([(i, t, "en", "a") for i, t in enumerate(texts)]), chunk).collect():
        found.setdefault(r["root"], set()).add(r["doc_id"])
    expected: dict = {}
    for i, r in enumerate(root):
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values())) and len(expected) > 5


def test_pivots_discard_no_near_pair_and_most_others():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (20, neardup.WIDE), dtype=np.uint64)
    fps = np.repeat(base, 10, axis=0)
    for row in fps:
        for bit in rng.choice(512, 30, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    table = neardup.distance_table(fps)
    gap = np.abs(table[:, None, :] - table[None, :, :]).max(axis=2)
    apart = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(axis=2)
    assert (gap <= apart).all() and (gap[apart > neardup.RADIUS] > neardup.RADIUS).mean() > 0.8


def test_stage_removes_all_pairs_at_jaccard_080(spark, documents, empty):
    rng = random.Random(3)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 600))]
        rows.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03):
            copy = list(base)
            for k in rng.sample(range(len(copy)), max(1, int(len(copy) * share))):
                copy[k] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(copy).title() if share == 0.01 else " ".join(copy))
    rows += [rows[0], "", None, "two words", "Two  Words", "two others"]
    sets = []
    for text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                pairs += 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = documents([(i, t, "en", "a") for i, t in enumerate(rows)])
    found = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(found) == sorted(set(root)) and pairs > 150
    assert corpus_pipeline.near_duplicates(spark, empty, "").count() == 0


def test_stage_keeps_one_of_odd_rows(spark, odd):
    found = corpus_pipeline.near_duplicates(spark, odd, "")
    assert found.columns == odd.columns
    assert sorted(found.toPandas()["doc_id"].dropna().tolist()) == [1, 3, 6, 7, 8]
