"""The k-d tree's weighted medians against sorted sums, and the forests' paths against a walk."""

import random

import numpy as np

from patchloom.llm import quality, sharding


def test_weighted_medians(spark):
    rng = random.Random(9)
    rows = [(n, rng.randrange(1, 500), rng.choice((0.5, rng.random(), rng.random() ** 8))) for n in range(3) for _ in range(700)]
    rows += [(3, 5, 0.25)] * 40  # one value only
    want = {n: sum(s for m, s, _ in rows if m == n) * f for n, f in ((0, 0.5), (1, 0.1), (2, 0.9), (3, 0.5))}
    found = sharding._medians(spark.createDataFrame(rows, "node int, size long, x double"), want)
    for n in want:
        total = 0
        for x in sorted({x for m, _, x in rows if m == n}):
            own = sum(s for m, s, y in rows if m == n and y == x)
            if total + own > want[n]:
                break
            total += own
        assert found[n] == (x, total, own)


def test_a_tree_cuts_where_half_of_the_bytes_lie(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "ab cd\n" * rng.randrange(1, 400) + "x" * rng.randrange(9)) for i in range(600)], "doc_id long, text string")
    rows = sharding.metadata(docs).cache()
    levels, placed = sharding.build_tree(rows, 4)
    local = [r.asDict() for r in rows.collect()]
    node = dict.fromkeys((r["doc_id"] for r in local), 0)
    for level in levels:
        for n in set(node.values()):
            own = [r for r in local if node[r["doc_id"]] == n]
            spread = [max(r[d] for r in own) - min(r[d] for r in own) for d in sharding.DIMENSIONS]
            assert level.dim[n] == int(np.argmax(spread))
        left = {r["doc_id"]: (r[sharding.DIMENSIONS[level.dim[node[r["doc_id"]]]]], r["u"], r["v"]) < tuple(c[node[r["doc_id"]]] for c in (level.x, level.u, level.v)) for r in local}
        for n in set(node.values()):
            own = [r for r in local if node[r["doc_id"]] == n]
            share = sum(r["size"] for r in own if left[r["doc_id"]]) / sum(r["size"] for r in own)
            assert abs(share - 0.5) < 0.02
        node = {i: 2 * n + (not left[i]) for i, n in node.items()}
    assert {r["doc_id"]: r["shard"] for r in placed.collect()} == node


def test_forest_scores_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 3))
    forest = quality.IsolationForest(x[:200], x.min(0), x.max(0), [0, 1, 2], 20)
    expected = []
    for row in x[::7]:
        total = 0.0
        for k in range(20):
            node = 0
            for _ in range(quality.MAX_DEPTH):
                node = 2 * node + (2 if row[forest.feature[k, node]] > forest.split[k, node] else 1)
            total += forest.path[k, node]
        expected.append(2 ** (-total / 20 / forest.norm))
    assert np.allclose(forest.score(x[::7]), expected)
    # A path's length is its depth and, for the rows that end together, what a random tree adds.
    lengths = forest.path[forest.path > 0]
    assert lengths.min() >= 1 and lengths.max() <= quality.MAX_DEPTH + float(quality._expected_path(200))
