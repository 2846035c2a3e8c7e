"""The quality rules are fitted on all labelled rows."""

import numpy as np
from pyspark.sql import functions as F

from patchloom.llm import quality


def test_bad_rows_behind_a_sample_are_seen(spark):
    """The 60 bad rows are the last of 9,000 in the order of their ids' hash."""
    ids = [r["id"] for r in spark.range(9000).orderBy(F.xxhash64("id")).collect()]
    bad = set(ids[-60:])
    rng = np.random.default_rng(3)
    rows = []
    for i in ids:
        words = [f"word{k}" + "x" * (k % 5) for k in rng.integers(0, 10**6, rng.integers(55, 75))]
        rows.append((i, " ".join(w + ("#$%" if i in bad else "") for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int")
    gone = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("not kept").collect()}
    assert bad <= gone and len(gone - bad) <= 18  # of the good ones two in a thousand
    assert {r["doc_id"] for r in quality.quality_filter(docs, labels).select("doc_id").collect()} == set(ids) - gone


def test_leaves_counted_in_parts():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (700, 3))
    whole, parts = (quality.IsolationForest(rows, x.min(0), x.max(0), [0, 2], 10) for rows in (x, None))
    parts.count(parts.tally(x[:100]) + parts.tally(x[100:]))
    assert (whole.path == parts.path).all() and whole.norm == parts.norm
    assert (whole.tally(x).sum(1) == 700).all() and (whole.feature != 1).all()


def test_threshold_of_counted_steps():
    """As by the sorted scores of single rows: the smallest step with the greatest gain."""
    rng = np.random.default_rng(5)
    for loss in (0.002, 0.1):
        good, bad = quality.step(rng.normal(0.4, 0.02, 900)), quality.step(rng.normal(0.5, 0.05, 90))
        steps = np.unique(np.concatenate((good, bad)))
        counts = [np.array([(rows == s).sum() for s in steps]) for rows in (good, bad)]
        last, at, gain = quality.calibrate(steps, *counts, 90, loss)
        able = [s for s in steps[:-1] if (good > s).mean() <= loss]
        gains = [(bad > s).mean() - 10 * (good > s).mean() for s in able]
        assert np.isclose(gain, max(gains)) and last == able[int(np.argmax(gains))]
        assert last <= at * quality.GRID < steps[np.searchsorted(steps, last) + 1]
