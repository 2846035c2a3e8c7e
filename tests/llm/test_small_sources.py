"""Sources far smaller than a block of the corpus keep to their targets."""

from collections import Counter

from patchloom.llm import mixing


def test_small_sources_meet_their_targets(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 256)
    rows = [(i, "w " * 2000, "en", "hot") for i in range(100)]
    rows += [(1000 + 10 * s + d, "w " * (10 + 3 * s), "en", f"s{s:02}") for s in range(60) for d in range(10)]
    found = mixing.mix_sources(documents(rows)).collect()
    taken, target = Counter(), {}
    for r in found:
        taken[r["src"]] += r["taken"]
        target[r["src"]] = r["target"]
    assert len(target) == 61 and all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in target)
