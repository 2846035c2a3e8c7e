"""Equal rows stand together for exactly the copies that the mix takes of them."""

from collections import Counter

from patchloom.llm import mixing


def test_mix_of_equal_rows(spark, documents):
    rows = [(7, "a b c d", "en", "a")] * 40 + [(i, "e f g h", "en", "b") for i in range(100, 160)] + [(8, "a b c d", "en", "c")] * 3
    docs = documents(rows)
    wanted = Counter()
    for r in mixing.mix_sources(docs).collect():
        wanted[r["doc_id"]] += int(r["taken"] / r["size"] + 0.5)
    found = mixing.mix_corpus(docs)
    assert found.columns == docs.columns
    assert Counter(r["doc_id"] for r in found.collect()) == Counter({i: n for i, n in wanted.items() if n})
