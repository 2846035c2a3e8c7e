"""Copies of a passage that differ in blank lines."""

from patchloom.llm import linededup


def test_copies_with_other_blank_lines_go(spark, documents):
    lines = [" ".join(f"w{k}x{j}" for j in range(10)) for k in range(6)]
    middle = [*lines[:3], "", *lines[3:]]
    double = [x for line in lines for x in (line, " ")][:-1]
    rows = [(1, "\n".join(["one", *lines, "end"]), "en", "a"), (2, "\n".join(["two", *middle, "tail"]), "en", "a"), (3, "\n".join([*double, "", "three"]), "en", "a")]
    found = {r["doc_id"]: (r["text"], r["removed"]) for r in linededup.dedup_lines(documents(rows)).collect()}
    assert found[1] == (rows[0][1], None)
    assert found[2] == ("two\ntail", list(range(1, 8)))
    assert found[3] == ("\nthree", list(range(11)))
