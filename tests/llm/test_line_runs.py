"""Exactly the lines of runs of 50 words that stand earlier go: random short lines against all runs."""

import random

import pytest

from patchloom.llm import linededup


def truth(texts, run_words=50):
    """Removed positions by text, from all runs: quadratic in the lines of a text."""
    seen, out = set(), []
    for text in texts:
        every = [x.strip() for x in text.split("\n")]
        at = [k for k, x in enumerate(every) if x]
        lines, own, gone = [every[k] for k in at], [], set()
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(lines[b].split())
                if words >= run_words:
                    own.append((a, b, hash(tuple(lines[a : b + 1]))))
                if words >= 2 * run_words + 40:
                    break
        for a, b, run in own:  # by start, so a run may stand earlier in its own text
            if run in seen:
                gone |= set(range(at[a], at[b] + 1))
            seen.add(run)
        out.append(sorted(gone))
    return out


def removed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["removed"] or [] for r in linededup.dedup_lines(docs).orderBy("doc_id").collect()]


def test_an_excerpt_elsewhere_saves_no_line(spark):
    """Two texts share 25 lines of two words; an earlier one holds only the last 21 of them."""
    rng = random.Random(6)
    run = [f"a{k} b{k}" for k in range(25)]
    fill = lambda n: [f"f{rng.random()} g" for _ in range(n)]
    for first in range(1, 5):
        texts = ["\n".join([*fill(7), *run[first:], *fill(4)]), "\n".join([*fill(3), *run, *fill(9)]), "\n".join([*fill(30), *run, *fill(2)])]
        assert removed(spark, texts) == truth(texts)
        assert removed(spark, texts)[2] == list(range(30, 55))


@pytest.mark.parametrize("per_line", [1, 2, 5])
def test_random_runs(spark, per_line):
    rng = random.Random(per_line)
    lines = [" ".join(f"w{k}x{j}" for j in range(per_line)) for k in range(4000)]
    stock = [lines[rng.randrange(3000) :][: rng.randrange(30, 160) // per_line + 3] for _ in range(25)]
    texts = []
    for _ in range(90):
        body = []
        for _ in range(rng.randrange(1, 5)):
            run = rng.choice(stock)
            a, b = sorted(rng.sample(range(len(run) + 1), 2)) if rng.random() < 0.7 else (0, len(run))
            body += [x for y in run[a:b] for x in ([y, ""] if rng.random() < 0.05 else [y])] + [f"own{rng.random()} and"] * rng.randrange(2)
        texts.append("\n".join(body))
    texts += ["\n".join(["same line here"] * 60), "\n".join(["same line here"] * 40), texts[3], ""]
    found, expected = removed(spark, texts), truth(texts)
    assert found == expected and sum(map(bool, expected)) > 20


def test_one_line_of_fifty_words_and_a_short_one_behind_it(spark):
    long, short = " ".join(f"w{k}" for k in range(60)), "a b"
    texts = [long, f"{long}\n{short}", f"x\n{long}\n{short}\ny"]
    assert removed(spark, texts) == truth(texts) == [[], [0], [1, 2]]


def test_one_passage_in_all_texts(spark):
    run = [f"a{k} b{k} c{k}" for k in range(20)]
    texts = ["\n".join([f"t{i} u{i}", *run, f"v{i}"]) for i in range(400)]
    assert removed(spark, texts) == [[]] + [list(range(1, 21))] * 399
