"""Licences of whole texts, wrapped headers and notices, cosines against a plain version, and hot keys."""

import os
import re
import textwrap
from collections import Counter

import numpy as np
import pytest

from patchloom.llm import license_scan
from patchloom.llm.license_texts import TEMPLATES

COMMON = "/usr/share/common-licenses"


def scan(spark, files):
    return {r["path"]: r for r in license_scan.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}


def wrapped(text, sign, width=60):
    return "\n".join(f"{sign} {x}" for x in textwrap.wrap(text, width))


def test_every_template_in_every_guise(spark):
    """As it is, wrapped in a comment between code, and as a licence file with a copyright line."""
    code = "def f(x):\n    return x + 1\n"
    files, truth = [], {}
    for k, (name, text) in enumerate(TEMPLATES):
        for j, body in enumerate((text, f"{code}\n{wrapped(text, '#')}\n\n{code}", f"/*\n{wrapped(text, ' *')}\n */\n{code}", f"Copyright (c) 2021 Jane Doe\n\n{textwrap.fill(text, 72)}\n")):
            files.append((f"d/{k}-{j}.c" if j < 3 else f"e{k}/LICENSE", body))
            truth[files[-1][0]] = name
    found = scan(spark, files)
    wrong = {p: (found[p]["own_license"], n) for p, n in truth.items() if found[p]["own_license"] != n}
    assert not wrong


def test_licences_of_several_paragraphs(spark):
    texts = {n: max((t for m, t in TEMPLATES if m == n), key=len) for n in ("mit", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "zlib")}
    files = []
    for name, text in texts.items():
        # Clauses apart, an unlike copyright line, a title of its own.
        parts = re.split(r"(?<=[.:]) (?=[A-Z1-3])", text)
        files.append((f"{name}/COPYING", "\n\n".join(["Copyright (c) 1999-2021, The Regents and Contributors", *(textwrap.fill(x, 65) for x in parts)])))
        files.append((f"{name}/src/a.c", "int a;"))
        files.append((f"{name}/mid.py", "import os\n\n" + "\n#\n".join(wrapped(x, "#") for x in parts) + "\n\nprint(1)\n"))
    found = scan(spark, files)
    assert {p: r["license"] for p, r in found.items()} == {p: p.split("/")[0] for p, _ in files}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="needs the texts that the system brings along")
def test_whole_licence_files(spark):
    truth = {"Apache-2.0": "apache-2.0", "GPL-2": "gpl-2.0", "GPL-3": "gpl-3.0", "LGPL-2.1": "lgpl-2.1", "LGPL-3": "lgpl-3.0", "MPL-2.0": "mpl-2.0", "CC0-1.0": "cc0-1.0", "BSD": "bsd-3-clause"}
    files = []
    for name in truth:
        with open(f"{COMMON}/{name}") as f:
            text = f.read()
        files += [(f"{name}/LICENSE", text), (f"{name}/a/b.c", "int b;"), (f"x/{name}.txt", text)]
    found = scan(spark, files)
    assert {n: (found[f"{n}/LICENSE"]["own_license"], found[f"{n}/a/b.c"]["inherited_license"], found[f"x/{n}.txt"]["own_license"]) for n in truth} == {n: (x, x, x) for n, x in truth.items()}


def test_ordinary_texts_have_no_licence(spark):
    texts = ["license to be read", "copyright notice of the author", "The software is free for all users.", "You need permission to use the copy of the source.", "A driving license, version 2.0, was released.", "SPDX-License-Identifier: Foo-1.0", "das ist mit dem neuen Haus", "License", "See the license for details.", "Warranty: two years on all parts."]
    assert all(r["own_license"] is None for r in scan(spark, [(str(i), t) for i, t in enumerate(texts)]).values())


def test_every_paragraph_of_the_templates_speaks_of_licences():
    words = re.compile(license_scan.WORDS)
    assert all(words.search(text) for _, text in TEMPLATES)
    for _, text in TEMPLATES:
        for part in re.split(r"(?<=[.:]) (?=[A-Z])", text):
            assert words.search(part) or len(part.split()) < 14, part


def test_cosines(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "license to be read by all", "Released under the BSD license, clause 3", "copyright notice of the author of the software, the software", "Licensed under CC BY-XY 4.0"]
    terms = lambda t: [w.strip(".") for w in re.split(r"[^\w.]+|_", t.lower()) if w.strip(".")]
    templates = [Counter(terms(t)) for _, t in TEMPLATES]
    df = Counter(t for c in templates for t in c)
    weigh = lambda c: {t: (1 + np.log(n)) * np.log((1 + len(templates)) / max(df[t], 1)) for t, n in c.items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    expected = {}
    for i, line in enumerate(lines):
        a = weigh(Counter(terms(line)))
        score, k = max((round(sum(a[t] * b.get(t, 0) for t in a) / norm(a) / norm(b), 6), -k) for k, b in enumerate(map(weigh, templates)))
        if score >= 0.3:
            expected[str(i)] = (TEMPLATES[-k][0], score)
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(lines)], "path string, text string")
    found = license_scan.license_scan(files, threshold=0.3).where("own_license is not null").collect()
    assert {r["path"]: (r["own_license"], r["score"]) for r in found} == {p: (n, pytest.approx(s, abs=2e-6)) for p, (n, s) in expected.items()}


def test_one_notice_in_most_files_and_equal_scores(spark):
    files = [(f"d{i % 7}/f{i}", "x = 1\n# Released under the MIT License.") for i in range(300)] + [("two", "SPDX-License-Identifier: ISC\nSPDX-License-Identifier: MIT")]
    found = scan(spark, files)
    assert Counter(r["own_license"] for r in found.values()) == Counter({"mit": 300, "isc": 1})
