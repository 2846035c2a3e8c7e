"""Each operator against a plain version of itself, on a few hundred documents or on small fixtures."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from patchloom.llm import decontaminate, langid, license_scan, linededup, mixing, neardup, quality, queries, secrets, sharding, simhash, toxicity
from patchloom.llm.common import left_join_hot

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def local(docs):
    return docs.collect()


@needs_tables
def test_mix_follows_the_schedule(spark, docs, local):
    """The whole schedule in Python: targets by rounds of resharing, slots one by one, blocks word by word."""
    keys = {r["doc_id"]: r["k"] for r in docs.selectExpr("doc_id", "shiftrightunsigned(xxhash64(doc_id, 'mix'), 1) k").collect()}
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in local}
    of = defaultdict(list)
    for r in sorted(local, key=lambda r: (keys[r["doc_id"]], r["doc_id"])):
        of[r["source"]].append(r["doc_id"])
    sources = sorted(of)
    total = {s: sum(size[i] for i in of[s]) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_, budget = {}, set(sources), 1.5 * sum(total.values())
    while open_:
        share = {s: budget * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else share[s]
            budget -= target[s]
        open_ -= over or open_
    block = max(1, -(-int(sum(total.values()) * 1.5) // mixing.SLOTS))
    blocks = {s: -(-total[s] // block) for s in sources}
    high = np.cumsum([target[s] * blocks[s] / total[s] for s in sources])
    slots = np.arange(round(high[-1])) * mixing.GOLDEN
    counts = Counter(np.searchsorted(high, (slots - np.floor(slots)) * high[-1], "right").tolist())
    taken = dict.fromkeys(size, 0)
    for k, s in enumerate(sources):
        n = min(counts[k], 2 * blocks[s])
        begin = 0
        for i in of[s]:
            for w in range(begin, begin + size[i]):
                b = w // block
                taken[i] += n // blocks[s] + (b < n % blocks[s])
            begin += size[i]
    found = mixing.mix_sources(docs).collect()
    assert all(abs(r["target"] - target[r["src"][1:]]) < 1e-6 for r in found)
    near = [abs(r["taken"] - taken[r["doc_id"]]) <= 2 * block for r in found]  # a slot on the very edge of two sources
    assert all(near) and sum(r["taken"] == taken[r["doc_id"]] for r in found) >= len(found) - 4
    assert all(r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["src"][1:]] for r in found)
    whole = Counter(r["doc_id"] for r in mixing.mix_corpus(docs).select("doc_id").collect())
    assert all(whole[r["doc_id"]] == int(r["taken"] / r["size"] + 0.5) for r in found if r["size"])


@needs_tables
def test_shards(docs, local):
    found = sharding.shard_documents(docs).collect()
    text = {r["doc_id"]: r["text"].encode() for r in local}
    total, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]))
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text[text[r["doc_id"]]].add(r["shard"])
    assert len(found) == len(local) and set(total) == set(range(16))
    assert max(total.values()) < 1.1 * sum(total.values()) / 16 and min(total.values()) > 0.9 * sum(total.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in of_text.values()) <= 2
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_corpus(docs).collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in found}


def test_one_text_fills_all_shards(spark):
    same = spark.createDataFrame([(i, "all the same", "en", "a") for i in range(320)], "doc_id long, text string, lang string, source string")
    counts = Counter(r["shard"] for r in sharding.shard_documents(same).collect())
    assert sorted(counts.values()) == [20] * 16


@needs_tables
def test_quality_counts_and_verdicts(spark, docs, local):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    for r in local:
        w, lines = WORD.findall(r["text"]), [x for x in r["text"].split("\n") if WORD.search(x)]
        grams = list(zip(w, w[1:], w[2:], strict=False))
        times, cover = Counter(grams), set()
        for k, g in enumerate(grams):
            if times[g] > 1:
                cover |= {k, k + 1, k + 2}
        q = found[r["doc_id"]]
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r["text"]), len(lines) - len(set(lines)), len(cover))
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == base
        assert q["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (q["kept"] and q["base_failed"])
    known = [(found[r["doc_id"]], r["quality"]) for r in labels.collect() if not found[r["doc_id"]]["base_failed"]]
    assert np.mean([q["kept"] for q, y in known if y == 1]) > 0.98 and np.mean([q["kept"] for q, y in known if y == 0]) < 0.1
    assert {r["doc_id"] for r in quality.quality_filter(docs, labels).collect()} == {i for i, q in found.items() if q["kept"]}


def test_isolation_scores_single_out_a_far_point():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (300, 3)), [[0, 9, 0]]])
    forest = quality.IsolationForest(x[:300], x.min(0), x.max(0), [0, 1, 2], 50)
    scores = forest.score(x)
    assert scores[-1] > np.quantile(scores[:300], 0.97)


def test_masks_miss_no_window_with_a_fifth_substituted():
    for window in range(decontaminate.LEAST, decontaminate.WINDOW + 1):
        used = decontaminate.MASKS[:1] if window >= decontaminate.ALONE else decontaminate.MASKS
        for bad in itertools.combinations(range(window), window - -(-window * 8 // 10)):
            assert any(all(s + o not in bad for o in mask) for mask in used for s in range(window - mask[-1]))


@pytest.mark.parametrize("lengths", [(15, 16, 25, 40, 60), (1, 2, 3, 4, 5, 7, 8, 9, 11, 14, 30)])
def test_leaks_with_substitutions(spark, lengths):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items = [[word() for _ in range(n)] for n in lengths]
    texts = []
    for _ in range(120):
        body = [word() for _ in range(rng.randrange(5, 80))]
        if rng.random() < 0.7:
            item = list(rng.choice(items))
            for k in rng.sample(range(len(item)), int(len(item) * rng.choice((0, 0.1, 0.2, 0.4)))):
                item[k] = word()
            if rng.random() < 0.2:
                body = []
            at = rng.randrange(len(body) + 1)
            body[at:at] = item[rng.randrange(8) :] if rng.random() < 0.3 else item
        texts.append(", ".join(w.title() for w in body))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    truth = {}
    for d, text in enumerate(texts):
        tokens = re.findall(r"\w+", text.lower())
        for i, item in enumerate(items):
            w = min(20, len(item))
            best = 0
            for diagonal in range(-len(item), len(tokens)):
                same = [tokens[k + diagonal] == item[k] for k in range(max(0, -diagonal), min(len(item), len(tokens) - diagonal))]
                best = max([best, *(sum(same[s : s + w]) for s in range(len(same) - w + 1))])
            if best >= (0.8 * w if w >= 8 else w) and (len(item) >= 4 or tokens == item):
                truth[d, i] = best
    found = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontaminate.leaks(docs, bench).collect()}
    assert found == truth and 20 < len(truth) < 110
    assert {r[0] for r in decontaminate.decontaminate(docs, bench).select("doc_id").collect()} == set(range(120)) - {d for d, _ in truth}


ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_spans(spark):
    pieces = ["password: ", "PassWD=", 'api_key = "', "APIKEY:'", "token=token:", "secret", "abcdef", "abcdefgh", "AKIA" + "B" * 16, "AKIA" + "C" * 15, "deadbeef" * 3, "0" * 23, "é漢\U0001f600 ", "\n", " ", "=", "'", "x"]
    rng = random.Random(2)
    texts = ["".join(rng.choices(pieces, k=rng.randrange(14))) for _ in range(400)] + ["".join(pieces)]
    texts += ["".join(rng.choices(pieces, k=4000)) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["path"]: r for r in secrets.scan([docs])[0].collect()}
    for i, text in enumerate(texts):
        spans = base_spans(text)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert found[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [found[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) - {""} <= set(found[i]["spans"].split(","))


def test_more_secret_kinds(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 18 + " postgres://bob:hunter2@db eyJabcdefgh.abcdefgh1.abcdefgh2"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kinds = {s.split(":")[0] for s in secrets.scan([docs])[0].first()["spans"].split(",")}
    assert kinds == {"pem", "github", "url", "jwt", "hex"}  # the github token is a hex run too


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    first = spark.createDataFrame([("a", "token = abcdef1"), ("b", "nothing"), ("c", "nothing")], "path string, text string")
    second = spark.createDataFrame([("a", "token = abcdef1"), ("d", "token = abcdef2")], "path string, text string")
    ledger = str(tmp_path / "ledger")
    assert secrets.scan_with_ledger(first, ledger, "path").count() == 3
    assert spark.read.parquet(ledger).count() == 2
    _, new = secrets.scan([second], spark.read.parquet(ledger), "path")
    assert new.count() == 1
    assert {r["path"]: r["n_assign"] for r in secrets.scan_with_ledger(second, ledger, "path").collect()} == {"a": 1, "d": 1}
    stale = spark.read.parquet(ledger).withColumn("rule_version", F.lit("0"))
    assert secrets.scan([second], stale, "path")[1].count() == 2
    history, _ = secrets.scan([first, second], None, "path")
    assert history.count() == 5


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    found = queries.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(queries.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns) and len(found)
    columns = sorted(found.columns)
    assert sorted(found[columns].astype(str).to_numpy().tolist()) == sorted(expected[columns].astype(str).to_numpy().tolist())


@needs_tables
def test_repeated_runs_of_lines(docs, local):
    """Every line in a run of 50 words that is there earlier goes; no line goes that isn't there earlier."""
    removed = {r["doc_id"]: set(r["removed"] or []) for r in linededup.dedup_lines(docs).select("doc_id", "removed").collect()}
    runs, lines, n = set(), set(), 0
    for r in sorted(local, key=lambda r: r["doc_id"]):
        own = [x.strip(BLANK) for x in r["text"].split("\n")]
        words = [len(WORD.findall(x)) for x in own]
        for a in range(len(own)):
            b, total = a, words[a]
            while words[a] and total < 50 and b + 1 < len(own):
                b += 1
                total += words[b]
            if words[a] and total >= 50:
                run = tuple(x for x in own[a : b + 1] if x)
                if run in runs:
                    assert {k for k in range(a, b + 1) if words[k]} <= removed[r["doc_id"]]
                    n += 1
                runs.add(run)
        for k, x in enumerate(own):
            assert k not in removed[r["doc_id"]] or not x or x in lines
            lines.add(x)
    assert n > 100


@needs_tables
def test_simhash_components(docs, local):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    fps = []
    for r in local:
        w = WORD.findall(r["text"].translate(lower))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
        fps.append(sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)))
    expected = link(np.array(fps, np.uint64), [r["doc_id"] for r in local])
    found = {r["doc_id"]: r for r in simhash.simhash_components(docs).collect()}
    assert {i: found[i]["fingerprint"] & (1 << 64) - 1 for i in found} == dict(zip((r["doc_id"] for r in local), fps, strict=True))
    assert {i: found[i]["component_id"] for i in found} == expected
    assert {r[0] for r in simhash.fingerprint_dedup(docs).select("doc_id").collect()} == set(expected.values())


def link(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = sorted((find(i), find(int(j))), key=lambda k: ids[k])
            parent[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(fps))}


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
def test_components_of_planted_fingerprints(spark, bucket_rows, monkeypatch):
    """Chains and clusters of close fingerprints, also with buckets so small that large ones are cut in chunks."""
    rng = random.Random(8)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 30))):
            fps.add(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    near = rng.getrandbits(64)
    fps |= {near ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(8)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.candidate_links(nodes, bucket_rows).cache()
    expected = link(np.array(signed, np.int64).view(np.uint64), signed)
    for part_edges, hub_edges in ((100_000, 200_000), (40, 200_000), (40, 10)):
        monkeypatch.setattr(simhash, "HUB_EDGES", hub_edges)
        found = {r["node"]: r["root"] for r in simhash.components(links, part_edges=part_edges).collect()}
        assert {f: found.get(f, f) for f in signed} == expected


@needs_tables
def test_held_out_languages(docs, local):
    lang = {r["doc_id"]: r["lang"] for r in local}
    found = langid.identify(docs).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in found)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in toxicity.score_toxicity(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    # A fifth of the toxic labels of this table are on texts without an insult.
    assert np.mean([r["predicted"] for r in held if truth[r["doc_id"]]]) > 0.75
    assert np.mean([r["predicted"] for r in held if not truth[r["doc_id"]]]) < 0.02


def test_isotonic_map_is_the_least_squares_one():
    x, y = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 2.0, 5.0]), np.array([0.0, 0.0, 1.0, 1.0, 1.0]))
    assert np.interp([1, 2, 3, 5], x, y).round(6).tolist() == [0.0, round(2 / 3, 6), round(2 / 3, 6), 1.0]


def test_licences(spark):
    files = [
        ("p/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("p/src/a.py", "# code\nprint(1)"),
        ("p/src/b.py", "# Released under the MIT License.\nprint(2)"),
        ("p/vendor/x/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("p/vendor/x/y/z.c", "int main() {}"),
        ("q/readme", "words about licenses in general and how the weather was on that day"),
        ("q/notes", "Released under the MIT License."),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    found = {r["path"]: r for r in license_scan.license_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: r["own_license"] for p, r in found.items()} == {"p/LICENSE": "apache-2.0", "p/src/a.py": None, "p/src/b.py": "mit", "p/vendor/x/COPYING": "gpl-3.0", "p/vendor/x/y/z.c": None, "q/readme": None, "q/notes": "mit", None: "cc-by-nc-4.0"}
    assert {p: r["license"] for p, r in found.items() if r["own_license"] is None} == {"p/src/a.py": "apache-2.0", "p/vendor/x/y/z.c": "gpl-3.0", "q/readme": "mit"}
    assert found["p/vendor/x/y/z.c"]["inherited_from"] == "p/vendor/x" and found[None]["inherited_license"] is None


@needs_tables
def test_pipeline(spark, docs, local):
    """The stages' decisions, one after the other, from the operators' own tested results."""
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    out = corpus_pipeline.run(spark, SF)
    left = quality.quality_scores(docs, labels).where("kept").select("doc_id").join(docs, "doc_id").select(docs.columns).cache()
    groups = defaultdict(list)
    for r in neardup.near_components(left).collect():
        groups[r["root"]].append(r["doc_id"])
    left = left.where(left["doc_id"].isin([min(g) for g in groups.values()])).cache()
    bad = {r["doc_id"] for r in decontaminate.leaks(left, benchmark).collect()}
    left = left.where(~left["doc_id"].isin(list(bad))).cache()
    copies = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix_sources(left).collect() if r["size"]}
    found = out.collect()
    assert Counter(r["doc_id"] for r in found) == Counter({i: n for i, n in copies.items() if n})
    assert {r["text"] for r in found} <= {r["text"] for r in local}
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 16 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_left_join_of_hot_and_null_keys(spark):
    data = [("a" if i % 3 else ("b" if i % 2 else None), i) for i in range(300)] + [(f"k{i}", 1000 + i) for i in range(600)]
    rows = spark.createDataFrame(data, "k string, i long")
    known = {"a": "A"} | {f"k{i}": f"K{i}" for i in range(0, 600, 2)}
    small = spark.createDataFrame(list(known.items()), "k string, v string")
    found = left_join_hot(rows, small, "k", len(data), rows.groupBy("k").count(), F.xxhash64("i"), 20)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == [(k, i, known.get(k)) for k, i in sorted(data, key=lambda r: r[1])]
