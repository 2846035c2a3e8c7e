import random

import pytest
from pyspark.sql import functions as F

from patchloom.functions.bits import hex16, to_signed, unsigned
from patchloom.operators import bitset, index, ingest, stats
from patchloom.sources import statsfile, synthetic

PATCHES = [[0, 2], [1, 2, 3], [0, 4], [3, 4]]


def incidences(spark, patches):
    return ingest.incidence(ingest.explode_patches(ingest.from_lists(spark, patches)))


def test_indexes(spark):
    s = index.PatchSet(ingest.explode_patches(ingest.from_lists(spark, PATCHES)))
    assert (s.n, s.m) == (5, 4)
    assert {r["patch_id"]: r["elements"] for r in s.csr.collect()} == dict(enumerate(PATCHES))
    assert {r["element_id"]: r["patches"] for r in s.inverted.collect()} == {0: [0, 2], 1: [1], 2: [0, 1], 3: [1, 3], 4: [2, 3]}


def test_lookups_miss_quietly(spark):
    encoded = incidences(spark, [[0, 2], [2, 4]]).withColumnRenamed("hash", "element_id")
    wanted = spark.createDataFrame([(e,) for e in (1, 2, 3, 9)], "element_id long")
    assert {r[0]: r[1] for r in index.patches_of(index.inverted_index(encoded), wanted).collect()} == {1: [], 2: [0, 1], 3: [], 9: []}
    ids = spark.createDataFrame([(1,), (7,)], "patch_id long")
    assert {r[0]: (r[1], r[2]) for r in index.patch_lookup(index.patch_csr(encoded), ids).collect()} == {1: ([2, 4], 2), 7: ([], 0)}


@pytest.mark.parametrize("partitions", ["1", "3", "8"])
def test_dictionary_is_in_unsigned_order(spark, partitions):
    rng = random.Random(3)
    hashes = [0, 5, 1 << 63, (1 << 64) - 1, (1 << 63) - 1] + [rng.getrandbits(64) for _ in range(500)]
    rows = spark.createDataFrame([(i % 7, to_signed(h)) for i, h in enumerate(hashes)], "patch_id long, hash long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r["hash"]: r["element_id"] for r in index.dictionary(rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {to_signed(h): i for i, h in enumerate(sorted(set(hashes)))}
    shards = index.element_shard(index.dictionary(rows), 4)
    assert shards.agg(F.max("shard")).first()[0] <= 3
    assert rows.select(hex16(F.lit(-1)).alias("h")).first()[0] == "f" * 16


def test_bitmaps(spark):
    ids = [3, 7, 64, 65, 128, 199, 40_000]
    rows = spark.createDataFrame([(i,) for i in ids], "element_id long")
    probe = spark.createDataFrame([(i,) for i in (3, 4, 7, 64, 100, 128, 199, 0)], "element_id long")
    bits = bitset.build(rows)
    assert bitset.popcount(bits).first()[0] == 7
    assert sorted(r[0] for r in bitset.members(bits).collect()) == ids
    assert bitset.intersect_count(rows, probe).first()[0] == 5
    assert {r[0] for r in bitset.test(bits, probe).where("is_set").collect()} == {3, 7, 64, 128, 199}
    both = bitset.union(bitset.build(rows).union(bitset.build(probe)))
    assert sorted(r[0] for r in bitset.members(both).collect()) == sorted({*ids, 0, 3, 4, 7, 64, 100, 128, 199})
    assert bitset.popcount(bitset.build(rows.limit(0))).first()[0] == 0


def test_minimum_locations(spark):
    nested = ingest.from_lists(spark, [[7, 3, 7], [3, 9]], coords=[[(2.0, 2.0), (5.0, 5.0), (2.0, 1.0)], [(4.0, 4.0), (0.0, 9.0)]])
    found = {r["hash"]: (r["n_patches"], tuple(r["rep"])) for r in stats.hash_stats(ingest.explode_patches(nested)).collect()}
    assert found == {3: (2, (4.0, 4.0)), 7: (1, (2.0, 1.0)), 9: (1, (0.0, 9.0))}
    zero = ingest.from_lists(spark, [[1, 1, 1]], coords=[[(0.0, 9.0), (-0.0, 5.0), (float("nan"), 0.0)]])
    assert stats.min_location(ingest.explode_patches(zero)).first()["rep"]["y"] == 5.0


@pytest.mark.parametrize("k", [17, 10_000, 0])
def test_top_k_against_python(spark, k):
    rows = synthetic.generate(spark, synthetic.Parameters(400, 60, 15, 0.5, 41), located=True)
    truth: dict = {}
    for r in rows.collect():
        n, rep = truth.get(r["hash"], (set(), (1e9, 1e9)))
        truth[r["hash"]] = (n | {r["patch_id"]}, min(rep, (r["x"], r["y"])))
    order = sorted(truth, key=lambda h: (-len(truth[h][0]), h & (1 << 64) - 1))[:k]
    found = [(r["hash"], r["n_patches"], tuple(r["rep"])) for r in stats.top_k(stats.hash_stats(rows), k).collect()]
    assert found == [(h, len(truth[h][0]), truth[h][1]) for h in order]


def test_stats_file_replaces_a_longer_one(spark, tmp_path):
    rows = synthetic.generate(spark, synthetic.Parameters(100, 20, 10, 0.5, 43), located=True)
    path = tmp_path / "stats.txt"
    path.write_text("x" * 100_000)
    every = stats.hash_stats(rows)
    n = statsfile.write_stats(stats.top_k(every, 23), str(path))
    lines = path.read_text().split("\n")
    assert n == 23 and lines[0] == statsfile.header(23).strip() and all(len(x) == 89 for x in lines[1:24]) and lines[24:] == [""]
    first = stats.top_k(every, 1).first()
    assert lines[1].split("\t")[0] == f"{first['hash'] & (1 << 64) - 1:016x}"
    assert float(lines[1].split("\t")[2]) == first["rep"]["x"]
    assert "1.00000000000000006e-01" in statsfile.format_record(-1, 1, 0.1, -1e300)
    by_record = {r["hash"]: r["record"] for r in statsfile.records(every).collect()}
    assert by_record[first["hash"]] == lines[1]


def test_unsigned_order(spark):
    rows = spark.createDataFrame([(to_signed(h),) for h in ((1 << 64) - 1, 5, 1 << 63)], "h long")
    assert [r[0] for r in rows.orderBy(unsigned("h")).collect()] == [5, to_signed(1 << 63), -1]
