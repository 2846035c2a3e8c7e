import pytest
from pyspark.sql import functions as F

from patchloom.operators import cover, ingest, stats
from patchloom.sources import synthetic


def incidences(spark, patches, ids=None):
    return ingest.incidence(ingest.explode_patches(ingest.from_lists(spark, patches, ids)))


def steps(selection):
    return [tuple(r) for r in selection.orderBy("step").select("patch_id", "gain", "covered").collect()]


@pytest.mark.parametrize(
    ("patches", "expected"),
    [
        ([[0, 1, 2, 3, 4]], [(0, 5, 5)]),
        ([[0, 1], [2, 3]], [(0, 2, 2), (1, 2, 4)]),
        ([[0, 1], [0, 1, 2, 3, 4], [4, 5]], [(1, 5, 5), (2, 1, 6)]),
        ([[], []], []),
        ([[7, 7, 7], [], [7]], [(0, 1, 1)]),
    ],
)
def test_small_covers(spark, patches, expected):
    rows = incidences(spark, patches)
    assert steps(cover.cover_lazy(rows)) == expected
    assert steps(cover.cover_naive(rows)) == expected


@pytest.mark.parametrize(("n", "m", "k", "overlap", "seed"), [(100, 50, 10, 0.3, 1), (300, 60, 12, 0.7, 3)])
def test_lazy_equals_naive_for_any_batch_and_partitioning(spark, n, m, k, overlap, seed):
    rows = ingest.incidence(synthetic.generate(spark, synthetic.Parameters(n, m, k, overlap, seed))).cache()
    truth = steps(cover.cover_naive(rows))
    assert truth[-1][2] == rows.select("hash").distinct().count()
    assert len({p for p, _, _ in truth}) == len(truth)
    for mode, patches, elements in (("patch", 4096, 10**6), ("patch", 6, 10**6), ("element", 12, 80)):
        assert steps(cover.cover_lazy(rows, mode, patches, elements)) == truth


def test_a_patch_larger_than_the_batch(spark):
    rows = ingest.incidence(synthetic.generate(spark, synthetic.Parameters(60, 12, 10, 0.3, 4))).cache()
    assert steps(cover.cover_lazy(rows, "patch", 5, 1)) == steps(cover.cover_naive(rows))


@pytest.mark.parametrize("partitions", ["1", "2", "7"])
def test_selection_does_not_depend_on_partitions(spark, partitions):
    rows = ingest.incidence(synthetic.generate(spark, synthetic.Parameters(100, 30, 10, 0.5, 9)))
    expected = steps(cover.cover_lazy(rows))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert steps(cover.cover_lazy(rows, "element", 7)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("p", "universe", "selected", "first"), [((10_000, 1_000, 50, 0.4, 42), 6019, 353, [44, 47, 92, 129, 727]), ((500_000, 10_000, 300, 0.3, 1), 350_023, 5378, [15, 190, 383, 687, 4406])])
def test_published_workloads(spark, p, universe, selected, first):
    selector = cover.PatchSelector()
    found = steps(selector.select(synthetic.generate(spark, synthetic.Parameters(*p))))
    assert (len(found), found[-1][2]) == (selected, universe)
    assert sorted(p for p, _, _ in found[:5]) == first or [p for p, _, _ in found[:5]] == first
    assert sum(r["winners"] for r in selector.profile.rounds) == selected
    assert "winners" in selector.profile.report()


@pytest.mark.parametrize("group_rows", [cover.GROUP_ROWS, 45, 1])
def test_grouped_cover_equals_a_cover_of_each_group(spark, group_rows):
    rows = spark.createDataFrame([(g, p, h) for g in (1, 2) for p in range(6) for h in range(p, 3 * p + g)], "g long, patch_id long, hash long")
    found = cover.cover_grouped(rows, "g", group_rows)
    for g in (1, 2):
        assert steps(found.where(F.col("g") == g)) == steps(cover.cover_naive(rows.where(F.col("g") == g).select("patch_id", "hash").distinct()))


def test_partial_results(spark):
    rows = incidences(spark, [[1, 2, 3], [3, 4], [4, 5, 6, 7]])
    chosen = spark.createDataFrame([(0,)], "patch_id long")
    assert sorted(r[0] for r in cover.newly_covered(rows, 1, chosen).collect()) == [4]
    assert sorted(map(tuple, cover.gains_after(rows, chosen).collect())) == [(1, 1), (2, 4)]
    assert tuple(cover.best_patch(cover.gains_after(rows, chosen)).first()) == (2, 4)
    assert tuple(cover.summary(cover.cover_lazy(rows)).first()) == (2, 7, 2)
    assert cover.best_patch(rows.limit(0).groupBy("patch_id").agg(F.count("*").alias("gain"))).count() == 0


def test_the_front_rejects_nulls_and_repeated_ids(spark):
    select = cover.PatchSelector().select
    null = spark.createDataFrame([(1, 10), (1, None), (2, 20)], "patch_id long, hash long")
    for rows in (null, null.selectExpr("hash patch_id", "patch_id hash")):
        with pytest.raises(Exception, match="null"):
            select(rows).collect()
        with pytest.raises(Exception, match="null"):
            cover.cover_lazy(rows).collect()
    twice = spark.createDataFrame([(1, [1, 2]), (1, [3])], "patch_id long, hashes array<long>")
    with pytest.raises(ValueError, match="repeats: 1"):
        select(twice)
    with pytest.raises(ValueError, match="null"):
        select(spark.createDataFrame([(None, [1, 2])], "patch_id long, hashes array<long>"))
    with pytest.raises(ValueError, match="pair off"):
        select(spark.createDataFrame([(1, 7, 0), (2, 8, 0)], "patch_id long, hash long, slot long"))


def test_ties_fall_to_the_input_position(spark):
    nested = spark.createDataFrame([(9, [1, 2], 0), (4, [3, 4], 1), (6, [5, 6, 1], 2), (5, [5, 6], 3)], "patch_id long, hashes array<long>, at int")
    assert steps(cover.PatchSelector().select(nested.drop("at"))) == [(6, 3, 3), (4, 2, 5), (9, 1, 6)]
    assert steps(cover.PatchSelector().select(ingest.with_slots(nested, ["at"]))) == [(6, 3, 3), (4, 2, 5), (9, 1, 6)]
    plain = nested.where("patch_id <> 6")
    assert [p for p, _, _ in steps(cover.PatchSelector().select(plain))] == [4, 5, 9]
    assert [p for p, _, _ in steps(cover.PatchSelector().select(ingest.with_slots(plain, ["at"])))] == [9, 4, 5]


@pytest.mark.parametrize(("n", "m", "k", "overlap", "seed"), [(200, 30, 10, 0.3, 42), (50, 200, 30, 1.0, 5), (1000, 40, 50, 0.5, 1)])
def test_draws_equal_those_of_one_by_one(n, m, k, overlap, seed):
    p = synthetic.Parameters(n, m, k, overlap, seed)
    rng, pool, region, (low, high) = synthetic.Twister64(seed), synthetic.hash_pool(n, seed), p.region(), p.sizes()
    for found in synthetic.patches(p):
        size, drawn = low + rng.below(high - low + 1), {}
        while len(drawn) < size:
            drawn[rng.below(region)] = None
        assert found.tolist() == pool[list(drawn)].tolist()


def test_ids_and_nulls_are_checked(spark):
    with pytest.raises(ValueError, match="repeat"):
        ingest.from_lists(spark, [[1], [2]], [5, 5])
    with pytest.raises(ValueError, match="mirror"):
        ingest.from_lists(spark, [[1]], coords=[[]])
    with pytest.raises(Exception, match="null"):
        ingest.validate(spark.createDataFrame([(1, None)], "patch_id long, hash long")).collect()
    with pytest.raises(Exception, match="repeats"):
        ingest.patch_list(spark.createDataFrame([(1,), (1,)], "patch_id long")).collect()
    with pytest.raises(Exception, match="location"):
        stats.require_locations(spark.createDataFrame([(1, 2, None, 1.0)], "patch_id long, hash long, x double, y double")).collect()
