import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom import cli
from patchloom.operators import cover, ingest, stats
from patchloom.plans import registry
from patchloom.sources import patchfile, synthetic
from patchloom.streaming.stats import cover_each_batch, start_hash_stats


def key(rows):
    return sorted(map(tuple, rows.select("patch_id", "pos", "hash", "x", "y").collect()), key=str)


@pytest.mark.parametrize("slices", [1, 2, 3, 7])
@pytest.mark.parametrize("located", [True, False])
def test_round_trip(spark, tmp_path, slices, located):
    rows = synthetic.generate(spark, synthetic.Parameters(500, 40, 12, 0.4, 5), located)
    path = str(tmp_path / "p.bin")
    patchfile.write_patches(ingest.nest_occurrences(rows), path, coords=located)
    assert key(patchfile.read_patches(spark, path, slices)) == key(rows)
    assert [p.name for p in tmp_path.iterdir()] == ["p.bin"]


def test_occurrences_of_a_patch_in_many_partitions(spark, tmp_path):
    """A patch of nearly all rows is dealt out; the file is that of whole patches."""
    rows = spark.range(20000).select(F.greatest(F.lit(0), F.col("id") - 19990).alias("patch_id"), F.col("id").cast("int").alias("pos"), (F.col("id") * 7919 % 1009).alias("hash"), F.rand(1).alias("x"), F.rand(2).alias("y")).cache()
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    patchfile.write_patches(ingest.nest_occurrences(rows), one)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the small partitions become one
    patchfile.write_occurrences(rows, two)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert (tmp_path / "one").read_bytes() == (tmp_path / "two").read_bytes()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one", "two"]


def test_windows_and_filters(spark, tmp_path):
    path = str(tmp_path / "p.bin")
    nested = ingest.from_lists(spark, [[1, 1, -5], [], [7], [8, 9]])
    patchfile.write_patches(nested, path, coords=False)
    rows = patchfile.read_patches(spark, path)
    assert sorted(r["patch_id"] for r in rows.collect()) == [0, 0, 0, 2, 3, 3]
    assert sorted(r["hash"] for r in rows.where("patch_id >= 2 and patch_id < 4").collect()) == [7, 8, 9]
    assert rows.where("patch_id = 1").count() == 0 and rows.where("patch_id = 77").count() == 0
    assert patchfile.read_patches(spark, path, begin=4, end=4).count() == 0
    assert list(patchfile.read_window(path, 4, 4)) == []
    for begin, end in ((3, 2), (0, 5)):
        with pytest.raises(patchfile.PatchFileError):
            list(patchfile.read_window(path, begin, end))


def test_damaged_files(spark, tmp_path):
    good = tmp_path / "p.bin"
    patchfile.write_patches(ingest.from_lists(spark, [[1, 2], [3]]), str(good), coords=False)
    raw = good.read_bytes()
    for name, content in (("magic", b"NOTAFILE" + raw[8:]), ("short", raw[:-16]), ("long", raw + b"x" * 8), ("stub", raw[:10])):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(patchfile.PatchFileError):
            patchfile.read_header(str(tmp_path / name))
    with pytest.raises(patchfile.PatchFileError):
        patchfile.read_header(str(tmp_path / "missing"))
    offsets = bytearray(raw)
    offsets[40:48] = struct.pack("<Q", 99)
    (tmp_path / "offsets").write_bytes(offsets)
    with pytest.raises(patchfile.PatchFileError):
        list(patchfile.read_window(str(tmp_path / "offsets"), 0, 2))
    with pytest.raises(Exception, match="need locations"):
        patchfile.read_patches(spark, str(good), located=True).collect()
    with pytest.raises(Exception, match="no location"):
        patchfile.write_patches(ingest.from_lists(spark, [[1]]), str(tmp_path / "q"), coords=True)


def test_a_file_solves_like_memory(spark, tmp_path):
    rows = synthetic.generate(spark, synthetic.Parameters(1000, 200, 30, 0.5, 3))
    path = str(tmp_path / "p.bin")
    patchfile.write_patches(ingest.nest_occurrences(rows), path, coords=False)
    a, b = (cover.PatchSelector().select(r).orderBy("step").collect() for r in (rows, patchfile.read_patches(spark, path)))
    assert a == b


def test_generator(spark):
    p = synthetic.Parameters(200, 30, 10, 0.3, 42)
    one, two = synthetic.patches(p), synthetic.patches(p)
    assert all((a == b).all() for a, b in zip(one, two, strict=True))
    other = synthetic.patches(synthetic.Parameters(200, 30, 10, 0.3, 1))
    assert any(len(a) != len(b) or (a != b).any() for a, b in zip(one, other, strict=True))
    assert len(one) == 30 and all(8 <= len(set(x.tolist())) == len(x) <= 12 for x in one)
    assert len(set(synthetic.hash_pool(5000, 9).tolist())) == 5000
    assert synthetic.Twister64(5489).next() == 14514284786278117030  # the published generator's first output
    half = synthetic.Parameters(1000, 200, 50, 0.5, 1)
    assert len(np.unique(np.concatenate(synthetic.patches(half)))) <= half.region() == 525
    with pytest.raises(ValueError, match="smaller"):
        synthetic.patches(synthetic.Parameters(5, 3, 10, 0.3, 1))
    assert synthetic.generate(spark, synthetic.Parameters(0, 0, 5)).count() == 0


def test_command_line(spark, tmp_path, capsys):
    path, out = str(tmp_path / "p.bin"), str(tmp_path / "s.txt")
    assert cli.run(["stats", "--N", "300", "--M", "40", "--K", "10", "--dump", path], spark) == 0
    assert cli.run(["cover", "--input", path, "--partition", "element", "--print-solution", "--profile"], spark) == 0
    assert cli.run(["stats", "--input", path, "--output", out, "--output-limit", "5"], spark) == 0
    said = capsys.readouterr().out
    assert "selected=" in said and "..." in said and "reported=5" in said
    assert cli.run(["stats", "--input", path], spark) == 1
    assert cli.run(["cover", "--input", str(tmp_path / "none")], spark) == 1
    with pytest.raises(SystemExit):
        cli.run(["cover", "--input", path, "--dump", path], spark)
    patchfile.write_patches(ingest.from_lists(spark, [[1]]), path, coords=False)
    assert cli.run(["stats", "--input", path, "--output", out], spark) == 1


def test_streams(spark, tmp_path):
    rows = synthetic.generate(spark, synthetic.Parameters(100, 20, 10, 0.5, 4), located=True).select("patch_id", "hash", "x", "y")
    source = str(tmp_path / "in")
    rows.repartition(3).write.parquet(source)
    rows.limit(20).write.mode("append").parquet(source)  # repeated occurrences count once
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    seen, covers = [], []
    start_hash_stats(stream, 10, lambda df, _: seen.append(df.collect()), str(tmp_path / "c1")).awaitTermination()
    assert seen[-1] == stats.top_k(stats.hash_stats(rows), 10).collect()
    cover_each_batch(stream, lambda df, _: covers.append(df.orderBy("step").collect()), str(tmp_path / "c2")).awaitTermination()
    assert covers[-1] == cover.cover_lazy(rows.select("patch_id", "hash").distinct()).orderBy("step").collect()


@pytest.mark.parametrize("gap", [0, 1000])
def test_round_trip_of_a_table_in_parts(spark, tmp_path, gap):
    """Several partitions, whose row ids pass 32 bits, and suppliers that do not count from 0."""
    supplier = F.col("id") % 7 * max(gap, 1) + gap
    rows = spark.range(500, numPartitions=5).select(supplier.alias("l_suppkey"), (F.col("id") % 11).alias("l_partkey"), F.col("id").cast("double").alias("l_extendedprice"), (F.col("id") % 3).cast("double").alias("l_quantity"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = registry.patch_file_round_trip(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("column", ["l_suppkey", "l_partkey"])
def test_round_trip_rejects_nulls(spark, tmp_path, column):
    rows = spark.range(40, numPartitions=2).select((F.col("id") % 7).alias("l_suppkey"), F.col("id").alias("l_partkey"), F.lit(1.0).alias("l_extendedprice"), F.lit(2.0).alias("l_quantity"))
    rows.withColumn(column, F.when(F.col("l_partkey") > 0, F.col(column))).write.parquet(str(tmp_path / "lineitem.parquet"))
    with pytest.raises(Exception, match="a patch id or a hash is null"):
        registry.patch_file_round_trip(spark, str(tmp_path)).collect()
